"""A Merkle manifest of a dataset, whose nodes keep SHA midstates.

Leaves are digests of rows, one tree a source, leaves ascending by document id; three consecutive nodes make a parent
(the last run of a level may be shorter) until one is left. The trees' roots, ordered by source, make one more tree.

* Every parent keeps its digest and the hash state before each of its children (`sha_states`): digests are hex text of
  64 bytes, one SHA-256 block each, so a state between children is 32 bytes and can be stored.
* Folding a replaced leaf takes up the state kept before its slot, adds the replacement and its right siblings only, and
  goes on with the parent: left siblings are never read again.
* A page is a subtree of `PAGE_LEVELS` levels. Leaves are numbered by a range sort (source, id, digest) with counts
  of each partition; pages are built from shuffled runs of numbers, so a source with a third of all rows is as
  many pages as it needs and no task holds more than batches of whole pages. Page roots are the next layer's nodes.
* Paths (siblings, states, right siblings) go down from the top, a row a page, and meet the leaves of the page.

Every layer is written to the shared folder before the next one, so lost executors repeat little. One row, the root, reaches the
driver. Null ids come first, rows with equal ids stand in the order of their digests (equal rows are
interchangeable); a null in a column is hashed as `-`, unlike an empty text. A null id is never tampered with.
Very long texts are hashed whole in the JVM. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treegauge.llm import sha_states as sha
from treegauge.llm.common import chosen, written

RUN = 3
PAGE_LEVELS = 6
PAGE = RUN ** PAGE_LEVELS
#: The tree over the sources' roots.
TOP = ""

_PARENTS = "tree string, page long, level int, pos long, digest string, states binary, top boolean, n long"
_PATHS = "tree string, page long, layer int, subroot string, suffix string, steps binary, rights array<string>, counts array<int>"
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(text: Column, doc_id: str = "doc_id") -> Column:
    """The digest of a row with this text."""
    def part(value: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(part(F.col(doc_id).cast("string")), part(F.col("source")), part(F.col("lang")),
                           part(F.col("n_chars").cast("string")), part(text)), 256)


def _leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, changed): the changed digest is of the text as tampered with."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_digest(F.col("text")).alias("digest"),
                       leaf_digest(tampered).alias("changed"))
    return rows


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds pos, the place of a row in its tree in this order, and n, the tree's rows: a range sort and counts by partition."""
    apart = rows.withColumn("_apart", F.monotonically_increasing_id())  # equal rows may spread over partitions
    ordered = apart.repartitionByRange("tree", *order, "_apart").sortWithinPartitions("tree", *order, "_apart").drop("_apart")
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy("tree", part.alias("_part")).agg(F.min(place).alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("tree")
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_rows").over(whole).alias("n"))
    joined = placed.withColumn("_part", part).withColumn("_place", place).join(counts, ["tree", "_part"])
    return joined.withColumn("pos", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift", "_at")


def _paged(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "page").sortWithinPartitions("tree", "page", "level", "pos")


def whole_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in batches that never end inside a page."""
    rest = None
    for part in batches:
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        if not len(part):
            continue
        inside = ((part["tree"] == part["tree"].iloc[-1]) & (part["page"] == part["page"].iloc[-1])).to_numpy()
        cut = int(np.argmax(inside))
        if cut:
            yield part.iloc[:cut].reset_index(drop=True)
        rest = part.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _page_numbers(part: pd.DataFrame) -> np.ndarray:
    """0, 1, ... for the pages of a batch, as they come."""
    new = (part["tree"] != part["tree"].shift()) | (part["page"] != part["page"].shift())
    return np.cumsum(new.to_numpy()) - 1


def heights(n: np.ndarray) -> np.ndarray:
    """Levels above so many nodes."""
    n, out = n.astype(np.int64).copy(), np.zeros(len(n), dtype=np.int64)
    while (n > 1).any():
        out += n > 1
        n = np.where(n > 1, -(-n // RUN), n)
    return out


def _parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parents inside each page, with the states before their children; the page's root is marked."""
    for part in whole_pages(batches):
        page = _page_numbers(part)
        first_rows = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        trees, pages, n = (part[c].to_numpy()[first_rows] for c in ("tree", "page", "n"))
        left = np.minimum(heights(n), PAGE_LEVELS)
        single = first_rows[left == 0]
        if len(single):
            alone = part.iloc[single]
            yield pd.DataFrame({"tree": alone["tree"].to_numpy(), "page": alone["page"].to_numpy(), "level": 0, "pos": alone["pos"].to_numpy(),
                                "digest": alone["digest"].to_numpy(), "states": None, "top": True, "n": 1})
        pos, blocks = part["pos"].to_numpy().astype(np.int64), sha.blocks_of(part["digest"])
        for level in range(1, PAGE_LEVELS + 1):
            on = left[page] >= level
            page, pos, blocks = page[on], pos[on], blocks[on]
            if not len(page):
                break
            slot = pos % RUN
            parent = np.cumsum(slot == 0) - 1
            counts = np.bincount(parent)
            states, kept = sha.start_states(len(counts)), np.zeros((len(counts), RUN, 8), dtype=np.uint32)
            for s in range(RUN):
                who = np.flatnonzero(slot == s)
                kept[parent[who], s] = states[parent[who]]
                states[parent[who]] = sha.take_up(states[parent[who]], blocks[who])
            page, pos, blocks = page[slot == 0], pos[slot == 0] // RUN, sha.finish(states, counts)
            flat = sha.bytes_of(kept.reshape(-1, 8))
            yield pd.DataFrame({"tree": trees[page], "page": pages[page], "level": level, "pos": pos, "digest": sha.texts_of(blocks),
                                "states": [b"".join(flat[RUN * i:RUN * i + c]) for i, c in enumerate(counts)], "top": left[page] == level, "n": n[page]})


@dataclass
class Layer:
    """Nodes (tree, pos, n, digest) and the parents that pages make of them."""

    nodes: DataFrame
    parents: DataFrame


def _layers(nodes: DataFrame, most: int) -> tuple[list[Layer], DataFrame]:
    """Layers of pages over nodes, at most `most` nodes a tree; and every tree's root: tree, digest, layer."""
    layers, roots = [], None
    while True:
        paged = _paged(nodes.withColumn("page", F.expr(f"pos div {PAGE}")).withColumn("level", F.lit(0)))
        parents = written(paged.select("tree", "page", "pos", "n", "digest").mapInPandas(_parents, _PARENTS), "parents")
        layers.append(Layer(nodes, parents))
        tops = parents.where("top")
        done = tops.where(F.col("n") <= PAGE).select("tree", "digest", F.lit(len(layers) - 1).alias("layer"))
        roots = done if roots is None else roots.unionByName(done)
        if most <= PAGE:
            return layers, roots
        nodes = written(tops.where(F.col("n") > PAGE).select(
            "tree", F.col("page").alias("pos"), F.expr(f"(n + {PAGE - 1}) div {PAGE}").alias("n"), "digest"), "nodes")
        most = -(-most // PAGE)


@dataclass
class Manifest:
    """Leaves, the layers of all sources' trees, the layers of the tree over them, and the root (None without rows)."""

    leaves: DataFrame
    layers: list[Layer]
    top_layers: list[Layer]
    root: str | None

    def nodes(self) -> DataFrame:
        """All parents: tree, layer, page, level, pos, digest, states before each child."""
        out = None
        for group in (self.layers, self.top_layers):
            for k, layer in enumerate(group):
                rows = layer.parents.where("level > 0").select("tree", F.lit(k).alias("layer"), "page", "level", "pos", "digest", "states")
                out = rows if out is None else out.unionByName(rows)
        return out


def build(docs: DataFrame) -> Manifest:
    """The manifest of documents (doc_id, source, lang, n_chars, text)."""
    rows = chosen(docs, **{c: c for c in ("doc_id", "source", "lang", "n_chars", "text")})
    leaves = written(numbered(_leaves(rows), "doc_id", "digest"), "leaves")
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return Manifest(leaves, [], [], None)
    layers, roots = _layers(leaves.select("tree", "pos", "n", "digest"), most)
    names = roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest", "layer")
    tops = written(numbered(names, "name"), "roots")
    top_layers, top = _layers(tops, tops.agg(F.max("n")).first()[0])
    return Manifest(leaves, layers, top_layers, top.first()["digest"])


def _climb(part: pd.DataFrame):
    """The nodes of a batch of whole pages, level by level, each with its parent and what it hashes with.

    Gives the page numbers of the leaf level and, for each level, the nodes' parents and a function to the siblings:
    (rows, parent, slot, left text, right text, children, state before the slot).
    """
    page, level = _page_numbers(part), part["level"].to_numpy()
    digests, states = part["digest"].to_numpy(), part["states"].to_numpy()
    positions = part["pos"].to_numpy()
    out = []
    rows = np.flatnonzero(level == 0)
    for k in range(PAGE_LEVELS):
        above = np.flatnonzero(level == k + 1)
        if not len(above):
            break
        on = np.isin(page[rows], page[above])
        slot = positions[rows] % RUN
        first = on & (slot == 0)
        parent = np.where(on, np.cumsum(first) - 1, -1)
        texts = digests[rows]
        counts = np.bincount(parent[on])
        begins = np.flatnonzero(first)
        ends = begins + counts
        lefts = ["".join(texts[begins[p]:i]) if p >= 0 else "" for i, p in enumerate(parent)]
        rights = ["".join(texts[i + 1:ends[p]]) if p >= 0 else "" for i, p in enumerate(parent)]
        kept = [states[above[p]][32 * s:32 * s + 32] if p >= 0 else b"" for p, s in zip(parent, slot)]
        out.append({"parent": parent, "left": lefts, "right": rights, "state": kept,
                    "children": np.where(on, counts[np.maximum(parent, 0)], 0)})
        rows = above
    return page, level, out


def _paths_down(levels: list[dict], n_leaves: int, page_of_leaf: np.ndarray, page_paths: dict):
    """For every node of the leaf level: suffix text, steps, rights, counts, from itself to the root of all."""
    chains = []
    for i in range(n_leaves):
        suffix, steps, rights, counts, at = [], [], [], [], i
        for level in levels:
            p = level["parent"][at]
            if p < 0:
                break
            suffix.append(level["left"][at] + level["right"][at])
            steps.append(level["state"][at])
            rights.append(level["right"][at])
            counts.append(int(level["children"][at]))
            at = p
        rest = page_paths[page_of_leaf[i]]
        suffix.append(rest[0])
        steps.append(rest[1])
        rights += list(rest[2])
        counts += [int(c) for c in rest[3]]
        chains.append(("".join(suffix), b"".join(steps), rights, counts))
    return chains


def _split(part: pd.DataFrame) -> dict:
    """The path above each page of a batch: suffix text, steps, right siblings, counts, subroot."""
    page = _page_numbers(part)
    at = np.flatnonzero(part["level"] == -1)
    columns = (part[c].to_numpy()[at] for c in ("suffix", "steps", "rights", "counts", "subroot"))
    above = {g: ("", b"", [], [], None) for g in range(page[-1] + 1)}
    return above | {g: (a, bytes(b), c, d, e) for g, a, b, c, d, e in zip(page[at], *columns)}


def _page_rows(nodes: DataFrame, layer: Layer, paths: DataFrame | None, *payload: str) -> DataFrame:
    """Nodes, parents and path of every page, together and in order."""
    kept = nodes.select("tree", F.expr(f"pos div {PAGE}").alias("page"), F.lit(0).alias("level"), "pos", "digest", *payload)
    down = nodes.sparkSession.createDataFrame([], _PATHS) if paths is None else paths
    down = down.drop("layer").withColumn("level", F.lit(-1)).withColumn("pos", F.lit(-1).cast("long"))
    return _paged(kept.unionByName(layer.parents.where("level > 0").drop("top", "n"), allowMissingColumns=True)
                  .unionByName(down, allowMissingColumns=True))


def _descend(nodes: DataFrame, layer: Layer, paths: DataFrame | None, to_trees: bool) -> DataFrame:
    """Path rows for the pages one layer below, or from the top tree for the trees that it stands on."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_pages(batches):
            above = _split(part)
            page, level, climbed = _climb(part)
            leaf = np.flatnonzero(level == 0)
            chains = _paths_down(climbed, len(leaf), page[leaf], above)
            at = part.iloc[leaf]
            yield pd.DataFrame({
                "tree": at["name"].to_numpy() if to_trees else at["tree"].to_numpy(),
                "page": np.zeros(len(leaf), dtype=np.int64) if to_trees else at["pos"].to_numpy(),
                "layer": at["layer"].to_numpy().astype(np.int32) if to_trees else -1,
                "subroot": at["digest"].to_numpy() if to_trees else [above[g][4] for g in page[leaf]],
                "suffix": [c[0] for c in chains], "steps": [c[1] for c in chains], "rights": [c[2] for c in chains],
                "counts": [c[3] for c in chains]})

    return _page_rows(nodes, layer, paths, *(("name", "layer") if to_trees else ())).mapInPandas(rows, _PATHS)


def _resumed(now: np.ndarray, states: np.ndarray, rights: list[str], counts: np.ndarray) -> np.ndarray:
    """Parents' digests from the states before the replaced children, these children, and their right siblings only."""
    states = sha.take_up(states, now)
    for k in range(RUN - 1):
        who = np.array([i for i, r in enumerate(rights) if len(r) > k * sha.DIGEST_CHARS], dtype=np.int64)
        if len(who):
            chars = slice(k * sha.DIGEST_CHARS, (k + 1) * sha.DIGEST_CHARS)
            states[who] = sha.take_up(states[who], sha.blocks_of([rights[i][chars] for i in who]))
    return sha.finish(states, counts)


def _folding(root: str):
    """Folds every leaf's replacement up to the root of all, and hashes its siblings on the way."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_pages(batches):
            above = _split(part)
            page, level, climbed = _climb(part)
            rows = part.iloc[np.flatnonzero(level == 0)]
            page_of = page[level == 0]
            now, at = sha.blocks_of(rows["changed"]), np.arange(len(rows))
            proofs = [hashlib.sha256() for _ in at]
            for nodes in climbed:
                going = np.flatnonzero(at >= 0)
                going = going[nodes["parent"][at[going]] >= 0]
                mine = at[going]
                if len(mine):
                    now[going] = _resumed(now[going], sha.states_of([nodes["state"][i] for i in mine]),
                                          [nodes["right"][i] for i in mine], nodes["children"][mine])
                for row, i in zip(going, mine):
                    proofs[row].update((nodes["left"][i] + nodes["right"][i]).encode("ascii"))
                at = np.full(len(rows), -1)  # leaves of pages that end here have no place in the next level
                at[going] = nodes["parent"][mine]
            steps = {g: sha.states_of([x[1]]) for g, x in above.items() if x[1]}
            for k in range(max(map(len, steps.values()), default=0)):
                going = np.array([r for r, g in enumerate(page_of) if g in steps and len(steps[g]) > k], dtype=np.int64)
                groups = page_of[going]
                now[going] = _resumed(now[going], np.stack([steps[g][k] for g in groups]), [above[g][2][k] for g in groups],
                                      np.array([above[g][3][k] for g in groups]))
            for proof, g in zip(proofs, page_of):
                proof.update(above[g][0].encode("ascii"))
            folded = sha.texts_of(now)
            yield pd.DataFrame({"doc_id": rows["id_text"].to_numpy(), "leaf": rows["digest"].to_numpy(), "subroot": [above[g][4] for g in page_of],
                                "root": root, "proof_sha256": [p.hexdigest() for p in proofs], "folded_root": folded,
                                "verified": [f == root for f in folded]})

    return fold


def fold(manifest: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root (of its changed text), verified."""
    spark = manifest.leaves.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], _RESULT)
    paths = None
    for k in reversed(range(len(manifest.top_layers))):
        layer = manifest.top_layers[k]
        paths = _descend(layer.nodes, layer, paths, to_trees=k == 0)
    to_trees = written(paths, "paths")
    paths = None
    for k in reversed(range(len(manifest.layers))):
        here = to_trees.where(F.col("layer") == k)
        paths = here if paths is None else paths.unionByName(here)
        if k:
            paths = _descend(manifest.layers[k].nodes, manifest.layers[k], paths, to_trees=False)
    leaves = manifest.leaves.withColumn("id_text", F.col("doc_id").cast("string"))
    rows = _page_rows(leaves, manifest.layers[0], paths, "id_text", "changed").mapInPandas(
        _folding(manifest.root), _RESULT.replace("doc_id long", "doc_id string"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """Builds the manifest and folds every document, as tampered with, back to the root."""
    return fold(build(docs))


#: DuckDB twin of the query.
SQL = """
WITH RECURSIVE
docs AS (
  SELECT doc_id, text, lang, source, n_chars,
    CASE WHEN doc_id IS NOT NULL AND list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) % 2 = 1
      THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM documents),
digests AS (
  SELECT doc_id, source,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS changed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM docs)),
leaves AS (
  SELECT *, coalesce('s' || source, 'n') AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM digests),
up(tree, level, pos, digest) AS (
  SELECT tree, 0, pos, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, level, pos // 3),
subroots AS (
  SELECT tree, max(level) AS height, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos
  FROM up GROUP BY tree),
top(level, pos, digest) AS (
  SELECT 0, pos, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, pos // 3),
nodes AS (
  SELECT up.tree, level, up.pos, digest FROM up JOIN subroots USING (tree) WHERE level < height
  UNION ALL
  SELECT t.tree, t.height + top.level, top.pos, top.digest FROM subroots t, top WHERE top.level > 0
  UNION ALL
  SELECT t.tree, t.height, s.pos, s.subroot FROM subroots t, subroots s WHERE s.tree <> t.tree),
heads AS (SELECT max(level) AS top_height, arg_max(digest, level) AS root FROM top),
steps AS (
  SELECT l.tree, l.pos AS leaf_pos, k.level, g.height, g.pos AS top_pos,
    CASE WHEN k.level < g.height THEN l.pos // (3 ** k.level)::BIGINT ELSE g.pos // (3 ** (k.level - g.height))::BIGINT END AS here
  FROM leaves l JOIN subroots g USING (tree), heads, LATERAL (SELECT unnest(range(0, g.height + top_height)) AS level) k),
siblings AS (
  SELECT s.tree, s.leaf_pos, s.level,
    coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < s.here), '') AS left_side,
    coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > s.here), '') AS right_side
  FROM steps s LEFT JOIN nodes n ON n.tree = s.tree AND n.level = s.level AND n.pos // 3 = s.here // 3
    AND n.pos <> s.here GROUP BY ALL),
proofs AS (
  SELECT tree, leaf_pos, string_agg(left_side || right_side, '' ORDER BY level) AS proof FROM siblings GROUP BY ALL),
folds(tree, pos, level, digest) AS (
  SELECT tree, pos, 0, changed FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(s.left_side || f.digest || s.right_side)
  FROM folds f JOIN siblings s ON s.tree = f.tree AND s.leaf_pos = f.pos AND s.level = f.level),
folded AS (SELECT tree, pos, arg_max(digest, level) AS digest FROM folds GROUP BY ALL)
SELECT l.doc_id, l.leaf, g.subroot, h.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.digest AS folded_root,
  f.digest = h.root AS verified
FROM leaves l JOIN subroots g USING (tree) JOIN folded f ON f.tree = l.tree AND f.pos = l.pos
  LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_pos = l.pos CROSS JOIN heads h
"""
