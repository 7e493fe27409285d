"""Embedding near-dedup over a robust-pruned flat graph.

1. Vectors with one label and equal components are one class; its smallest id stands for it. An id that several
   different vectors bear names none of them inside: such a class goes by a hash of its content, below all ids.
2. Centroids are fitted on a bounded sample (`SAMPLE` vectors, `MAX_CLUSTERS` centroids at most). Each
   vector belongs to its two nearest clusters, so neighbouring clusters overlap. A shard is a label and a cluster;
   shards above `SHARD` vectors are dealt into parts by hash, so hot labels and groups of copies stay bounded per task.
3. A robust-pruned graph is built on every part; the adjacency lists that a vector got in its shards are united.
4. Range search: in every two parts of a shard (and every part with itself) all members search the united
   graph from its medoid and, where they are nodes of it, from themselves; nodes in range are expanded until none is left.
   Similarities are in double precision, so every link found is verified. A pair that shares both
   shards counts in the first one only. Links are counted in the task; counts and a spanning forest leave it, never pairs.
5. Components of the forests are the groups of near copies.

`audit_recall` compares link counts with brute force for a bounded set of queries; `audited_vectors`, which the query
returns, adds its figure as a column and fails below `LEAST_RECALL`.

Null, zero, and non-finite vectors and null labels link with nothing, as do rows with a null id (no component; kept).
Vectors of different length never link. Repeated rows are one vector and give repeated results. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegauge.llm.common import chosen, forget, written
from treegauge.llm.components import components
from treegauge.llm.flat_graph import build, medoid, search

THRESHOLD = 0.93
SAMPLE = 16_384
MAX_CLUSTERS = 256
SHARD = 1024
LEAST_RECALL = 0.9
#: Ids of classes that go by their content lie below this.
NO_ID = -(1 << 62)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        units, keys, sizes = [], [], []
        for label, id_, values in zip(part["label"], part["vec_id"], part["embedding"]):
            x = None
            if values is not None and not pd.isna(label) and not pd.isna(id_):
                x = np.array([np.nan if v is None else v for v in values], dtype=np.float64)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    x = None
            if x is None:
                units.append(None), keys.append(None), sizes.append(0)
                continue
            keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
            x = x / np.abs(x).max()
            units.append(x / np.sqrt(x @ x)), sizes.append(len(x))
        yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "label": part["label"].to_numpy(), "content": keys,
                            "size": np.array(sizes, dtype="int32"), "unit": units})


def fit_centroids(classes: DataFrame, sample: int, most: int, shard: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, from a bounded sample; as many as the largest label has shards, `most` at most."""
    sizes = classes.groupBy("label", "size").agg(F.count("*").alias("n")).groupBy("size").agg(F.max("n").alias("n"))
    wanted = {r["size"]: min(most, max(1, -(-r["n"] // shard))) for r in sizes.orderBy(F.col("n").desc()).limit(16).collect()}
    drawn = classes.orderBy(F.xxhash64("content"), "class_id").limit(sample).select("size", "unit").toPandas()
    out = {}
    for size, k in wanted.items():
        rows = drawn[drawn["size"] == size]["unit"]
        if k < 2 or len(rows) < 2 * k:
            continue
        x = np.stack(rows.to_numpy())
        centroids = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
        for _ in range(12):
            nearest = (x @ centroids.T).argmax(axis=1)
            for c in range(k):
                mean = x[nearest == c].sum(axis=0)
                if np.abs(mean).max(initial=0) > 1e-9:
                    centroids[c] = mean / np.linalg.norm(mean)
        out[int(size)] = centroids
    return out


def _assign(centroids: dict[int, np.ndarray]):
    """Rows of a class in its two nearest clusters; `twin` is the other one (-1: none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for size, rows in part.groupby("size"):
                known = centroids.get(int(size))
                if known is None:
                    yield rows.assign(cluster=np.int32(0), twin=np.int32(-1))
                    continue
                near = np.argsort(-(np.stack(rows["unit"].to_numpy()) @ known.T), axis=1)[:, :2].astype("int32")
                yield rows.assign(cluster=near[:, 0], twin=near[:, 1])
                yield rows.assign(cluster=near[:, 1], twin=near[:, 0])

    return run


def _build(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("shuffle", ignore_index=True)
    ids = part["class_id"].to_numpy()
    graph = build(np.stack(part["unit"].to_numpy()))
    return pd.DataFrame({"class_id": ids, "label": part["label"].to_numpy(),
                         "near": [ids[row[row >= 0]] for row in graph]})


def _united(lists: pd.Series, ids: np.ndarray) -> np.ndarray:
    """United adjacency lists as positions in the sorted ids, -1 padded; neighbours in other parts fall out."""
    rows = []
    for row in lists:
        row = np.asarray(row)
        at = np.minimum(np.searchsorted(ids, row), len(ids) - 1)
        rows.append(at[ids[at] == row])
    out = np.full((len(rows), max(1, max(map(len, rows)))), -1, dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _meet(threshold: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["side", "class_id"], ignore_index=True)
        within = part["first"].iloc[0] == part["second"].iloc[0]
        sides = [rows for _, rows in part.groupby("side")]
        nothing = pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        if not within and len(sides) < 2:
            return nothing
        left, right = sides[0], sides[-1]

        def found(queries: pd.DataFrame, nodes: pd.DataFrame) -> np.ndarray:
            x, ids = np.stack(nodes["unit"].to_numpy()), nodes["class_id"].to_numpy()
            graph = _united(nodes["near"], ids)
            hits = np.zeros((len(queries), len(nodes)), dtype=bool)
            start = medoid(x)
            for begin in range(0, len(queries), 512):
                q = np.stack(queries["unit"].iloc[begin:begin + 512].to_numpy())
                entries = np.full((len(q), 2), start)
                if within:
                    entries[:, 1] = np.arange(begin, begin + len(q))
                hits[begin:begin + len(q)] = search(x, graph, q, entries, reach=threshold) >= threshold
            return hits

        hits = found(left, right)
        hits |= hits.T if within else found(right, left).T
        ids_a, ids_b = left["class_id"].to_numpy(), right["class_id"].to_numpy()
        shard = part["cluster"].iloc[0]
        twin_a, twin_b = left["twin"].to_numpy()[:, None], right["twin"].to_numpy()[None, :]
        hits &= ~((twin_a == twin_b) & (twin_a >= 0) & (twin_a < shard))  # both shards shared: the first one counts
        if within:
            np.fill_diagonal(hits, False)
        weight_a, weight_b = left["copies"].to_numpy(), right["copies"].to_numpy()
        counts = [(ids_a, hits @ weight_b)] + ([] if within else [(ids_b, weight_a @ hits)])
        forest = _forest(hits, ids_a, ids_b)
        a = np.concatenate([ids[n > 0] for ids, n in counts] + [forest[0]])
        n = np.concatenate([n[n > 0] for _, n in counts] + [np.zeros(len(forest[0]))])
        b = pd.array([None] * (len(a) - len(forest[1])) + forest[1].tolist(), dtype="Int64")
        return pd.DataFrame({"a": a.astype("int64"), "b": b, "n": n.astype("int64")})

    return run


def _forest(hits: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the hits connect, one fewer than nodes at most."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i in np.flatnonzero(hits.any(axis=1)):
        for j in np.flatnonzero(hits[i]):
            a, b = find(int(ids_a[i])), find(int(ids_b[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append((int(ids_a[i]), int(ids_b[j])))
    pairs = np.array(kept, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, max_clusters: int = MAX_CLUSTERS,
                 shard: int = SHARD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id, kept."""
    source = chosen(vectors, vec_id=vec_id, label=label, embedding=embedding).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    read = written(source.mapInPandas(_read, "vec_id long, label string, content binary, size int, unit array<double>"), "vectors")
    members = read.where("unit is not null").dropDuplicates(["vec_id", "label", "content"])
    found = members.groupBy("label", "content").agg(
        F.min("vec_id").alias("smallest"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("unit").alias("unit"))
    shared = written(found.groupBy("smallest").count().where("count > 1").select(F.col("smallest").alias("shared")), "shared-ids")
    stand_in = F.lit(NO_ID) - F.pmod(F.xxhash64("label", "content"), F.lit(1 << 61))
    classes = written(
        found.join(shared, F.col("smallest") == F.col("shared"), "left")
        .withColumn("class_id", F.when(F.col("shared").isNull(), F.col("smallest")).otherwise(stand_in)).drop("shared"), "classes")
    centroids = fit_centroids(classes, sample, max_clusters, shard)
    columns = "class_id long, label string, copies long, size int, unit array<double>, cluster int, twin int"
    placed = written(classes.select("class_id", "label", "copies", "size", "unit").mapInPandas(_assign(centroids), columns), "placed")
    key = ["label", "size", "cluster"]
    parts = placed.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.ceil(F.col("n") / shard).cast("int").alias("parts"))
    dealt = placed.join(parts, key).withColumn("side", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    lists = (
        dealt.select(*key, "side", "class_id", "unit", F.xxhash64("class_id", F.lit("order")).alias("shuffle"))
        .groupBy(*key, "side").applyInPandas(_build, "class_id long, label string, near array<long>")
    )
    united = written(lists.groupBy("label", "class_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    meetings = (
        dealt.join(united, ["label", "class_id"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*key, F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second"),
                "side", "class_id", "copies", "twin", "unit", "near")
    )
    met = written(meetings.groupBy(*key, "first", "second").applyInPandas(_meet(threshold), "a long, b long, n long"), "met")
    links = met.groupBy("a").agg(F.sum("n").alias("n")).where("n > 0")
    joined = components(met.where("b is not null"))
    heads = (
        joined.join(classes.select("class_id", "smallest"), F.col("node") == F.col("class_id"))
        .groupBy(F.col("component").alias("head_of")).agg(F.min("smallest").alias("head"))
    )
    named = (
        classes.select(F.col("label").alias("c_label"), F.col("content").alias("c_content"), "class_id", "smallest", "copies")
        .join(links, F.col("class_id") == F.col("a"), "left")
        .join(joined.join(heads, F.col("component") == F.col("head_of")), F.col("class_id") == F.col("node"), "left")
        .select("c_label", "c_content", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("head", "smallest").alias("component"))
    )
    forget(placed)
    component = F.coalesce("component", "vec_id")
    return (
        read.select("vec_id", "label", "content")
        .join(named, (F.col("label") == F.col("c_label")) & (F.col("content") == F.col("c_content")), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                (component.isNull() | (component == F.col("vec_id"))).alias("kept"))
    )


def audited_vectors(vectors: DataFrame, **parameters) -> DataFrame:
    """`near_vectors` and a column `recall`: the share of links that brute force finds for a bounded set of queries (null: they
    have none). A share below `LEAST_RECALL` fails."""
    result = written(near_vectors(vectors, **parameters), "near")
    names = {k: v for k, v in parameters.items() if k in ("threshold", "vec_id", "embedding", "label")}
    recall = audit_recall(vectors, result, **names)
    if recall is not None and recall < LEAST_RECALL:
        raise ValueError(f"recall {recall:.3f} is below {LEAST_RECALL}: use larger samples or more clusters")
    return result.withColumn("recall", F.lit(recall).cast("double"))


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = THRESHOLD, queries: int = 256, vec_id: str = "vec_id",
                 embedding: str = "embedding", label: str = "label") -> float | None:
    """Links found over links there are, for `queries` vectors compared with all rows by brute force (null: no links)."""
    source = chosen(vectors, vec_id=vec_id, label=label, embedding=embedding).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    read = source.mapInPandas(_read, "vec_id long, label string, content binary, size int, unit array<double>").where("unit is not null")
    drawn = read.orderBy(F.xxhash64("vec_id")).limit(queries).select("vec_id", "label", "size", "unit").toPandas().drop_duplicates("vec_id")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for (name, size), rows in part.groupby(["label", "size"]):
                mine = drawn[(drawn["label"] == name) & (drawn["size"] == size)]
                if len(mine):
                    near = np.stack(mine["unit"].to_numpy()) @ np.stack(rows["unit"].to_numpy()).T >= threshold
                    near &= mine["vec_id"].to_numpy()[:, None] != rows["vec_id"].to_numpy()[None, :]
                    yield pd.DataFrame({"q": mine["vec_id"].to_numpy(), "n": near.sum(axis=1)})

    true = read.dropDuplicates(["vec_id"]).mapInPandas(exact, "q long, n long").groupBy("q").agg(F.sum("n").alias("there"))
    both = true.join(result.dropDuplicates(["vec_id"]), F.col("q") == F.col("vec_id"))
    row = both.agg(F.sum(F.least("n_links", "there")).alias("found"), F.sum("there").alias("there")).first()
    return row["found"] / row["there"] if row["there"] else None
