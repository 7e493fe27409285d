"""N-gram Jaccard join by MinHash banding, verified on whole n-gram sets.

1. Texts with the same words are one class (hash of the words); its smallest id stands for it.
2. Every class gets `bands` band hashes of `rows` minhashes each over its word n-grams. At the threshold of
   0.8 a pair shares a band with probability 1 - (1 - 0.8^rows)^bands, see `recall`.
3. Classes are shuffled on band hashes. A bucket is not expanded into pairs: each member is tied to the
   bucket's smallest member, and tied classes form candidate groups. Any two classes that share a band are in
   the same group, so no candidate is lost.
4. Groups are verified on full n-gram sets. A group is dealt into blocks of `block` classes and every two
   blocks meet in one task, which compares the sets of its classes that share a band hash; links are counted in the task
   and only counts and a spanning forest of links leave it. So neither a bucket nor a group of a third of all rows is
   ever held or expanded by one task, and rows in Spark stay far below the number of pairs.
5. Components of the forests are the groups of near copies.

A text with fewer words than n has one n-gram, all its words; a text without words (null, empty) has none
and links with nothing. Links join classes; n_links counts linked classes with other words. Rows with a null id take part
as one more document; ties and repeated rows fall into one class. An id that several texts carry names none of them: their
classes get stand-ins like those without ids. `drop_near_texts` tells rows apart by a hash of all their values. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.llm.common import forget, row_key, unused_name, written
from treegauge.llm.components import components

N = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 6
#: Classes of a group that meet in one task, at most about twice this number.
BLOCK = 512
#: Stand-ins for null ids lie above every real id.
NO_ID = 1 << 62

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that a pair of that similarity shares a band."""
    return 1 - (1 - similarity**rows) ** bands


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607)
    return (draw.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            draw.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32))


def shingles(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all texts in a row, and where each text's begin (one more than texts)."""
    split = [t.encode().lower().split() if t.isascii() else t.lower().encode().split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    flat = np.array(list(itertools.chain.from_iterable(split)) + [None], dtype=object)[:-1]
    codes, kinds = pd.factorize(flat)
    hashed = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in kinds),
                         dtype=np.uint64, count=len(kinds))
    words = hashed[codes]
    grams = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    begins = np.concatenate([[0], np.cumsum(grams)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(begins[-1], dtype=np.uint64)
    if len(words):
        rolled = np.zeros(len(words), dtype=np.uint64)
        for k in range(n):
            shifted = np.zeros(len(words), dtype=np.uint64)
            shifted[: max(len(words) - k, 0)] = words[k:]
            rolled = _mix(rolled * _MULTIPLY + shifted + np.uint64(k))
        place = np.arange(begins[-1]) - np.repeat(begins[:-1], grams) + np.repeat(ends[:-1], grams)
        out = rolled[place]
        for i in np.flatnonzero((sizes < n) & (sizes > 0)):
            out[begins[i]] = int.from_bytes(hashlib.blake2b(b" ".join(split[i]), digest_size=8).digest(), "little")
    return out, begins


def band_hashes(grams: np.ndarray, begins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of non-empty n-gram lists."""
    multiply, add = _permutations(bands * rows)
    low = (_mix(grams) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(begins) - 1, bands), dtype=np.uint64)
    for band in range(bands):
        value = np.full(len(begins) - 1, band + 1, dtype=np.uint64)
        for k in range(band * rows, band * rows + rows):
            smallest = np.minimum.reduceat(low * multiply[k] + add[k], begins[:-1])
            value = _mix(value * _MULTIPLY + smallest)
        out[:, band] = value
    return out


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _signed(n: int, bands: int, rows: int):
    """doc_id, row, hash of the words, band hashes (null without words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for start in range(0, len(part), 500):
                block = part.iloc[start:start + 500]
                texts = [t if isinstance(t, str) else "" for t in block["text"]]
                keys = [_key(t.lower().encode().split()) for t in texts]
                grams, begins = shingles(texts, n)
                full = np.flatnonzero(np.diff(begins) > 0)
                signatures: list = [None] * len(texts)
                if len(full):
                    hashes = band_hashes(grams, np.append(begins[full], begins[-1]), bands, rows).view(np.int64)
                    for i, row in zip(full, hashes):
                        signatures[i] = row
                yield pd.DataFrame({"doc_id": block["doc_id"].to_numpy(), "row": block["row"].to_numpy(), "content": keys, "bands": signatures})

    return run


def _verify(n: int, threshold: float):
    """Verifies the meetings of one task: rows (grp, side, class_id, bands, text) sorted out by group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["grp", "side", "class_id"], ignore_index=True)
        ids, group, side, first, second = (part[c].to_numpy() for c in ("class_id", "grp", "side", "first", "second"))
        grams, begins = shingles(list(part["text"]), n)
        sets = [np.unique(grams[a:b]) for a, b in zip(begins[:-1], begins[1:])]
        sizes = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        codes, kinds = pd.factorize(np.concatenate(sets))
        owner = np.repeat(np.arange(len(ids)), sizes)
        bands = np.stack(part["bands"].to_numpy())
        present = np.zeros(len(kinds), dtype=bool)
        counts, root = np.zeros(len(ids), dtype=np.int64), list(range(len(ids)))
        forest: list[tuple[int, int]] = []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        edges = np.flatnonzero(np.diff(group)) + 1
        for begin, end in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(ids)]])):
            within = first[begin] == second[begin]
            if not within and side[begin] == side[end - 1]:  # the other block is empty
                continue
            middle = begin if within else begin + int(np.searchsorted(side[begin:end], side[end - 1]))
            pool = slice(starts[middle], starts[end])
            pool_codes, pool_owner = codes[pool], owner[pool] - middle
            for i in range(begin, end if within else middle):
                others = np.arange(i + 1 if within else middle, end)
                others = others[(bands[others] == bands[i]).any(axis=1)]
                others = others[np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i])]
                if not len(others):
                    continue
                mine = codes[starts[i]:starts[i + 1]]
                present[mine] = True
                if len(others) * 4 < end - middle:
                    common = np.array([np.count_nonzero(present[codes[starts[j]:starts[j + 1]]]) for j in others])
                else:
                    common = np.bincount(pool_owner[present[pool_codes]], minlength=end - middle)[others - middle]
                present[mine] = False
                linked = others[common >= threshold * (sizes[others] + sizes[i] - common)]
                counts[i] += len(linked)
                counts[linked] += 1
                for j in linked.tolist():
                    a, b = find(int(i)), find(j)
                    if a != b:
                        root[b] = a
                        forest.append((int(ids[i]), int(ids[j])))
        hit = np.flatnonzero(counts)
        return pd.DataFrame({
            "a": np.concatenate([ids[hit], np.array([a for a, _ in forest], dtype=np.int64)]).astype("int64"),
            "b": pd.array([None] * len(hit) + [b for _, b in forest], dtype="Int64"),
            "n": np.concatenate([counts[hit], np.zeros(len(forest), dtype=np.int64)])})

    return run


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(class_id, grp): classes that share a band, directly or through others; classes alone are left out."""
    buckets = classes.select("class_id", F.explode("bands").alias("band"))
    heads = buckets.groupBy("band").agg(F.min("class_id").alias("head"), F.max("class_id").alias("tail")).where("head < tail")
    ties = buckets.join(heads, "band").where("class_id > head").select(F.col("head").alias("a"), F.col("class_id").alias("b"))
    return components(ties).select(F.col("node").alias("class_id"), F.col("component").alias("grp"))


def _meetings(members: DataFrame, block: int, packs: int) -> DataFrame:
    """Members of groups dealt to meetings of two blocks; small groups share a task with others."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    return (
        members.join(sizes, "grp")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("class_id", "grp", F.col("own").alias("side"), F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
                F.when(F.col("blocks") > 1, F.col("grp")).otherwise(-1 - F.pmod(F.xxhash64("grp"), F.lit(packs))).alias("task"))
    )


def join_near_texts(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
                    block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (smallest id with these words), n_links (linked classes), component_id, kept."""
    return _judged(docs, F.lit(None).cast("string"), n, threshold, bands, rows, block, doc_id, text).select(
        "doc_id", "class_id", "n_links", "component_id", "kept")


def drop_near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all columns: one row of each component stays, whatever its id; of rows without words, all that differ."""
    judged = _judged(docs, row_key(docs.columns), N, THRESHOLD, BANDS, ROWS, BLOCK, doc_id, text).where("kept")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    wordless = F.col("group").isNull()
    stays = written(
        judged.where(~wordless).groupBy("group").agg(F.min(place).alias("p")).select(F.col("p.row").alias("_row"))
        .union(judged.where(wordless).select("row").distinct()), "kept")
    key, row = unused_name(docs.columns, "_row_key"), unused_name(docs.columns, "_row")
    keyed = docs.withColumn(key, row_key(docs.columns))
    return keyed.join(stays.toDF(row), F.col(key) == F.col(row), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).dropDuplicates()


def _judged(docs: DataFrame, row: Column, n: int, threshold: float, bands: int, rows: int, block: int, doc_id: str, text: str) -> DataFrame:
    """The columns of `join_near_texts`, `row` and `group`, which names a component and is null without words."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), row.alias("row"))
    signed = written(source.mapInPandas(_signed(n, bands, rows), "doc_id long, row string, content binary, bands array<long>"), "signed")
    source = source.drop("row")
    # an id with several texts names none of them
    shared = written(signed.where("doc_id is not null and bands is not null").groupBy("doc_id")
                     .agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select(F.col("doc_id").alias("s_id")), "shared-ids")
    own_id = F.when(F.col("s_id").isNull(), F.col("doc_id"))
    stand_in = F.lit(NO_ID) + F.pmod(F.xxhash64("content"), F.lit(NO_ID - 1))
    classes = written(
        signed.where("bands is not null").join(shared, F.col("doc_id") == F.col("s_id"), "left").groupBy("content")
        .agg(F.min("doc_id").alias("smallest"), F.min(own_id).alias("own"), F.first("bands").alias("bands"))
        .select("content", "smallest", F.coalesce("own", stand_in).alias("class_id"), F.col("own").isNull().alias("no_id"), "bands"),
        "classes")
    groups = written(candidate_groups(classes), "groups")
    packs = max(1, groups.count() // block)
    texts = source.where("doc_id is not null").join(shared, F.col("doc_id") == F.col("s_id"), "left_anti").select(F.col("doc_id").alias("t_id"), "text")
    loose = source.where("doc_id is null").union(source.join(shared, F.col("doc_id") == F.col("s_id"), "left_semi"))
    nameless = classes.where("no_id").select("content", F.col("class_id").alias("n_id"))
    unnamed = (
        loose.mapInPandas(_keyed, "content binary, text string")
        .groupBy("content").agg(F.first("text").alias("text")).join(nameless, "content").select(F.col("n_id").alias("t_id"), "text")
    )
    wanted = groups.join(classes, "class_id").select("class_id", "grp", "bands")
    carried = wanted.join(texts.union(unnamed), F.col("class_id") == F.col("t_id"))
    carried = written(carried.select("class_id", "grp", "bands", "text").dropDuplicates(["class_id"]), "carried")
    meetings = _meetings(groups, block, packs).join(carried.drop("grp"), "class_id")
    found = written(
        meetings.groupBy("task", "first", "second").applyInPandas(_verify(n, threshold), "a long, b long, n long"), "found")
    links = found.groupBy("a").agg(F.sum("n").alias("n_links")).where("n_links > 0")
    joined = components(found.where("b is not null"))
    forget(carried)
    # the class with the smallest id stands for its component
    heads = (
        joined.join(classes, F.col("node") == F.col("class_id"))
        .groupBy(F.col("component").alias("h_component")).agg(F.min(F.struct(F.col("smallest").isNull(), "smallest", "class_id")).alias("head"))
    )
    named = (
        classes.join(links, F.col("class_id") == F.col("a"), "left")
        .join(joined.join(heads, F.col("component") == F.col("h_component")), F.col("class_id") == F.col("node"), "left")
        .select(F.col("content").alias("c_content"), "smallest", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                F.coalesce("component", "class_id").alias("group"),
                F.when(F.col("head").isNull(), F.col("smallest")).otherwise(F.col("head.smallest")).alias("head_id"),
                (F.col("head").isNull() | (F.col("head.class_id") == F.col("class_id"))).alias("is_head"))
    )
    wordless = F.col("group").isNull()
    return (
        signed.select("doc_id", "row", "content").join(named, F.col("content") == F.col("c_content"), "left")
        .select("doc_id", "row", "group", F.when(wordless, F.col("doc_id")).otherwise(F.col("smallest")).alias("class_id"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.when(wordless, F.col("doc_id")).otherwise(F.col("head_id")).alias("component_id"),
                (wordless | (F.col("is_head") & F.col("doc_id").eqNullSafe(F.col("smallest")))).alias("kept"))
    )


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        words = [t.lower().encode().split() if isinstance(t, str) else [] for t in part["text"]]
        yield pd.DataFrame({"content": [_key(w) for w in words], "text": part["text"].to_numpy()})
