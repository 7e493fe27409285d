"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every source is a queue of its documents in shuffled order. A document's virtual finish time is the
number of words its source has given out once the document is through, divided by the source's target:
all sources that keep pace with their targets have the same virtual time. All documents are then put
in the order of virtual time and the order is cut where the budget is full. A source whose target is
above its size goes through its queue again, up to `max_repeats` times.

No source is ordered in one task: running totals are taken inside hash ranges of a source and shifted
by the totals of the ranges before (`RANGES` a source at most); the cut is found in the totals of
virtual-time ranges and then inside one range.

Null text and empty text have size 0 and are never taken. A null source is a source of its own, the
last in order. The shuffle goes by a hash of id and text, so null and repeated ids are spread over
the ranges like others; rows equal in both stand together. Equal rows are told apart by their place in the
queue only, so the result is the same set of rows on every run. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treegauge.llm.common import row_key, unused_name, word_count, written

#: Hash ranges of a source, and virtual-time ranges up to virtual time 1.
RANGES = 4096
WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, share: float, max_repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """A row a source: position, size and target in words.

    Targets are min(max_repeats * size, level * weight) with the one level at which they sum to
    share * all sizes; that is where passing the excess on by weight ends. One row a source is all that
    meets in a task here.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = Window.orderBy("fill", "position").rowsBetween(Window.unboundedPreceding, -1)
    choice = F.array(*[F.lit(w) for w in weights])
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = (
        sums.withColumn("position", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(choice, F.col("position") % len(weights) + 1))
        .withColumn("most", max_repeats * F.col("source_size"))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("level", level)
    )
    shared = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything)
    target = F.least(F.col("most").cast("double"), F.coalesce(shared, F.lit(float("inf"))) * F.col("weight"))
    return filled.select("source", "position", "source_size", target.alias("target"))


def _queued(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with `done`: words of their source up to and including them, in shuffled order."""
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("source").alias("r_source"), F.col("range").alias("r_range"),
        F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"),
    )
    inside = (Window.partitionBy("source", "range").orderBy("shuffle", "doc_id", "size", "row")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queue = (
        sized.withColumn("within", F.sum("size").over(inside))
        .join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
        .withColumn("done", F.col("range_start") + F.col("within"))
    )
    renamed = targets.withColumnRenamed("source", "t_source")
    return queue.join(renamed, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "row", "size", "position", "source_size", "target", "done")


def _finish(turn: int) -> Column:
    return (F.col("done") + turn * F.col("source_size")) / F.col("target")


def _time_range(finish: Column) -> Column:
    return F.least(F.floor(finish * RANGES), F.lit(2 * RANGES)).cast("int")


def _cut(queue: DataFrame, max_repeats: int, budget: float):
    """The last place in the order of virtual time that the budget holds: (range, finish, position, done)."""
    copies = (
        queue.where("size > 0 and target > 0")
        .select("size", "position", F.posexplode(F.array(*[_finish(t) for t in range(max_repeats)])).alias("turn", "finish"),
                (F.col("done") + F.col("turn") * F.col("source_size")).alias("given"))
        .withColumn("range", _time_range(F.col("finish")))
    )
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    full = totals.where(F.col("upto") > budget).orderBy("range").limit(1).first()
    if full is None:
        return None
    inside = (Window.orderBy("finish", "position", "given")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = (
        copies.where(F.col("range") == full["range"])
        .withColumn("upto", F.sum("size").over(inside) + (full["upto"] - full["words"]))
        .where(F.col("upto") <= budget)
        .agg(F.max(F.struct("finish", "position", "given")).alias("last"))
        .first()["last"]
    )
    return full["range"], last


def mix_sources(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS,
                seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted)."""
    return _mixed(docs, F.lit(None).cast("string"), share, max_repeats, weights, seed, doc_id, source, text).drop("row")


def mixed_rows(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS,
               seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with all columns: every row as often as the mix takes that very row.

    Rows go by a hash of all their values. Rows equal in every column are one for that: written as often as all of them are taken.
    """
    queue = _mixed(docs, row_key(docs.columns), share, max_repeats, weights, seed, doc_id, source, text)
    key, row, n, equal, turn = (unused_name(docs.columns, name) for name in ("_row_key", "_taken_row", "_times", "_equal", "_time"))
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    taken = written(queue.groupBy(F.col("row").alias(row)).agg(F.sum(times).cast("int").alias(n), F.count("*").alias(equal))
                    .where(F.col(n) > 0), "mix-taken")
    joined = docs.withColumn(key, row_key(docs.columns)).join(taken, F.col(key) == F.col(row)).drop(key, row)
    if not taken.where(F.col(equal) > 1).isEmpty():
        joined = joined.where(F.col(equal) == 1).union(joined.where(F.col(equal) > 1).dropDuplicates())
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _mixed(docs: DataFrame, row: Column, share: float, max_repeats: int, weights: tuple[int, ...], seed: str, doc_id: str, source: str,
           text: str) -> DataFrame:
    """The columns of `mix_sources` and `row`, which travels with its row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"), row.alias("row"))
    shuffle = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                             F.md5(F.coalesce("text", F.lit("")))))
    sized = written(
        rows.select("doc_id", "source", "row", word_count(F.col("text")).alias("size"), shuffle.alias("shuffle"))
        .withColumn("range", F.conv(F.substring("shuffle", 1, 3), 16, 10).cast("int")),
        "mix-sizes")
    targets = written(source_targets(sized, share, max_repeats, weights), "mix-targets")
    queue = written(_queued(sized, targets), "mix-queue")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    cut = _cut(queue, max_repeats, share * total)
    taken = F.lit(0).cast("bigint")
    for turn in range(max_repeats):
        finish, given = _finish(turn), F.col("done") + turn * F.col("source_size")
        if cut is None:
            inside = F.lit(True)
        else:
            inside = _time_range(finish) < cut[0]
            if cut[1] is not None:
                place = F.struct(finish.alias("finish"), F.col("position").alias("position"), given.alias("given"))
                end = F.struct(*[F.lit(v).cast(t) for v, t in zip(cut[1], ("double", "int", "bigint"))])
                inside = inside | ((_time_range(finish) == cut[0]) & (place <= end))
        usable = (F.col("size") > 0) & (F.col("target") > 0)
        taken = taken + F.when(usable, F.when(inside, F.col("size")).otherwise(0)).otherwise(0)
    return queue.select("doc_id", "row", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS shuffle FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM sums),
weighed AS (SELECT *, CASE position % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM placed),
filled AS (SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS fill FROM weighed),
leveled AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
    - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY fill, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM filled),
targets AS (SELECT source, position, source_size,
    least(CAST(2 * source_size AS DOUBLE), (SELECT max(level) FROM leveled WHERE level <= fill) * weight) AS target FROM leveled),
queue AS (SELECT s.doc_id, s.size, s.shuffle, t.position, t.source_size, t.target,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.shuffle, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT q.*, e.turn, CAST(done + e.turn * source_size AS DOUBLE) / target AS finish, done + e.turn * source_size AS given
  FROM queue q, (VALUES (0), (1)) e(turn) WHERE size > 0 AND target > 0),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, position, given ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
mixed AS (SELECT position, done, sum(size) AS taken FROM ordered
  WHERE upto <= 1.5 * (SELECT sum(size) FROM sized) GROUP BY position, done)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(m.taken, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN mixed m ON q.position = m.position AND q.done = m.done AND q.size > 0
"""
