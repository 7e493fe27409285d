"""Derived frames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import fixtures as fx
from treegauge.operators.analyzers import analyze
from treegauge.operators.diff import version_diff
from treegauge.operators.matches import extract_matches
from treegauge.operators.metrics import drop_zero
from treegauge.sources.files import snapshot_changes, spread


# Line items that one task takes at most.
LINES_PER_TASK = 500_000


def line_items(spark, d, *columns) -> DataFrame:
    """Columns of all line items; large splits are dealt out, so that what a task keeps of them by key does not grow with a
    row group."""
    return spread(fx.table(spark, d, "lineitem").select(*columns), LINES_PER_TASK, fill=False)


def snapshot(spark, d) -> DataFrame:
    return snapshot_changes(spread(fx.files_base(spark, d)), fx.RULES, F.lit(1).cast("bigint"))


def snapshot_web(spark, d) -> DataFrame:
    return snapshot_changes(spread(fx.files_web(spark, d)), fx.RULES, F.lit(2).cast("bigint"))


def snapshot_log(spark, d) -> DataFrame:
    return snapshot_changes(spread(fx.files_log(spark, d)), fx.RULES, F.lit(3).cast("bigint"))


def diff(spark, d, renames="exact") -> DataFrame:
    base, target = fx.files_base(spark, d), fx.files_target(spark, d)
    return version_diff(base, target, fx.RULES, F.lit(7).cast("bigint"), renames)


def metrics(changes: DataFrame, analyzers=fx.ANALYZERS) -> DataFrame:
    return drop_zero(analyze(changes, analyzers, fx.RULES))


def matches(changes: DataFrame, unit: str | None = None) -> DataFrame:
    chosen = [a for a in fx.ANALYZERS if unit is None or a.unit == unit]
    return extract_matches(changes, chosen, fx.RULES)


def flat(metrics: DataFrame) -> DataFrame:
    """Metric rows with the two well-known tags as columns."""
    return metrics.select(
        "scan_id", "file_path", "change_type", "old_file_path", "tech_stack", "analyzer_id",
        F.col("tags")["metric"].alias("metric_key"), F.col("tags")["category"].alias("category"),
        "value_before", "value_after",
    )


def wide_ints(df: DataFrame) -> DataFrame:
    """All int columns as bigint."""
    return df.select(*[F.col(n).cast("bigint") if t == "int" else F.col(n) for n, t in df.dtypes])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Named double columns (default: value) to two digits."""
    for n in names or ("value",):
        df = df.withColumn(n, F.round(n, 2))
    return df
