"""The metric table: suppression, tag keys, merging of user results, summaries."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treegauge.functions.tags import parse_tags, tags_key
from treegauge.operators.analyzers import METRIC_COLUMNS, is_selectable, runs_on
from treegauge.specs import Analyzer, ScanRules, registry


def drop_zero(metrics: DataFrame) -> DataFrame:
    """Without the rows whose values are both zero or NULL."""
    zero = F.lit(0.0)
    return metrics.where(
        (F.coalesce("value_before", zero) != 0) | (F.coalesce("value_after", zero) != 0)
    )


def tag_keys(metrics: DataFrame) -> DataFrame:
    """Distinct tag keys per scan."""
    return metrics.select("scan_id", F.explode(F.map_keys("tags")).alias("tag_key")).distinct()


def changed_files(metrics: DataFrame) -> DataFrame:
    """Distinct changed files per scan."""
    return metrics.select("scan_id", "file_path", "change_type").distinct()


def merge_before_after(entries: DataFrame) -> DataFrame:
    """Metric rows from one-sided entries (`side`, `seq`, `value`).

    Entries of a file with equal analyzer, tags and scope make one row; on each side the entry
    emitted last counts. One file bounds a group, and the last-wins aggregate combines map-side. It keeps numbers only, and
    the tags come back out of their key, so Spark hashes the entries and sorts none.
    """
    keys = ["scan_id", "file_path", "change_type", "old_file_path", "tech_stack", "analyzer_id"]
    last = {
        side: F.max_by("value", F.when(F.col("side") == side, F.col("seq")))
        for side in ("before", "after")
    }
    return (
        entries.withColumn("_tags_key", tags_key(F.col("tags")))
        .groupBy(*keys, "_tags_key", "scope")
        .agg(
            last["before"].alias("value_before"),
            last["after"].alias("value_after"),
        )
        .withColumn("tags", parse_tags(F.col("_tags_key")))
        .select(*METRIC_COLUMNS)
    )


def analyzer_runs(
    file_changes: DataFrame, analyzers: Iterable[Analyzer], rules: ScanRules
) -> DataFrame:
    """Runs per scan and analyzer, 0 for those that never ran, with the scan's number of files.

    One pass with a conditional sum per analyzer (the list is part of the configuration), turned
    into rows after the aggregation.
    """
    specs = registry(analyzers)
    sums = []
    for i, analyzer in enumerate(specs.values()):
        runs = F.lit(0).cast("bigint")
        if is_selectable(analyzer, rules):
            sides = [F.col(c).isNotNull().cast("bigint") for c in ("content", "old_content")]
            runs = F.when(runs_on(analyzer, rules), reduce(add, sides)).otherwise(runs)
        sums.append(F.sum(runs).alias(f"_n{i}"))
    per_scan = file_changes.groupBy("scan_id").agg(F.count("*").alias("total_files"), *sums)
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("analyzer_id"), F.col(f"_n{i}").alias("files_analyzed"))
            for i, a in enumerate(specs)
        ]
    )
    return per_scan.select("scan_id", "total_files", F.inline(rows))


def analyzer_stats(runs: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Runs and errors per scan and analyzer. `errors` has one row per failed run
    (scan_id, analyzer_id, error); a failed run does not count as analyzed."""
    none = F.lit(0).cast("bigint")
    if errors is None:
        return runs.withColumn("execution_errors", none)
    failed = errors.groupBy("scan_id", "analyzer_id").agg(F.count("*").alias("_failed"))
    counted = runs.join(failed, ["scan_id", "analyzer_id"], "left")
    return (
        counted.withColumn("execution_errors", F.coalesce("_failed", none))
        .withColumn("files_analyzed", F.col("files_analyzed") - F.col("execution_errors"))
        .drop("_failed")
    )


def _totals() -> list[Column]:
    return [
        F.max("total_files").alias("total_files_scanned"),
        F.count("*").alias("total_analyzers_loaded"),
        F.count_if(F.col("files_analyzed") > 0).alias("total_analyzers_executed"),
        F.sum("files_analyzed").alias("total_analyzer_executions"),
        F.sum("execution_errors").alias("total_errors"),
    ]


def scan_summary(stats: DataFrame) -> DataFrame:
    """One row per scan: files, analyzers loaded and run, runs, errors."""
    return stats.groupBy("scan_id").agg(*_totals())


# Error texts of an analyzer that a summary quotes; the error table has them all.
QUOTED_ERRORS = 1_000


def quoted_errors(errors: DataFrame, most: int | None = QUOTED_ERRORS) -> DataFrame:
    """The first texts by scan and analyzer, in order, as `error_details`: each task keeps that many before the shuffle.
    None takes all texts."""
    first = errors.select("scan_id", "analyzer_id", "error")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("scan_id", "analyzer_id").orderBy("error"))
        first = first.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return first.groupBy("scan_id", "analyzer_id").agg(F.sort_array(F.collect_list("error")).alias("error_details"))


def all_error_details(stats: DataFrame, errors: DataFrame) -> DataFrame:
    """Stored analyzer stats (`scan_id` and the columns of `STATS_TYPE`) with every error text, in order.

    An analyzer with more errors than its summary quotes takes all its texts from the error table; the others keep theirs.
    """
    keys = ["scan_id", "analyzer_id"]
    quoted = F.coalesce(F.size("error_details"), F.lit(0))
    cut = stats.where(F.col("execution_errors") > quoted).select(*keys)
    whole = quoted_errors(errors.join(cut, keys, "left_semi"), None).withColumnRenamed("error_details", "_all")
    return stats.join(whole, keys, "left").withColumn("error_details", F.coalesce("_all", "error_details")).drop("_all")


def summary_record(stats: DataFrame, load_errors: Iterable[str] = (), errors: DataFrame | None = None) -> DataFrame:
    """Summary rows in stored form, with the analyzer list as JSON text.

    The list has one element per configured analyzer. With an error table, its texts stand with their analyzer, the
    first `QUOTED_ERRORS` of them: a row stays bounded, `execution_errors` tells whether there are more, and
    `all_error_details` puts these back from the error table.
    """
    details = F.array().cast("array<string>")
    if errors is not None:
        stats = stats.join(quoted_errors(errors), ["scan_id", "analyzer_id"], "left")
        details = F.coalesce("error_details", details)
    entry = F.struct("analyzer_id", "files_analyzed", "execution_errors", details.alias("error_details"))
    lists = F.to_json(F.sort_array(F.collect_list(entry))).alias("analyzer_stats")
    texts = F.to_json(F.array(*[F.lit(e) for e in load_errors]).cast("array<string>"))
    return stats.groupBy("scan_id").agg(*_totals(), lists).withColumn("load_errors", texts)


STATS_TYPE = (
    "array<struct<analyzer_id:string,files_analyzed:bigint,execution_errors:bigint,"
    "error_details:array<string>>>"
)


def read_summary(records: DataFrame) -> DataFrame:
    """Stored summaries with their JSON text as typed lists; text that is no valid list is empty."""

    def typed(name: str, array_type: str):
        parsed = F.when(F.ltrim(F.col(name)).startswith("["), F.from_json(name, array_type))
        return F.coalesce(parsed, F.array().cast(array_type))

    return records.withColumn("load_errors", typed("load_errors", "array<string>")).withColumn(
        "analyzer_stats", typed("analyzer_stats", STATS_TYPE)
    )
