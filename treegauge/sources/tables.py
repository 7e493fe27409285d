"""Stored tables: parquet partitioned by scan, and CSV export."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from treegauge.functions.text import round_half_up


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system behind a path, and the path as it knows it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if there."""
    fs, hadoop = file_system(spark, path)
    fs.delete(hadoop, True)


def drop_scans(spark: SparkSession, path: str, scans: Iterable[int]) -> None:
    """Removes the stored partitions of these scans; no row is read, and a repeated call does no harm."""
    for scan_id in scans:
        remove(spark, f"{path}/scan_id={scan_id}")


def write_scan_table(table: DataFrame, path: str, mode: str = "overwrite", scans: Iterable[int] | None = None) -> None:
    """Write rows partitioned by scan_id.

    The scans in the table replace their stored rows, so a scan that is written again does not double;
    other scans stay. Mode "append" adds rows to a scan. `scans` names the scans that are written: those without any
    row in the table are emptied (their ids are observed while the rows are written).

    The rebalance hint groups the rows of a scan into few files and lets Spark split a scan that
    is much larger than the rest over many tasks.
    """
    seen = Observation()
    dealt = table.hint("rebalance", "scan_id")
    if scans is not None:  # after the exchange: Spark leaves out all that comes before one without rows
        dealt = dealt.observe(seen, F.collect_set("scan_id").alias("ids"))
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)
    if scans is not None and mode == "overwrite":
        drop_scans(table.sparkSession, path, sorted(set(scans) - set(seen.get["ids"] or ())))


def read_scan_table(
    spark: SparkSession, path: str, scan_id: int | None = None, schema: StructType | None = None
) -> DataFrame:
    """Rows of one scan (only its partition is read), or of all. A table that may have no rows at all needs its schema."""
    table = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return table if scan_id is None else table.where(F.col("scan_id") == scan_id)


def export_csv(leaves: DataFrame, path: str, with_group: bool) -> None:
    """Leaves as CSV with a header, all cells quoted, quotes doubled, values rounded.

    The caller says whether there is a group column, so that no job is needed to look.
    """
    value = round_half_up(F.col("value")).cast("bigint").alias("Value")
    columns = [F.col("label").alias("Label"), value]
    if with_group:
        columns.insert(0, F.coalesce("group", F.lit("")).alias("Group"))
    rows = leaves.select(*columns)
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv_export(spark: SparkSession, path: str, with_group: bool) -> DataFrame:
    """An exported CSV."""
    schema = ("Group string, " if with_group else "") + "Label string, Value bigint"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
