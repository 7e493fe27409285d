"""File trees as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.operators.classify import classify
from treegauge.operators.diff import CHANGE_COLUMNS
from treegauge.specs import SNAPSHOT, ScanRules


def decode_content(raw: Column) -> Column:
    """Bytes as text; NULL for binary files (a NUL byte anywhere) and for invalid UTF-8."""
    binary = F.contains(raw, F.lit(bytearray(b"\x00")))
    return F.when(~binary, F.try_validate_utf8(raw.cast("string")))


def decode_files(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Files with text content and a content_hash taken from the bytes."""
    return files.select(
        "project",
        "version",
        "file_path",
        decode_content(F.col(raw)).alias("content"),
        F.md5(raw).alias("content_hash"),
    )


def read_tree(spark: SparkSession, root: str, project: str, version: str) -> DataFrame:
    """A directory tree as a files table; paths are relative to the root, however that is written."""
    context = spark.sparkContext
    given = context._jvm.org.apache.hadoop.fs.Path(root)
    qualified = given.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(given).toString()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    prefix = re.sub("^[a-z0-9]+:/*", "/", qualified).rstrip("/") + "/"
    relative = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(
        F.raise_error(F.concat(path, F.lit(f" is not below {prefix}"))))
    return decode_files(
        rows.select(
            F.lit(project).alias("project"),
            F.lit(version).alias("version"),
            relative.alias("file_path"),
            F.col("content").alias("raw"),
        )
    )


# Rows that one task takes at most, unless the caller says otherwise.
ROWS_PER_TASK = 100_000


def spread(files: DataFrame, rows: int = ROWS_PER_TASK, fill: bool = True) -> DataFrame:
    """The files dealt out evenly, where a split of the scan holds more than `rows` or (`fill`) fewer splits hold any than
    there are cores.

    Analysis is bound by CPU, and a split is as large as a row group of the stored table, however many rows that is. So the
    rows of each split are counted (from the footers, no column is read), and the number of parts grows with the table.
    A table whose splits are many and small enough is returned as it is: its content is not shuffled. Meant for frames
    that only scan and project; behind a join or aggregate, counting would run it.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    splits = files.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    busy, largest, total = splits.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    if not busy or largest <= rows and (busy >= cores or not fill):
        return files
    return files.repartition(max(cores, -(-total // rows)), F.monotonically_increasing_id())


def snapshot_changes(files: DataFrame, rules: ScanRules, scan_id: int | Column) -> DataFrame:
    """Every kept file of one version as a file change of type 'A'. Undecodable files stay, with
    NULL content."""
    none = F.lit(None).cast("string")
    return (
        classify(files, rules)
        .withColumn("scan_id", F.lit(scan_id) if isinstance(scan_id, int) else scan_id)
        .withColumn("scan_mode", F.lit(SNAPSHOT))
        .withColumn("change_type", F.lit("A"))
        .withColumn("old_file_path", none)
        .withColumn("old_content", none)
        .select(*CHANGE_COLUMNS)
    )
