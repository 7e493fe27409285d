"""Helpers of the corpus operators: tables in, intermediate tables in the shared folder, word pattern."""

from __future__ import annotations

import atexit
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.session import shared_path

WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(*frames: DataFrame) -> None:
    """Deletes the files behind frames made by `written` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path is not None:
            _remove(df.sparkSession, path)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the session is gone already: the folder's owner cleans up
        pass


def passing_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what stands there is deleted when the driver ends."""
    path = shared_path(spark, name)
    atexit.register(_at_exit, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: evaluated once, safe from lost executors.

    The table is deleted when the driver ends, or earlier by `forget`.
    """
    spark = df.sparkSession
    path, schema = passing_path(spark, name), df.schema
    df.write.parquet(path)
    del df
    gc.collect()  # frames that are done with let go of their shuffle files once both sides have collected them
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def chosen(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the needed columns under this library's own names, so that no other column can clash."""
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def unused_name(columns: list[str], name: str) -> str:
    """A column name like this one that the table does not have, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(columns: list[str]) -> Column:
    """128 hash bits of all values of a row, as hex digits; nulls count by their place."""
    values = [F.col(f"`{c}`") for c in columns]
    nulls = [v.isNull() for v in values]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(part), *values, *nulls)), 16, "0") for part in "12"])


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
