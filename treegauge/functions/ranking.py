"""Numbering rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def salted_row_number(df: DataFrame, group: list[str], key: str, out: str = "rn") -> DataFrame:
    """1..n within each group, also where one group holds a large part of all rows.

    A group is cut into 256 sub-groups by a hash of `key` (unique within the group); rows are
    numbered inside each sub-group and shifted by the sizes of the sub-groups before it. No task
    sees more than one sub-group, and the shift table has at most 256 rows per group. The order
    is therefore (first two hex digits of md5(key), key).
    """
    salted = df.withColumn("_salt", F.substring(F.md5(F.col(key)), 1, 2))
    cell = [*group, "_salt"]
    sizes = salted.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = salted.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*cell).orderBy(key))
    )
    return (
        local.join(shifts, cell)
        .withColumn(out, F.col("_local") + F.col("_shift"))
        .drop("_salt", "_local", "_shift")
    )
