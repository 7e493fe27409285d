"""View results as tables ready to chart or to list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.functions.paths import file_name
from treegauge.functions.text import compiles, round_half_up
from treegauge.operators.views import deepest, group_key


def _or_unknown(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("Unknown"))


def _names(levels: DataFrame) -> list[str]:
    return [c for c in levels.columns if c.startswith("k") and c[1:].isdigit()]


def flatten_levels(levels: DataFrame) -> DataFrame:
    """The deepest groups, labelled 'A/B'."""
    label = F.concat_ws("/", *_names(levels))
    return deepest(levels).select("scan_id", label.alias("label"), "value")


def flatten_change_type(levels: DataFrame) -> DataFrame:
    """The deepest groups of a tree whose last key is change_type, labelled 'A:B(change type)'."""
    *outer, change = _names(levels)
    label = F.col(change)
    if outer:
        label = F.concat(F.concat_ws(":", *outer), F.lit("("), label, F.lit(")"))
    return deepest(levels).select("scan_id", label.alias("label"), "value")


def leaves(items: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Items with a group label 'k1:k2(change type)' of the keys they have; none gives NULL."""
    keys = list(keys)
    known = [group_key(k, "label") for k in keys if k != "change_type" and not k.startswith("tag:")]
    parts = F.concat_ws(":", *[F.when(c != "", c) for c in known])
    group = F.when(parts != "", parts)
    if "change_type" in keys:
        change = F.concat(F.lit("("), F.col("change_type"), F.lit(")"))
        group = F.when(
            F.col("change_type").isNotNull(), F.concat(F.coalesce(group, F.lit("")), change)
        ).otherwise(group)
    return items.select(
        "scan_id", "label", round_half_up(F.col("value")).alias("value"), group.alias("group")
    )


def search_leaves(
    leaves: DataFrame, query: str, *, regex: bool = False, case_sensitive: bool = False
) -> DataFrame:
    """Leaves whose label or group holds the text, or matches the regex. A blank query or an
    invalid regex keeps all."""
    if not query.strip():
        return leaves
    if regex:
        pattern = ("(?U)" if case_sensitive else "(?iU)") + query
        if not compiles(pattern):
            return leaves
        hits = [F.col(c).rlike(pattern) for c in ("label", "group")]
    elif case_sensitive:
        hits = [F.contains(F.col(c), F.lit(query)) for c in ("label", "group")]
    else:
        text = F.lit(query.lower())
        hits = [F.contains(F.lower(F.col(c)), text) for c in ("label", "group")]
    return leaves.where(hits[0] | F.coalesce(hits[1], F.lit(False)))


def card_total(rows: DataFrame) -> DataFrame:
    """Sum of a view's top rows per scan. Of a tree only the first level counts."""
    if "depth" in rows.columns:
        rows = rows.where("depth = 1")
    return rows.groupBy("scan_id").agg(F.sum("value").alias("value"))


def share(rows: DataFrame) -> DataFrame:
    """Rows with their fraction of the scan's total. The totals have one row per scan."""
    totals = rows.groupBy("scan_id").agg(F.sum("value").alias("_total"))
    fraction = F.col("value") / F.when(F.col("_total") != 0, F.col("_total"))
    return rows.join(totals, "scan_id").withColumn("share", fraction).drop("_total")


def max_value(rows: DataFrame) -> DataFrame:
    """Upper end of a value scale per scan, at least 1."""
    top = F.greatest(F.max("value"), F.lit(1.0))
    return rows.groupBy("scan_id").agg(top.alias("max_value"))


def label_sets(rows: DataFrame) -> DataFrame:
    """Distinct (axis, name) of a view: its labels, stacks and categories."""
    axes = F.array(
        F.struct(F.lit("label").alias("axis"), F.col("label").alias("name")),
        F.struct(F.lit("tech_stack").alias("axis"), _or_unknown("tech_stack").alias("name")),
        F.struct(F.lit("category").alias("axis"), _or_unknown("category").alias("name")),
    )
    return rows.select("scan_id", F.inline(axes)).distinct()


def heatmap(rows: DataFrame) -> DataFrame:
    """Cells of a tech_stack x category grid, rounded. Sums are cut to six digits first, so that
    the order of addition cannot move a half to the other side."""
    return (
        rows.groupBy(
            "scan_id",
            _or_unknown("tech_stack").alias("tech_stack"),
            _or_unknown("category").alias("category"),
        )
        .agg(F.round(F.sum("value"), 6).alias("value"))
        .withColumn("value", round_half_up(F.col("value")))
    )


def stacked(
    rows: DataFrame, categories: Iterable[str] | None = None, ascending: bool = False
) -> DataFrame:
    """Series of a stacked chart: one value per label and category, rounded.

    Of several rows in a cell the first in view order counts: the largest, or the smallest of an
    ascending view. With `categories` given the result is wide, one column each, missing cells 0.
    """
    first = F.min if ascending else F.max
    category = _or_unknown("category")
    if categories is None:
        cells = rows.groupBy("scan_id", "label", category.alias("category"))
        return cells.agg(round_half_up(first("value")).alias("value"))
    columns = [
        F.coalesce(round_half_up(first(F.when(category == c, F.col("value")))), F.lit(0.0)).alias(c)
        for c in categories
    ]
    return rows.groupBy("scan_id", "label").agg(*columns)


def short_label(rows: DataFrame) -> DataFrame:
    """Rows with the last path segment of their label."""
    return rows.withColumn("short_label", file_name(F.col("label")))


# Metric keys of the three log levels shown.
LOG_LEVEL_KEYS = {"error": "log_error", "warn": "log_warn", "info": "log_info"}


def log_levels(rows: DataFrame) -> DataFrame:
    """Per scan the summed values of the three log levels, one column each."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("metric_key") == key, F.col("value"))), F.lit(0.0)).alias(name)
        for name, key in LOG_LEVEL_KEYS.items()
    ]
    return rows.groupBy("scan_id").agg(*sums)
