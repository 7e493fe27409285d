"""Aggregation views over the metric table.

Every view works on one scan (pruned to its partition) or, with scan_id=None, on all scans at
once with scan_id as an extra key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treegauge.functions.paths import extension
from treegauge.functions.tags import CATEGORY, METRIC, tags_key
from treegauge.specs import ViewSpec

ITEM_COLUMNS = [
    "scan_id",
    "label",
    "value",
    "tech_stack",
    "category",
    "change_type",
    "metric_key",
    "analyzer_id",
    "tags",
]
# Groups that a scan is dealt to in the first round of a top-n over all scans.
TOP_SALTS = 64
GROUP_KEYS = ("tech_stack", "category", "change_type", "metric_key", "analyzer_id", "extension")


def of_scan(table: DataFrame, scan_id: int | None) -> DataFrame:
    """Rows of one scan, or of all scans."""
    return table if scan_id is None else table.where(F.col("scan_id") == scan_id)


def source_filter(metrics: DataFrame, spec: ViewSpec) -> DataFrame:
    """The view's own filters: analyzer ids and tag values."""
    if spec.analyzer_id:
        metrics = metrics.where(F.col("analyzer_id").isin(list(spec.analyzer_id)))
    for key, value in spec.all_tag_filters.items():
        metrics = metrics.where(F.col("tags")[key] == value)
    return metrics


def request_filter(
    metrics: DataFrame,
    *,
    tech_stack: str | None = None,
    category: str | None = None,
    metric_key: str | None = None,
    change_type: str | None = None,
) -> DataFrame:
    """Filters given with a request."""
    wanted = (
        (F.col("tech_stack"), tech_stack),
        (F.col("tags")[CATEGORY], category),
        (F.col("tags")[METRIC], metric_key),
        (F.col("change_type"), change_type),
    )
    for column, value in wanted:
        if value is not None:
            metrics = metrics.where(column == value)
    return metrics


def positive(metrics: DataFrame) -> DataFrame:
    """Rows with a value above zero (top_n and sum look at these only)."""
    return metrics.where(F.col("value_after") > 0)


def split_keys(keys: str | Iterable[str] | None) -> list[str]:
    """Group keys from a list or a comma list; blank means no grouping."""
    parts = keys.split(",") if isinstance(keys, str) else list(keys or ())
    return [k for k in (p.strip() for p in parts) if k]


def group_key(key: str, path: str = "file_path") -> Column:
    """The column behind a group key; NULL where the row has no such value."""
    if key in ("tech_stack", "change_type", "analyzer_id"):
        return F.col(key)
    if key == "category":
        return F.col("tags")[CATEGORY]
    if key == "metric_key":
        return F.col("tags")[METRIC]
    if key == "extension":
        return extension(F.col(path))
    if key.startswith("tag:"):
        return F.col("tags")[key[4:]]
    return F.lit("Other")


def is_known_key(key: str) -> bool:
    """False for a key that names no column and no tag."""
    return key in GROUP_KEYS or key.startswith("tag:")


def _key_columns(n: int) -> list[str]:
    return [f"k{i}" for i in range(1, n + 1)]


def items(metrics: DataFrame) -> DataFrame:
    """Metric rows as view items."""
    return metrics.select(
        "scan_id",
        F.col("file_path").alias("label"),
        F.col("value_after").alias("value"),
        "tech_stack",
        F.col("tags")[CATEGORY].alias("category"),
        "change_type",
        F.col("tags")[METRIC].alias("metric_key"),
        "analyzer_id",
        "tags",
    )


def top_n_items(rows: DataFrame, spec: ViewSpec, scan_id: int | None = None) -> DataFrame:
    """The n largest (or smallest) items per scan; ties by label, analyzer and tags.

    For all scans a tournament in two rounds: n rows per scan and salt, then n per scan. The rank filters let Spark
    keep n rows per group in every map task, and the last task of a scan reads n rows a salt, however
    many tasks have read the scan.
    """
    value = F.col("value").desc() if spec.order == "desc" else F.col("value").asc()
    order = [value, F.col("label"), F.col("analyzer_id"), tags_key(F.col("tags"))]
    if scan_id is not None:
        return rows.orderBy(*order).limit(spec.limit)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("label", "analyzer_id"), F.lit(TOP_SALTS)))
    for group in (["scan_id", "_salt"], ["scan_id"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        salted = salted.withColumn("_rank", rank).where(F.col("_rank") <= spec.limit)
    return salted.drop("_rank", "_salt")


def group_tree(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Group nodes of all levels: (scan_id, depth, k1..kn, label, value, group_key).

    A node's value is the sum of its items, hence of its children. Items are summed at the
    deepest level first (combined map-side); the rollup runs over those few rows. NULL keys
    become 'Unknown' before the rollup, so NULL means 'above this level'.
    """
    names = _key_columns(len(keys))
    finest = rows.groupBy(
        "scan_id",
        *[F.coalesce(group_key(k, "label"), F.lit("Unknown")).alias(n) for k, n in zip(keys, names)],
    ).agg(F.sum("value").alias("value"))
    rolled = finest.rollup("scan_id", *names).agg(
        F.sum("value").alias("value"), F.grouping_id().alias("_gid")
    )
    n = len(keys)
    depth = F.lit(n).cast("int") - F.bit_count("_gid")
    label = F.coalesce(*[F.col(c) for c in reversed(names)])
    by_depth = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("depth"))
    return (
        rolled.withColumn("depth", depth)
        .where("depth >= 1")
        .select("scan_id", "depth", *names, label.alias("label"), "value", by_depth.alias("group_key"))
    )


_OWN_FIELDS = ("tech_stack", "category", "change_type", "metric_key", "analyzer_id")


def view_nodes(
    metrics: DataFrame,
    spec: ViewSpec,
    scan_id: int | None = None,
    *,
    group_by: str | Iterable[str] | None = None,
    **filters,
) -> DataFrame:
    """The nodes of a grouped top_n or sum view: group nodes as in `group_tree`, and below the deepest of them the items.

    An item hangs below the group of its keys k1..kn, one level deeper, with its own fields; a group carries the
    field it groups by. Without `include_children` the deepest groups have no items below them. Items stay rows: a
    group may hold any number of them. Without keys the items are all there is.
    """
    keys = effective_keys(spec, group_by)
    found = view_items(metrics, spec, scan_id, **filters)
    names = _key_columns(len(keys))
    none = F.lit(None).cast("string")
    leaves = found.select(
        "scan_id", F.lit(len(keys) + 1).alias("depth"),
        *[F.coalesce(group_key(k, "label"), F.lit("Unknown")).alias(n) for k, n in zip(keys, names)],
        "label", "value", none.alias("group_key"), F.lit(True).alias("item"), *_OWN_FIELDS)
    if not keys:
        return leaves
    own = [F.when(F.col("group_key") == field, F.col("label")).alias(field) for field in _OWN_FIELDS]
    groups = group_tree(found, keys).select("scan_id", "depth", *names, "label", "value", "group_key", F.lit(False).alias("item"), *own)
    return groups.unionByName(leaves) if spec.include_children else groups


def deepest(levels: DataFrame) -> DataFrame:
    """The nodes that have no child groups."""
    names = [c for c in levels.columns if c.startswith("k") and c[1:].isdigit()]
    return levels.where(F.col("depth") == len(names))


def sibling_sort(levels: DataFrame) -> DataFrame:
    """Nodes by level, siblings by value, largest first."""
    return levels.orderBy("scan_id", "depth", F.col("value").desc(), "label")


def sibling_rank(levels: DataFrame) -> DataFrame:
    """Nodes with their rank among the siblings of one parent.

    Equal values are first counted together. A parent's distinct values are then cut into
    magnitude classes (by the logarithm, order-preserving); ranks run inside a class and are
    shifted by the sizes of the classes above, so a parent with very many children is spread.
    """
    names = [c for c in levels.columns if c.startswith("k") and c[1:].isdigit()]
    is_node = [F.col("depth") > i for i in range(1, len(names) + 1)]
    parent = F.to_json(F.struct(*[F.when(p, F.col(n)).alias(n) for p, n in zip(is_node, names)]))
    size = F.signum("value") * F.floor(F.log(F.abs("value") + 1) * 16)
    nodes = levels.withColumn("_parent", parent).withColumn("_class", size.cast("int"))
    group = ["scan_id", "depth", "_parent"]

    values = nodes.groupBy(*group, "_class", "value").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*group, "_class").orderBy(F.col("value").desc())
    above_class = Window.partitionBy(*group).orderBy(F.col("_class").desc())
    earlier = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    inside = values.withColumn("_in", F.coalesce(F.sum("_n").over(above.rowsBetween(*earlier)), zero))
    classes = values.groupBy(*group, "_class").agg(F.sum("_n").alias("_n"))
    shifts = classes.select(
        *group, "_class", F.coalesce(F.sum("_n").over(above_class.rowsBetween(*earlier)), zero).alias("_up")
    )
    ranks = inside.join(shifts, [*group, "_class"]).select(
        *group, "value", (F.col("_in") + F.col("_up") + 1).alias("sibling_rank")
    )
    return nodes.join(ranks, [*group, "value"]).select(*levels.columns, "sibling_rank")


def _per_scan(rows: DataFrame, scan_id: int | None, *aggregates: Column) -> DataFrame:
    """One aggregated row per scan; for a single scan also when nothing is left of it."""
    if scan_id is None:
        return rows.groupBy("scan_id").agg(*aggregates)
    return rows.agg(F.lit(scan_id).alias("scan_id"), *aggregates)


def sum_total(rows: DataFrame, scan_id: int | None = None) -> DataFrame:
    """One 'Total' row per scan."""
    value = F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")
    return _per_scan(rows, scan_id, F.lit("Total").alias("label"), value)


_STATS = {"avg": F.avg, "min": F.min, "max": F.max}
_EXTREME = ["tech_stack", "category", "metric_key", "change_type", "analyzer_id"]


def _extreme_row(func: str) -> Column:
    """Attributes of the row that holds the minimum or maximum; ties by path and analyzer."""
    v = F.col("value_after")
    first = F.struct(
        (-v if func == "max" else v).alias("_order"),
        F.col("file_path").alias("extreme_path"),
        *[group_key(k).alias(k) for k in _EXTREME],
    )
    return F.min(F.when(v.isNotNull(), first)).alias("_row")


def stat_view(
    metrics: DataFrame,
    func: str,
    keys: list[str],
    scan_id: int | None = None,
    representative: bool = False,
    null_as_zero: bool = True,
) -> DataFrame:
    """avg, min or max: (scan_id, k1..kn, label, value, group_key).

    NULL values are ignored, except that grouping by extension counts them as 0 (null_as_zero)
    and names missing keys ''. Elsewhere missing keys stay NULL and are labelled 'Unknown'. A
    group without any value gives 0. Unknown keys are passed over unless extension is a key too,
    where they read 'Other'. With `representative`, min and max carry the attributes of
    the row that holds the extreme.
    """
    by_extension = "extension" in keys
    if not by_extension:
        keys = [k for k in keys if is_known_key(k)]
    names = _key_columns(len(keys))
    missing = "" if by_extension else None
    value = F.col("value_after")
    if by_extension and null_as_zero:
        value = F.coalesce(value, F.lit(0.0))
    aggregates = [F.coalesce(_STATS[func](value), F.lit(0.0)).alias("value")]
    extra = []
    if representative and func != "avg":
        aggregates.append(_extreme_row(func))
        extra = [F.col("_row.extreme_path"), *[F.col(f"_row.{k}").alias(f"extreme_{k}") for k in _EXTREME]]
    if not keys:
        label = F.lit(f"{func.upper()} Value").alias("label")
        return _per_scan(metrics, scan_id, label, *aggregates).select("scan_id", "label", "value", *extra)
    columns = [F.coalesce(group_key(k), F.lit(missing)).alias(n) for k, n in zip(keys, names)]
    grouped = metrics.groupBy("scan_id", *columns).agg(*aggregates)
    return grouped.select(
        "scan_id",
        *names,
        F.coalesce(F.col("k1"), F.lit("Unknown")).alias("label"),
        "value",
        F.lit(keys[0]).alias("group_key"),
        *extra,
    )


def _number(x: float) -> str:
    """Shortest text of a bound: 1000.0 is '1000', 0.5 is '0.5'."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def bucket_labels(bounds: Iterable[float]) -> list[str]:
    """Labels of the n+1 buckets cut by n bounds."""
    texts = [_number(b) for b in bounds]
    between = [f"{low} - {high}" for low, high in zip(texts, texts[1:])]
    return [f"< {texts[0]}", *between, f">= {texts[-1]}"]


def distribution_view(metrics: DataFrame, bounds: Iterable[float], scan_id: int | None = None) -> DataFrame:
    """Counts per bucket, empty buckets included: (scan_id, bucket, label, value, group_key).

    One aggregation with a counter per bucket, so no join with a bucket list is needed. NULL
    counts as 0.
    """
    bounds = list(bounds)
    v = F.coalesce("value_after", F.lit(0.0))
    lows, highs = [None, *bounds], [*bounds, None]
    counters = []
    for i, (low, high) in enumerate(zip(lows, highs)):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (v >= F.lit(float(low)))
        if high is not None:
            inside = inside & (v < F.lit(float(high)))
        counters.append(F.count_if(inside).alias(f"_b{i}"))
    per_scan = _per_scan(metrics, scan_id, *counters)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("bucket"),
                F.lit(label).alias("label"),
                F.col(f"_b{i}").cast("double").alias("value"),
                F.lit(f"bucket_{i}").alias("group_key"),
            )
            for i, label in enumerate(bucket_labels(bounds))
        ]
    )
    return per_scan.select("scan_id", F.inline(rows))


def effective_keys(spec: ViewSpec, group_by: str | Iterable[str] | None = None) -> list[str]:
    """Group keys in force: the request's, else the view's, plus change_type in 'all' mode."""
    if group_by is not None:
        return split_keys(group_by)
    keys = split_keys(spec.group_by)
    return [*keys, "change_type"] if spec.change_type_mode == "all" else keys


def view_rows(
    metrics: DataFrame,
    spec: ViewSpec,
    scan_id: int | None = None,
    *,
    change_type: str | None = None,
    **filters,
) -> DataFrame:
    """The metric rows a view looks at. A 'switchable' view shows one change type, first 'A'."""
    if spec.change_type_mode == "switchable" and change_type is None:
        change_type = "A"
    rows = source_filter(of_scan(metrics, scan_id), spec)
    rows = request_filter(rows, change_type=change_type, **filters)
    return positive(rows) if spec.func in ("top_n", "sum") else rows


def view_items(metrics: DataFrame, spec: ViewSpec, scan_id: int | None = None, **filters) -> DataFrame:
    """The items (leaves) behind a top_n or sum view."""
    rows = items(view_rows(metrics, spec, scan_id, **filters))
    return top_n_items(rows, spec, scan_id) if spec.func == "top_n" else rows


def run_view(
    metrics: DataFrame,
    spec: ViewSpec,
    scan_id: int | None = None,
    *,
    group_by: str | Iterable[str] | None = None,
    representative: bool = False,
    null_as_zero: bool = True,
    **filters,
) -> DataFrame:
    """A view's result: items for top_n, group levels for grouped top_n and sum, one total for
    sum, statistics or buckets. top_n is cut before it is grouped."""
    keys = effective_keys(spec, group_by)
    if spec.func in ("top_n", "sum"):
        found = view_items(metrics, spec, scan_id, **filters)
        if keys:
            return group_tree(found, keys)
        return found if spec.func == "top_n" else sum_total(found, scan_id)
    rows = view_rows(metrics, spec, scan_id, **filters)
    if spec.func == "distribution":
        return distribution_view(rows, spec.buckets, scan_id)
    return stat_view(rows, spec.func, keys, scan_id, representative, null_as_zero)
