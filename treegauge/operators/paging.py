"""Pages of ordered rows, near the front and deep inside.

A page near the front is a top-k: every task keeps offset + limit rows. A deep page is located by counts first: a sample of
keys cuts the rows into ranges, one aggregate counts the rows before each cut, and only the range that holds the page is
looked at again, cut anew while it is large, and sorted in the end. No row outside that range is shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order keys: column name, and whether it descends. Nulls stand as Spark sorts them: first, or last where descending.
Order = list[tuple[str, bool]]
# Up to so many rows a page is taken from the front of every task.
FRONT = 10_000
CUTS = 32
# Ranges of up to so many rows are sorted.
SORTED_ROWS = 1_000_000


def _sort(order: Order) -> list[Column]:
    return [F.col(name).desc() if down else F.col(name).asc() for name, down in order]


def _before(order: Order, key: tuple) -> Column:
    """Whether a row stands before this key."""
    out = F.lit(False)
    for (name, down), value in reversed(list(zip(order, key))):
        column = F.col(name)
        if value is None:
            less = column.isNotNull() if down else F.lit(False)
        else:
            less = F.coalesce(column > F.lit(value), F.lit(False)) if down else F.coalesce(column < F.lit(value), F.lit(True))
        out = less | (column.eqNullSafe(F.lit(value)) & out)
    return out


def _cuts(rows: DataFrame, order: Order, cuts: int) -> list[tuple]:
    """Keys of a few rows taken at random (by a hash of where they stand), in order, each once."""
    names = [name for name, _ in order]
    sample = rows.select(*names, F.xxhash64(F.lit("cut"), F.monotonically_increasing_id()).alias("_at")).orderBy("_at").limit(cuts)
    ordered = [tuple(r)[:-1] for r in sample.orderBy(*_sort(order)).collect()]
    return [key for i, key in enumerate(ordered) if not i or key != ordered[i - 1]]


def page_of(rows: DataFrame, order: Order, offset: int, limit: int, front: int = FRONT, cuts: int = CUTS,
            sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Rows offset + 1 to offset + limit in this order; the last key should make it unique."""
    if offset < 0 or limit < 1:
        raise ValueError(f"no page from {offset} with {limit} rows")
    part, skipped, size = rows, 0, None
    while offset + limit > front and (size is None or size > sorted_rows):
        keys = _cuts(part, order, cuts)
        if not keys:
            break
        counts = part.agg(F.count("*").alias("all"), *[F.count_if(_before(order, key)).alias(f"_{i}") for i, key in enumerate(keys)]).first()
        before = [skipped + counts[f"_{i}"] for i in range(len(keys))]
        first = max((i for i, n in enumerate(before) if n <= offset), default=None)
        last = min((i for i, n in enumerate(before) if n >= offset + limit), default=None)
        now = (before[last] if last is not None else skipped + counts["all"]) - (before[first] if first is not None else skipped)
        if first is not None:
            part, skipped = part.where(~_before(order, keys[first])), before[first]
        if last is not None:
            part = part.where(_before(order, keys[last]))
        if now == counts["all"]:
            break  # equal keys, or a page as long as the range: cutting does not help
        size = now
    return part.orderBy(*_sort(order)).offset(offset - skipped).limit(limit)
