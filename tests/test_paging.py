"""Pages against sorted lists; top-n against a plain ranking."""

import random

import pytest
from pyspark.sql import functions as F

from suite.plans import final_plan
from treegauge.operators.paging import page_of
from treegauge.operators.views import run_view
from treegauge.specs import ViewSpec


def in_order(rows):
    """a ascending with nulls first, then b descending with nulls last, then i."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None, [-ord(c) for c in r[1] or ""] + [1], r[2]))


@pytest.mark.parametrize("hot", [False, True])
def test_deep_pages_against_a_sorted_list(spark, hot):
    rng = random.Random(1)
    rows = [(rng.choice([None, 7]) if hot else rng.choice([None, *range(40)]), rng.choice([None, "x", "y", "z"]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, b string, i int").repartition(5)
    expected = in_order(rows)
    order = [("a", False), ("b", True), ("i", False)]
    for offset, limit in ((0, 10), (450, 20), (890, 30), (899, 1), (1200, 5), (100, 700)):
        got = [tuple(r) for r in page_of(df, order, offset, limit, front=0, cuts=8, sorted_rows=60).collect()]
        assert got == expected[offset:offset + limit]
    assert [tuple(r) for r in page_of(df, order, 30, 5).collect()] == expected[30:35]


def test_equal_rows_end_the_cutting(spark):
    df = spark.range(500).select(F.lit(1).alias("a"))
    assert page_of(df, [("a", False)], 400, 50, front=0, cuts=4, sorted_rows=10).count() == 50
    with pytest.raises(ValueError):
        page_of(df, [("a", False)], -1, 5)


def test_only_the_range_of_the_page_is_sorted(spark):
    df = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 200_000).alias("k"))
    page = page_of(df, [("k", False)], 150_000, 10, sorted_rows=5_000)
    assert [r.k for r in page.collect()] == list(range(150_000, 150_010))
    assert final_plan(page).count("Filter") >= 1  # the cuts stand below the sort


def test_top_n_over_all_scans(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), f"f{i % 300}", float(rng.randint(1, 50)), f"an{i % 3}") for i in range(2000)]
    tags = F.create_map(F.lit("n"), F.col("n").cast("string"))
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "scan_id long, file_path string, value_after double, analyzer_id string, n int")
    metrics = df.select("scan_id", "file_path", F.lit("A").alias("change_type"), F.lit(None).cast("string").alias("old_file_path"),
                        F.lit(None).cast("string").alias("tech_stack"), "analyzer_id", tags.alias("tags"),
                        F.lit(None).cast("double").alias("value_before"), "value_after", F.lit(None).cast("string").alias("scope"))
    view = run_view(metrics.repartition(6), ViewSpec("top_n", limit=40))
    got = {}
    for r in view.collect():
        got.setdefault(r.scan_id, []).append(r.value)
    for scan, values in got.items():
        assert sorted(values, reverse=True) == sorted((v for s, _, v, _ in rows if s == scan), reverse=True)[:40]
    assert set(got) == {1, 2, 3} and final_plan(view).count("WindowGroupLimit") >= 2
