import re

from suite import shapes
from suite.all_queries import QUERIES
from treegauge.operators.metrics import merge_before_after

SF = "/root/testdata/sf0.001"
ENTRY = ("scan_id long, file_path string, change_type string, old_file_path string, tech_stack string, analyzer_id string, "
         "tags map<string,string>, scope string, side string, seq int, value double")


def test_entries_are_hashed_not_sorted(spark):
    key = (1, "a.rs", "M", None, None, "user")
    rows = [
        (*key, {"metric": "m", "team": "x"}, None, "before", 0, 1.0), (*key, {"team": "x", "metric": "m"}, None, "before", 2, 3.0),
        (*key, {"metric": "m", "team": "x"}, None, "after", 1, 5.0), (*key, {"metric": "m", "team": None}, None, "after", 0, 7.0),
        (*key, {}, None, "after", 0, 8.0), (*key, None, None, "before", 0, 9.0),
    ]
    merged = merge_before_after(spark.createDataFrame(rows, ENTRY))
    got = sorted(merged.collect(), key=lambda r: (r.value_before or 0, r.value_after or 0))
    assert [(r.tags, r.value_before, r.value_after) for r in got] == [
        ({"metric": "m", "team": None}, None, 7.0), ({}, None, 8.0), ({"metric": "m", "team": "x"}, 3.0, 5.0), (None, 9.0, None)]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def dealt(plan):
    return [int(n) for n in re.findall(r"REPARTITION_BY_NUM|hashpartitioning\(_nondeterministic[^)]*, (\d+)\)", plan) if n]


def plan_with_few_rows(spark, monkeypatch, name):
    monkeypatch.setattr(shapes, "LINES_PER_TASK", 500)
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_line_items_of_last_value_are_dealt_out(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert dealt(plan_with_few_rows(spark, monkeypatch, "G1_last_value")) == [-(-rows // 500)]


def test_line_items_of_user_merge_are_dealt_out(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert dealt(plan_with_few_rows(spark, monkeypatch, "D1_user_merge")) == [-(-rows // 500)]
