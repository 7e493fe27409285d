import os

import pytest
from pyspark.sql import functions as F

from treegauge.operators.classify import classify
from treegauge.operators.diff import version_diff
from treegauge.operators.metrics import read_summary, summary_record
from treegauge.operators.user_analyzers import run_user_analyzers
from treegauge.plans.scan import diff_scan, snapshot_scan
from treegauge.sources.files import decode_files, read_tree, snapshot_changes, spread
from treegauge.sources.tables import read_scan_table, write_scan_table
from treegauge.specs import PythonAnalyzer, ScanRules, StackRule, regex_analyzer

TEXT = ScanRules(
    (StackRule("Text", ("txt",), ("file_count",), paths=("**/*.txt",)),), ("**/exclude_this/**",)
)
V1 = {"file1.txt": "Hello World\n"}
V2 = {"file1.txt": "Hello Modified\n", "file2.txt": "New File\n"}
V3 = {"file1.txt": "Hello Modified\n"}


def by_path(metrics):
    return {r.file_path: r for r in metrics.where("analyzer_id = 'file_count'").collect()}


def test_three_versions(spark, tree):
    snapshot = snapshot_scan(tree(V2), [], TEXT, 1)
    assert set(by_path(snapshot.metrics)) == set(V2)

    first = by_path(diff_scan(tree(V1), tree(V2), [], TEXT, 2).metrics)
    assert {p: (r.change_type, r.tech_stack, r.value_before, r.value_after) for p, r in first.items()} == {
        "file1.txt": ("M", "Text", 1.0, 1.0), "file2.txt": ("A", "Text", None, 1.0)}

    second = by_path(diff_scan(tree(V2), tree(V3), [], TEXT, 3).metrics)
    row = second["file2.txt"]
    assert set(second) == {"file2.txt"}
    assert (row.change_type, row.value_before, row.value_after, row.tech_stack, row.old_file_path) == (
        "D", 1.0, None, "Text", "file2.txt")


def test_no_change_no_rows(spark, tree):
    assert version_diff(tree(V2), tree(V2), TEXT, 1, "similar").count() == 0


def test_rule_order_paths_excludes_and_rescue(spark, tree):
    rules = ScanRules(
        (
            StackRule("Core", ("rs",), paths=("core/**",)),
            StackRule("Rust", ("rs",), excludes=("gen/**",)),
            StackRule("Rust", ("py",)),
        ),
        ("*", "**/core/**"),
    )
    files = ["core/a.rs", "core/a.py", "lib/a.rs", "gen/a.rs", "a.rs", "x/a.md", "x/a.RS", "x/.rs"]
    got = {r.file_path: r.tech_stack for r in classify(tree({f: "" for f in files}), rules).collect()}
    assert got == {"core/a.rs": "Core", "lib/a.rs": "Rust", "gen/a.rs": None, "x/a.md": None,
                   "x/a.RS": None, "x/.rs": None}


def test_undecodable_files_are_scanned_but_not_measured(spark):
    rows = [("p", "v", "a.txt", b"fine \xc3\xa9"), ("p", "v", "b.txt", b"latin \xe9"), ("p", "v", "c.txt", b"bin\x00ary"),
            ("p", "v", "late.txt", b"x" * 9000 + b"\x00")]
    raw = spark.createDataFrame(rows, "project string, version string, file_path string, raw binary")
    files = decode_files(raw)
    assert {r.file_path for r in files.where("content IS NULL").collect()} == {"b.txt", "c.txt", "late.txt"}
    scan = snapshot_scan(files, [], TEXT, 1)
    assert set(by_path(scan.metrics)) == {"a.txt"}
    summary = scan.summary.first()
    assert (summary.total_files_scanned, summary.total_analyzer_executions) == (4, 1)


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a b.txt").write_text("hé")
    (tmp_path / "top.txt").write_bytes(b"\xff")
    rows = {r.file_path: r.content for r in read_tree(spark, str(tmp_path), "p", "v").collect()}
    assert rows == {"src/a b.txt": "hé", "top.txt": None}
    for root in (f"{tmp_path}/", "/" + str(tmp_path)[1:].replace("/", "//"), os.path.relpath(tmp_path), f"file://{tmp_path}"):
        assert {r.file_path for r in read_tree(spark, root, "p", "v").collect()} == set(rows)


@pytest.mark.parametrize("mode,change,snapshot,diff", [
    (None, None, 1, 2), ("all", "all", 1, 2), ("snapshot", None, 1, 0), ("DIFF", None, 0, 2), (None, "m", 0, 1)])
def test_restrictions(spark, tree, mode, change, snapshot, diff):
    finder = regex_analyzer("finder", "Hello|New", scan_mode=mode, change_type=change)
    rules = ScanRules((StackRule("Text", ("txt",), ("finder",)),))
    rows = snapshot_scan(tree(V1), [finder], rules, 1).metrics.where("analyzer_id = 'finder'")
    assert rows.count() == snapshot
    assert diff_scan(tree(V1), tree(V2), [finder], rules, 2).metrics.where("analyzer_id = 'finder'").count() == diff


def test_diff_matches_of_both_sides(spark, tree):
    finder = regex_analyzer("finder", "l+")
    rules = ScanRules((StackRule("Text", ("txt",), ("finder",)),))
    old = {"old.txt": "all\nwell\nx\ny\nz\nq", "same.txt": "l"}
    new = {"new.txt": "all\nwell\nx\ny\nz\nball", "same.txt": "l"}
    scan = diff_scan(tree(old), tree(new), [finder], rules, 1)
    got = sorted((r.side, r.file_path, r.line_number) for r in scan.matches.collect())
    assert got == [("after", "new.txt", 1), ("after", "new.txt", 2), ("after", "new.txt", 6),
                   ("before", "old.txt", 1), ("before", "old.txt", 2)]
    row = scan.metrics.where("analyzer_id = 'finder'").first()
    assert (row.change_type, row.old_file_path, row.value_before, row.value_after) == ("M", "old.txt", 2.0, 3.0)


def test_content_hash_decides_on_undecodable_files(spark):
    schema = "project string, file_path string, content string, content_hash string"
    base = spark.createDataFrame([("p", "x/a.bin", None, "1"), ("p", "x/b.bin", None, "2")], schema)
    target = spark.createDataFrame([("p", "x/a.bin", None, "9"), ("p", "y/b.bin", None, "2")], schema)
    rows = version_diff(base, target, ScanRules(), 1, "exact").collect()
    assert sorted((r.file_path, r.change_type, r.old_file_path) for r in rows) == [
        ("x/a.bin", "M", None), ("y/b.bin", "M", "x/b.bin")]


def test_user_analyzers(spark, tree):
    def angry(path, content, change_type):
        if "bad" in content:
            raise RuntimeError("cannot read this")
        if "junk" in content:
            return "not json"
        if "partial" in content:
            return [{"value": 1}, {"tags": {}}]
        return [{"value": len(content), "tags": {"unit": "c"}, "metric_key": "size",
                 "matches": [{"line_number": 1, "matched_text": content[:3]}]}]

    mine = PythonAnalyzer("mine", {"metric": "override", "team": "x"}, func=angry)
    rules = ScanRules((StackRule("Text", ("txt",), ("mine",)),))
    files = {"a.txt": "good", "b.txt": "bad", "c.txt": "junk", "d.txt": "partial", "e.txt": None}
    scan = snapshot_scan(tree(files), [mine], rules, 1)
    rows = scan.metrics.where("analyzer_id = 'mine'").collect()
    assert [(r.file_path, r.tags, r.value_after) for r in rows] == [
        ("a.txt", {"unit": "c", "metric": "override", "team": "x"}, 4.0)]
    assert [r.error for r in scan.errors.collect()] == ["b.txt: cannot read this"]
    match = scan.matches.first()
    assert (match.file_path, match.analyzer_id, match.matched_text) == ("a.txt", "mine", "goo")
    stats = {r.analyzer_id: (r.files_analyzed, r.execution_errors) for r in scan.stats.collect()}
    assert stats == {"file_count": (4, 0), "char_count": (0, 0), "mine": (3, 1)}
    summary = scan.summary.first()
    assert (summary.total_files_scanned, summary.total_analyzers_loaded, summary.total_analyzers_executed,
            summary.total_analyzer_executions, summary.total_errors) == (5, 3, 2, 7, 1)


def test_user_analyzers_share_a_pass(spark):
    files = spark.createDataFrame([("p", "a.txt", "x"), ("p", "b.md", "yy")], "project string, file_path string, content string")
    sizes = [PythonAnalyzer(name, tags, func=lambda p, c, t: [{"value": len(c)}]) for name, tags in (("one", {}), ("two", {"k": "v"}))]
    rules = ScanRules((StackRule("Text", ("txt",), ("one", "two")), StackRule("Notes", ("md",), ("two",))))
    results = run_user_analyzers(snapshot_changes(files, rules, 1), sizes, rules)
    assert sorted((r.file_path, r.analyzer_id, r.side, r.entries[0].value, r.overrides) for r in results.collect()) == [
        ("a.txt", "one", "after", 1.0, {}), ("a.txt", "two", "after", 1.0, {"k": "v"}), ("b.md", "two", "after", 2.0, {"k": "v"})]
    assert "Union" not in results._jdf.queryExecution().executedPlan().toString()


def test_summary_round_trip(spark, tree, tmp_path):
    scan = snapshot_scan(tree(V2), [], TEXT, 5)
    path = str(tmp_path / "summaries")
    write_scan_table(summary_record(scan.stats, ["x.py: syntax"]), path)
    row = read_summary(read_scan_table(spark, path, 5)).first()
    assert row.load_errors == ["x.py: syntax"]
    assert [(s.analyzer_id, s.files_analyzed) for s in row.analyzer_stats] == [("char_count", 0), ("file_count", 2)]


def test_analysis_shuffles_nothing(spark, tree):
    finder = regex_analyzer("finder", "l+")
    rules = ScanRules((StackRule("Text", ("txt",), ("finder",)),))
    files = spark.range(10).selectExpr("'p' AS project", "concat(id, '.txt') AS file_path", "'hello' AS content")
    from suite.plans import final_plan
    from treegauge.plans.scan import scan_changes

    scan = scan_changes(snapshot_changes(files, rules, 1), [finder], rules)
    for table in (scan.metrics, scan.matches):
        assert "Exchange" not in final_plan(table)


def test_spread_leaves_enough_splits_alone(spark):
    many = spark.range(0, 100, 1, 64)
    assert spread(many) is many
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_scan_table_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "m")
    table = spark.range(100).select((F.col("id") % 5).alias("scan_id"), F.col("id").alias("v"))
    write_scan_table(table, path)
    write_scan_table(table.where("scan_id = 3"), path)
    assert read_scan_table(spark, path).count() == 100
    one = read_scan_table(spark, path, 3)
    assert one.count() == 20
    assert "PartitionFilters: [isnotnull(scan_id" in one._jdf.queryExecution().executedPlan().toString()


def test_an_analyzer_that_ends_its_process_or_hangs_loses_only_its_own_file(spark, tree):
    def rough(path, content, change_type):
        import os
        import signal
        import sys
        import time

        print("noise on standard output")
        if "exit" in content:
            os._exit(3)
        if "leave" in content:
            sys.exit("bye")
        if "crash" in content:
            os.kill(os.getpid(), signal.SIGSEGV)
        if "hang" in content:
            while True:
                time.sleep(1)
        return [{"value": len(content)}]

    calm = PythonAnalyzer("calm", func=lambda p, c, t: [{"value": 1.0}])
    rules = ScanRules((StackRule("Text", ("txt",), ("rough", "calm")),))
    files = {f"{word}{i}.txt": word + "x" * i for i in range(3) for word in ("fine", "exit", "leave", "crash", "hang")}
    files["long.txt"] = "fine" * 500_000
    scan = snapshot_scan(tree(files).coalesce(2), [PythonAnalyzer("rough", func=rough, time_limit=1.0), calm], rules, 1)
    values = {(r.analyzer_id, r.file_path): r.value_after for r in scan.metrics.where("analyzer_id in ('rough', 'calm')").collect()}
    assert {f for a, f in values if a == "calm"} == set(files)
    assert {f: v for (a, f), v in values.items() if a == "rough"} == {f: len(t) for f, t in files.items() if t.startswith("fine")}
    errors = {r.error.split(": ")[0]: r.error.split(": ", 1)[1] for r in scan.errors.collect()}
    assert errors == {f"{word}{i}.txt": text for i in range(3) for word, text in (
        ("exit", "the analyzer's process ended with code 3"), ("leave", "bye"),
        ("crash", "the analyzer's process ended with code -11"), ("hang", "no result within 1 s"))}


def parts_of(frame):
    return [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]


def test_spread_deals_out_large_splits(spark):
    uneven = spark.range(0, 4000, 1, 1).union(spark.range(4000, 4020, 1, 20))
    assert max(parts_of(uneven)) == 4000
    dealt = spread(uneven, rows=100)
    assert dealt.rdd.getNumPartitions() == 41 and max(parts_of(dealt)) < 200
    assert sorted(r.id for r in dealt.collect()) == list(range(4020))
    assert spread(uneven, rows=4000) is uneven
    few = spark.range(0, 100, 1, 1)
    assert spread(few, rows=100, fill=False) is few and len(parts_of(spread(few, rows=99, fill=False))) > 1
    equal = spark.range(0, 2000, 1, 1).select(F.lit(None).cast("string").alias("file_path"))
    assert max(parts_of(spread(equal, rows=100))) < 200
