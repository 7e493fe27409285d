"""The Bloom filter over changed paths."""

from pyspark.sql import functions as F

from treegauge.operators.diff import version_diff
from treegauge.operators.path_filter import maybe_of_paths
from treegauge.session import cut_lineage
from treegauge.specs import ScanRules

KEYS = ["project", "file_path"]


def paths(spark, first, last):
    return cut_lineage(spark.range(first, last).select(F.lit("p").alias("project"), F.concat(F.lit("src/"), F.col("id").cast("string")).alias("file_path")))


def test_no_path_is_lost_and_few_others_pass(spark):
    files = paths(spark, 0, 200_000)
    for first, last in ((0, 3), (1000, 21_000), (0, 150_000)):
        wanted = paths(spark, first, last)
        passed = maybe_of_paths(files, wanted, KEYS)
        assert passed.columns == files.columns
        assert passed.join(wanted, KEYS, "left_semi").count() == last - first
        assert passed.count() <= (last - first) + 0.02 * 200_000


def test_a_full_filter_loses_nothing(spark):
    files, wanted = paths(spark, 0, 60_000), paths(spark, 10_000, 50_000)
    passed = maybe_of_paths(files, wanted, KEYS, max_pages=1)  # every bit is set: all pass
    assert passed.join(wanted, KEYS, "left_semi").count() == 40_000
    assert passed.count() > 55_000


def test_no_paths_no_files(spark):
    assert maybe_of_paths(paths(spark, 0, 100), paths(spark, 0, 0), KEYS).count() == 0


def test_content_of_unchanged_files_is_not_shuffled(spark, tmp_path):
    """Many changes: the filter still stands between both scans and the first shuffle of content."""
    def tree(version, changed):
        rows = spark.range(0, 30_000).select(
            F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"),
            F.concat(F.lit("text "), F.col("id").cast("string"), F.when(F.col("id") < changed, F.lit(version)).otherwise(F.lit(""))).alias("content"))
        rows.write.parquet(str(tmp_path / version))
        return spark.read.parquet(str(tmp_path / version))

    diff = version_diff(tree("v1", 0), tree("v2", 6_000), ScanRules(), 1)
    rows = diff.collect()
    assert len(rows) == 6_000 and all(r.change_type == "M" and r.content == r.old_content + "v2" for r in rows)
    plan = diff._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bitmap_construct_agg") == 2


def test_undecodable_files(spark):
    schema = "project string, version string, file_path string, content string, raw binary"
    base = spark.createDataFrame([("p", "1", "same", None, b"\x00a"), ("p", "1", "new", None, b"\x00a"), ("p", "1", "text", "t", b"t")], schema)
    target = spark.createDataFrame([("p", "2", "same", None, b"\x00a"), ("p", "2", "new", None, b"\x00b"), ("p", "2", "text", None, b"\x00")], schema)
    assert {r.file_path: r.change_type for r in version_diff(base, target, ScanRules(), 1).collect()} == {"new": "M", "text": "M"}
    texts = [f.drop("raw") for f in (base, target)]
    assert {r.file_path: r.change_type for r in version_diff(*texts, ScanRules(), 1).collect()} == {"text": "M"}
