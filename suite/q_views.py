"""E, F, G: aggregations, order and windows. All scans at once unless the query says otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite import shapes as sh
from suite.oracle_tables import EXT, over
from suite.q_sources import MATCH, SUMMARY, _runs_sql
from suite.registry import query
from treegauge.operators import catalog, matches, metrics, paging, reshape, views
from treegauge.specs import ViewSpec

POSITIVE = "(SELECT * FROM metrics_li WHERE value_after > 0)"


@query("E1_sum_total", over("metrics_li", f"""
    SELECT scan_id, 'Total' AS label, round(sum(value_after), 2) AS value FROM {POSITIVE} GROUP BY scan_id"""))
def e1(spark, d):
    return sh.rounded(views.run_view(fx.metrics_li(spark, d), ViewSpec("sum")))


@query("E2_sum_grouped", over("metrics_li", f"""
    SELECT scan_id, coalesce(tech_stack, 'Unknown') AS label, round(sum(value_after), 2) AS value,
      'tech_stack' AS group_key FROM {POSITIVE} WHERE category = 'size' GROUP BY ALL"""))
def e2(spark, d):
    spec = ViewSpec("sum", category="size", group_by=("tech_stack",), include_children=False)
    return sh.rounded(views.run_view(fx.metrics_li(spark, d), spec).select("scan_id", "label", "value", "group_key"))


@query("E3_stats_ungrouped", over("metrics_li", """
    SELECT scan_id, 'AVG Value' AS label, round(avg(value_after), 2) AS value FROM metrics_li GROUP BY scan_id
    UNION ALL SELECT scan_id, 'MIN Value', round(coalesce(min(value_after), 0), 2) FROM metrics_li GROUP BY scan_id
    UNION ALL SELECT scan_id, 'MAX Value', round(max(value_after), 2) FROM metrics_li GROUP BY scan_id"""))
def e3(spark, d):
    m = fx.metrics_li(spark, d)
    rows = [views.run_view(m, ViewSpec(f)) for f in ("avg", "min", "max")]
    return sh.rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query("E4_stats_grouped", over("metrics_li", """
    SELECT scan_id, tech_stack AS k1, category AS k2, coalesce(tech_stack, 'Unknown') AS label,
      round(coalesce(avg(value_after), 0), 2) AS value, 'tech_stack' AS group_key, 'avg' AS func FROM metrics_li GROUP BY ALL
    UNION ALL
    SELECT scan_id, change_type, metric_key, change_type, round(coalesce(max(value_after), 0), 2), 'change_type', 'max'
    FROM metrics_li GROUP BY ALL
    UNION ALL
    SELECT scan_id, analyzer_id, team, analyzer_id, round(coalesce(min(value_after), 0), 2), 'analyzer_id', 'min'
    FROM metrics_li GROUP BY ALL"""))
def e4(spark, d):
    m = fx.metrics_li(spark, d)
    asked = {"avg": "tech_stack, category, nonsense", "max": ["change_type", "metric_key"], "min": "analyzer_id,tag:team"}
    rows = [views.run_view(m, ViewSpec(f), group_by=k).withColumn("func", F.lit(f)) for f, k in asked.items()]
    return sh.rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query("E5_stats_by_extension", over("metrics_li", f"""
    SELECT scan_id, {EXT} AS k1, coalesce(tech_stack, '') AS k2, 'Other' AS k3, {EXT} AS label,
      round(avg(coalesce(value_after, 0)), 2) AS value, 'extension' AS group_key, 'avg' AS func
    FROM metrics_li GROUP BY ALL
    UNION ALL
    SELECT scan_id, {EXT}, coalesce(tech_stack, ''), 'Other', {EXT}, round(min(coalesce(value_after, 0)), 2),
      'extension', 'min' FROM metrics_li GROUP BY ALL"""))
def e5(spark, d):
    m = fx.metrics_li(spark, d)
    rows = [views.run_view(m, ViewSpec(f, group_by=("extension", "tech_stack", "nonsense"))).withColumn("func", F.lit(f))
            for f in ("avg", "min")]
    return sh.rounded(rows[0].unionByName(rows[1]))


_TREE = f"""
    SELECT scan_id, CAST(3 - (CASE WHEN grouping(k2) = 1 THEN 2 WHEN grouping(k3) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS depth,
      k1, k2, k3, CASE WHEN grouping(k2) = 1 THEN k1 WHEN grouping(k3) = 1 THEN k2 ELSE k3 END AS label,
      round(sum(value_after), 2) AS value,
      CASE WHEN grouping(k2) = 1 THEN 'tech_stack' WHEN grouping(k3) = 1 THEN 'extension' ELSE 'tag:team' END AS group_key
    FROM (SELECT scan_id, value_after, coalesce(tech_stack, 'Unknown') AS k1, {EXT} AS k2, team AS k3 FROM {POSITIVE})
    GROUP BY GROUPING SETS ((scan_id, k1), (scan_id, k1, k2), (scan_id, k1, k2, k3))"""
_TREE_SPEC = ViewSpec("sum", group_by=("tech_stack", "extension", "tag:team"))


@query("E6_group_tree", over("metrics_li", _TREE))
def e6(spark, d):
    return sh.wide_ints(sh.rounded(views.run_view(fx.metrics_li(spark, d), _TREE_SPEC)))


_NODES = f"""
    WITH items AS (
      SELECT scan_id, coalesce(tech_stack, 'Unknown') AS k1, coalesce(category, 'Unknown') AS k2, file_path, value_after, tech_stack, category,
        change_type, metric_key, analyzer_id FROM {POSITIVE}),
    tree AS (
      SELECT scan_id, 1 AS depth, k1, NULL AS k2, k1 AS label, sum(value_after) AS value, 'tech_stack' AS group_key, false AS item,
        k1 AS tech_stack, NULL AS category, NULL AS change_type, NULL AS metric_key, NULL AS analyzer_id FROM items GROUP BY scan_id, k1
      UNION ALL
      SELECT scan_id, 2, k1, k2, k2, sum(value_after), 'category', false, NULL, k2, NULL, NULL, NULL FROM items GROUP BY scan_id, k1, k2
      UNION ALL
      SELECT scan_id, 3, k1, k2, file_path, value_after, NULL, true, tech_stack, category, change_type, metric_key, analyzer_id FROM items WHERE {{}})
    SELECT scan_id, depth, k1, k2, label, round(value, 2) AS value, group_key, item, tech_stack, category, change_type, metric_key, analyzer_id
    FROM tree"""


def _nodes(spark, d, include_children):
    spec = ViewSpec("sum", group_by=("tech_stack", "category"), include_children=include_children)
    return sh.rounded(views.view_nodes(fx.metrics_li(spark, d), spec))


@query("E6_tree_with_children", over("metrics_li", f"SELECT * FROM ({_NODES.format('true')})"))
def e6b(spark, d):
    return _nodes(spark, d, True)


@query("E6_tree_without_children", over("metrics_li", f"SELECT * FROM ({_NODES.format('false')})"))
def e6c(spark, d):
    return _nodes(spark, d, False)


@query("E7_group_keys", over("metrics_li", f"""
    SELECT scan_id, coalesce(tech_stack, 'Unknown') AS k1, category AS k2, change_type AS k3, metric_key AS k4,
      analyzer_id AS k5, {EXT} AS k6, 'Unknown' AS k7, 'Other' AS k8, round(sum(value_after), 2) AS value
    FROM {POSITIVE} GROUP BY ALL"""))
def e7(spark, d):
    keys = "tech_stack, category, change_type, metric_key, analyzer_id, extension, tag:none, nonsense"
    levels = views.deepest(views.run_view(fx.metrics_li(spark, d), ViewSpec("sum"), group_by=keys))
    return sh.rounded(levels.drop("depth", "label", "group_key"))


@query("E8_distribution", over("metrics_li", """
    SELECT scan_id, b AS bucket, label, CAST(count_if(v >= low AND v < high) AS DOUBLE) AS value,
      'bucket_' || b AS group_key
    FROM (SELECT scan_id, coalesce(value_after, 0) AS v FROM metrics_li),
      (VALUES (0, '-Infinity'::DOUBLE, 1000::DOUBLE, '< 1000'), (1, 1000, 3000, '1000 - 3000'),
              (2, 3000, 5000, '3000 - 5000'), (3, 5000, 10000, '5000 - 10000'), (4, 10000, 50000, '10000 - 50000'),
              (5, 50000, 90000.5, '50000 - 90000.5'), (6, 90000.5, 'Infinity', '>= 90000.5')) t(b, low, high, label)
    GROUP BY ALL"""))
def e8(spark, d):
    return views.run_view(fx.metrics_li(spark, d), ViewSpec("distribution", buckets=(*fx.BUCKETS, 90000.5)))


@query("E9_scan_summary", over("snapshot", SUMMARY.format("snapshot", _runs_sql("snapshot", 1))))
def e9(spark, d):
    changes = sh.snapshot(spark, d)
    stats = metrics.analyzer_stats(metrics.analyzer_runs(changes, fx.ANALYZERS, fx.RULES))
    return metrics.scan_summary(stats)


@query("E9_analyzer_stats", over("snapshot", f"""
    SELECT scan_id, analyzer_id, n - coalesce(e, 0) AS files_analyzed, coalesce(e, 0) AS execution_errors,
      (SELECT count(*) FROM snapshot) AS total_files
    FROM ({_runs_sql('snapshot', 1)}) LEFT JOIN
      (SELECT CASE tech_stack WHEN 'Java' THEN 'java_complexity' ELSE 'char_count' END AS analyzer_id, count(*) AS e
       FROM snapshot WHERE contains(content, 'ü') AND tech_stack IS NOT NULL GROUP BY 1)
    USING (analyzer_id)"""))
def e9b(spark, d):
    changes = sh.snapshot(spark, d)
    failing = F.when(F.col("tech_stack") == "Java", "java_complexity").otherwise("char_count")
    errors = changes.where(F.contains("content", F.lit("ü")) & F.col("tech_stack").isNotNull()).select(
        "scan_id", failing.alias("analyzer_id"), F.col("file_path").alias("error"))
    return metrics.analyzer_stats(metrics.analyzer_runs(changes, fx.ANALYZERS, fx.RULES), errors)


@query("E10_project_stats", """
    SELECT n_name AS name, count(o_orderkey) AS total_scans, max(o_orderdate) AS last_scan_time,
      string_agg(DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'SNAPSHOT' WHEN o_orderkey IS NOT NULL THEN 'DIFF' END, ','
                 ORDER BY CASE WHEN o_orderstatus = 'F' THEN 'SNAPSHOT' WHEN o_orderkey IS NOT NULL THEN 'DIFF' END) AS scan_modes
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY n_name""")
def e10(spark, d):
    customers = fx.table(spark, d, "customer").join(
        fx.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scans = fx.scans(spark, d).withColumnRenamed("project_id", "c_custkey").join(
        customers.select("c_custkey", F.col("n_nationkey").alias("project_id")), "c_custkey")
    nations = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    return catalog.project_stats(nations, scans).drop("project_id")


@query("E11_match_count", over("matches_byte_snapshot_log", """
    SELECT scan_id, file_path, count(*) AS total FROM matches_byte_snapshot_log GROUP BY ALL"""))
def e11(spark, d):
    return matches.match_count(sh.matches(sh.snapshot_log(spark, d), "byte"))


@query("E12_extreme_row", over("metrics_li", """
    SELECT scan_id, tech_stack AS k1, round(max(value_after), 2) AS value,
      arg_min(file_path, {'v': -value_after, 'p': file_path}) FILTER (value_after IS NOT NULL) AS extreme_path,
      arg_min(metric_key, {'v': -value_after, 'p': file_path}) FILTER (value_after IS NOT NULL) AS extreme_metric_key
    FROM metrics_li GROUP BY ALL"""))
def e12(spark, d):
    rows = views.run_view(fx.metrics_li(spark, d), ViewSpec("max", group_by=("tech_stack",)), representative=True)
    return sh.rounded(rows.select("scan_id", "k1", "value", "extreme_path", "extreme_metric_key"))


@query("E13_card_total", over("metrics_li", f"""
    SELECT scan_id, round(sum(value_after), 2) AS value FROM {POSITIVE} GROUP BY scan_id"""))
def e13(spark, d):
    return sh.rounded(reshape.card_total(views.run_view(fx.metrics_li(spark, d), _TREE_SPEC)))


@query("E14_label_sets", over("metrics_li", f"""
    SELECT DISTINCT scan_id, 'label' AS axis, file_path AS name FROM {POSITIVE}
    UNION ALL SELECT DISTINCT scan_id, 'tech_stack', coalesce(tech_stack, 'Unknown') FROM {POSITIVE}
    UNION ALL SELECT DISTINCT scan_id, 'category', category FROM {POSITIVE}"""))
def e14(spark, d):
    return reshape.label_sets(views.view_items(fx.metrics_li(spark, d), ViewSpec("sum")))


@query("E15_max_value", over("metrics_li", """
    SELECT scan_id, greatest(max(value_after), 1) AS max_value FROM metrics_li WHERE value_after > 0 GROUP BY scan_id"""))
def e15(spark, d):
    return reshape.max_value(views.view_items(fx.metrics_li(spark, d), ViewSpec("sum")))


_ITEM = "scan_id, file_path AS label, value_after AS value, tech_stack, category, change_type, metric_key, analyzer_id"
_RANK = ("row_number() OVER (PARTITION BY scan_id ORDER BY value_after {0}, file_path, analyzer_id, "
         "category, metric_key, team)")


@query("F1_top_n", over("metrics_li", f"""
    SELECT {_ITEM}, 'desc' AS how FROM {POSITIVE} QUALIFY {_RANK.format('DESC')} <= 25
    UNION ALL SELECT {_ITEM}, 'asc' FROM {POSITIVE} WHERE analyzer_id = 'an_1' QUALIFY {_RANK.format('ASC')} <= 10"""))
def f1(spark, d):
    m = fx.metrics_li(spark, d)
    top = views.run_view(m, ViewSpec("top_n", limit=25)).withColumn("how", F.lit("desc"))
    low = views.run_view(m, ViewSpec("top_n", "an_1", order="asc")).withColumn("how", F.lit("asc"))
    return top.unionByName(low).drop("tags")


@query("F1_top_n_of_scan", over("metrics_snapshot", """
    SELECT file_path AS label, value_after AS value, tech_stack FROM metrics_snapshot
    WHERE analyzer_id = 'char_count' AND value_after > 0 ORDER BY value_after DESC, file_path LIMIT 10"""))
def f1b(spark, d):
    m = sh.metrics(sh.snapshot(spark, d), [])
    return views.run_view(m, ViewSpec("top_n", "char_count"), 1).select("label", "value", "tech_stack")


@query("F2_top_n_grouped", over("metrics_li", f"""
    SELECT scan_id, coalesce(tech_stack, 'Unknown') AS k1, change_type AS k2, round(sum(value_after), 2) AS value
    FROM (SELECT * FROM {POSITIVE} QUALIFY {_RANK.format('DESC')} <= 200) GROUP BY ALL"""))
def f2(spark, d):
    spec = ViewSpec("top_n", limit=200, group_by=("tech_stack", "change_type"))
    levels = views.deepest(views.run_view(fx.metrics_li(spark, d), spec))
    return sh.rounded(levels.select("scan_id", "k1", "k2", "value"))


@query("F3_sibling_sort", over("metrics_li", _TREE))
def f3(spark, d):
    levels = views.sibling_sort(views.run_view(fx.metrics_li(spark, d), _TREE_SPEC))
    return sh.wide_ints(sh.rounded(levels))


@query("F4_match_pages", over("matches_byte_snapshot", f"""
    SELECT {MATCH}, (row_number() OVER (PARTITION BY scan_id, file_path
      ORDER BY line_number, column_start, analyzer_id, column_end) - 1) // 20 + 1 AS page FROM matches_byte_snapshot"""))
def f4(spark, d):
    return sh.wide_ints(matches.number_pages(sh.matches(sh.snapshot(spark, d), "byte"), 20))


@query("F4_page_of_a_file", over("matches_byte_snapshot", f"""
    SELECT {MATCH} FROM matches_byte_snapshot
    WHERE file_path = (SELECT file_path FROM matches_byte_snapshot GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 1)
    ORDER BY line_number, column_start, analyzer_id, column_end LIMIT 5 OFFSET 5"""))
def f4b(spark, d):
    found = sh.matches(sh.snapshot(spark, d), "byte")
    fullest = matches.match_count(found).orderBy(F.col("total").desc(), "file_path").first()
    return sh.wide_ints(matches.page_matches(found, 1, fullest["file_path"], page=2, page_size=5))


@query("F5_deep_page", over("commit_log", """
    SELECT hash, short_hash, message, author, timestamp FROM commit_log ORDER BY timestamp DESC, hash
    LIMIT 40 OFFSET (SELECT count(*) // 2 FROM commit_log)"""))
def f5b(spark, d):
    log = catalog.commit_log(fx.commits(spark, d)).drop("full_message")
    return paging.page_of(log, [("timestamp", True), ("hash", False)], log.count() // 2, 40, front=0, sorted_rows=100)


@query("F5_commit_page", over("commit_log", """
    SELECT hash, short_hash, message, author, timestamp,
      (SELECT count(*) > 150 FROM commit_log WHERE contains(lower(full_message), 'fix #1')) AS has_more
    FROM commit_log WHERE contains(lower(full_message), 'fix #1') ORDER BY timestamp DESC, hash LIMIT 50 OFFSET 100"""))
def f5(spark, d):
    log = catalog.commit_log(fx.commits(spark, d))
    return catalog.page_commits(catalog.search_commits(log, "FIX #1"), offset=100)


@query("F6_newest_scan", over("scans projects", """
    SELECT name AS project, max(scan_time) AS scan_time, arg_max(scan_id, {'t': scan_time, 'i': scan_id}) AS scan_id
    FROM scans JOIN projects USING (project_id) WHERE scan_mode = 'DIFF' GROUP BY ALL"""))
def f6(spark, d):
    scans = fx.scans(spark, d)
    newest = catalog.latest_scan(scans).where("scan_mode = 'DIFF'")
    return catalog.list_scans(fx.projects(spark, d), newest, mode="DIFF").select("project", "scan_time", "scan_id")


@query("F7_projects_by_last_scan", over("projects scans", """
    SELECT name, count(scan_id) AS total_scans, max(scan_time) AS last_scan_time
    FROM projects LEFT JOIN scans USING (project_id) GROUP BY ALL"""))
def f7(spark, d):
    stats = catalog.project_stats(fx.projects(spark, d), fx.scans(spark, d))
    return catalog.by_last_scan(stats).select("name", "total_scans", "last_scan_time")


@query("G1_last_value", """
    SELECT l_suppkey AS scan_id, l_shipmode AS tag, value AS value_after FROM (
      SELECT l_suppkey, l_returnflag AS l_shipmode, value,
        row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY seq DESC) AS rn
      FROM (SELECT l_suppkey, l_returnflag, l_orderkey * 10 + l_linenumber AS seq, max(l_tax) AS value
            FROM lineitem GROUP BY ALL)) WHERE rn = 1""")
def g1(spark, d):
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    one = sh.line_items(spark, d, "l_suppkey", "l_returnflag", seq, "l_tax").groupBy(
        "l_suppkey", "l_returnflag", "seq").agg(F.max("l_tax").alias("value"))
    none = F.lit(None).cast("string")
    merged = metrics.merge_before_after(one.select(
        F.col("l_suppkey").alias("scan_id"), F.lit("f").alias("file_path"), F.lit("A").alias("change_type"),
        none.alias("old_file_path"), none.alias("tech_stack"), F.lit("user").alias("analyzer_id"),
        F.create_map(F.lit("tag"), "l_returnflag").alias("tags"), none.alias("scope"), F.lit("after").alias("side"),
        "seq", "value"))
    return merged.select("scan_id", F.col("tags")["tag"].alias("tag"), "value_after")


@query("G2_sibling_rank", over("metrics_li", f"""
    SELECT scan_id, depth, k1, k2, k3, rank() OVER (PARTITION BY scan_id, depth, CASE WHEN depth > 1 THEN k1 END,
      CASE WHEN depth > 2 THEN k2 END ORDER BY exact DESC) AS sibling_rank
    FROM (SELECT *, value AS exact FROM ({_TREE}))"""))
def g2(spark, d):
    # Sums are rounded before ranking, so that both engines see the same ties.
    levels = sh.rounded(views.run_view(fx.metrics_li(spark, d), _TREE_SPEC))
    return sh.wide_ints(views.sibling_rank(levels).drop("label", "value", "group_key"))


@query("G3_share_of_total", over("metrics_li", f"""
    SELECT scan_id, label, round(value / sum(value) OVER (PARTITION BY scan_id), 6) AS share FROM (
      SELECT scan_id, category || '/' || metric_key AS label, sum(value_after) AS value FROM {POSITIVE} GROUP BY ALL)"""))
def g3(spark, d):
    levels = views.run_view(fx.metrics_li(spark, d), ViewSpec("sum", group_by=("category", "metric_key")))
    shares = reshape.share(reshape.flatten_levels(levels))
    return shares.select("scan_id", "label", F.round("share", 6).alias("share"))


@query("G4_running_offsets", over("matches_char_diff_exact", """
    SELECT scan_id, file_path, analyzer_id, line_number, column_start, column_end, matched_text, side
    FROM matches_char_diff_exact"""))
def g4(spark, d):
    found = sh.matches(sh.diff(spark, d), "char")
    return sh.wide_ints(found.drop("context_before", "context_after"))


@query("G5_context_lines", over("matches_byte_snapshot_web", f"SELECT {MATCH} FROM matches_byte_snapshot_web"))
def g5(spark, d):
    return sh.wide_ints(sh.matches(sh.snapshot_web(spark, d), "byte"))


@query("G6_latest_scan", over("scans", """
    SELECT project_id, scan_mode, scan_id, commit_hash, scan_time FROM scans
    QUALIFY row_number() OVER (PARTITION BY project_id, scan_mode ORDER BY scan_time DESC, scan_id DESC) = 1"""))
def g6(spark, d):
    return catalog.latest_scan(fx.scans(spark, d))
