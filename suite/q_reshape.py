"""H, I, J: set operations, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite import shapes as sh
from suite.oracle_tables import EXT, over
from suite.q_views import POSITIVE
from suite.registry import query
from treegauge.functions.tags import parse_tags
from treegauge.functions.text import first_line, newlines, round_half_up, strip
from treegauge.operators import catalog, metrics, reshape, views
from treegauge.operators.user_analyzers import analyzer_input
from treegauge.specs import ViewSpec


@query("H1_ordered_union", over("cfg_projects db_projects", """
    SELECT 0 AS section, name FROM cfg_projects
    UNION ALL SELECT 1, name FROM db_projects WHERE name NOT IN (SELECT name FROM cfg_projects)"""))
def h1(spark, d):
    return catalog.merge_names(fx.cfg_projects(spark, d), fx.db_projects(spark, d))


@query("H2_changed_files", over("metrics_diff", "SELECT DISTINCT scan_id, file_path, change_type FROM metrics_diff"))
def h2(spark, d):
    return metrics.changed_files(sh.metrics(sh.diff(spark, d)))


@query("H3_both_sides", over("matches_byte_diff_exact", """
    SELECT file_path, analyzer_id, side, count(*) AS n, CAST(sum(column_start) AS BIGINT) AS columns
    FROM matches_byte_diff_exact GROUP BY ALL"""))
def h3(spark, d):
    found = sh.matches(sh.diff(spark, d), "byte")
    return found.groupBy("file_path", "analyzer_id", "side").agg(
        F.count("*").alias("n"), F.sum("column_start").alias("columns"))


@query("H4_scan_modes", over("scans", """
    SELECT project_id, string_agg(DISTINCT scan_mode, ',' ORDER BY scan_mode) AS scan_modes FROM scans GROUP BY ALL"""))
def h4(spark, d):
    scans = fx.scans(spark, d)
    stats = catalog.project_stats(scans.select("project_id", F.lit("").alias("name")).distinct(), scans)
    return stats.select("project_id", "scan_modes")


@query("I1_heatmap", over("metrics_li", f"""
    SELECT scan_id, coalesce(tech_stack, 'Unknown') AS tech_stack, category,
      floor(round(sum(value_after), 2) + 0.5) AS value FROM {POSITIVE} GROUP BY ALL"""))
def i1(spark, d):
    return reshape.heatmap(views.view_items(fx.metrics_li(spark, d), ViewSpec("sum")))


@query("I2_stacked", over("metrics_li", f"""
    SELECT scan_id, label, coalesce(floor(max(value_after) FILTER (category = 'size') + 0.5), 0) AS size,
      coalesce(floor(max(value_after) FILTER (category = 'logging') + 0.5), 0) AS logging
    FROM (SELECT *, file_path AS label FROM {POSITIVE}) GROUP BY ALL"""))
def i2(spark, d):
    return reshape.stacked(views.view_items(fx.metrics_li(spark, d), ViewSpec("sum")), ["size", "logging"])


@query("I2_stacked_long", over("metrics_li", f"""
    SELECT scan_id, file_path AS label, category, floor(max(value_after) + 0.5) AS value FROM {POSITIVE} GROUP BY ALL"""))
def i2b(spark, d):
    return reshape.stacked(views.view_items(fx.metrics_li(spark, d), ViewSpec("sum")))


@query("I3_flatten_change_type", over("metrics_li", f"""
    SELECT scan_id, coalesce(tech_stack, 'Unknown') || ':' || category || '(' || change_type || ')' AS label,
      round(sum(value_after), 2) AS value FROM {POSITIVE} GROUP BY ALL
    UNION ALL SELECT scan_id, change_type, round(sum(value_after), 2) FROM {POSITIVE} GROUP BY ALL"""))
def i3(spark, d):
    m = fx.metrics_li(spark, d)
    deep = ViewSpec("sum", group_by=("tech_stack", "category"), change_type_mode="all")
    flat = ViewSpec("sum", change_type_mode="all")
    rows = reshape.flatten_change_type(views.run_view(m, deep))
    return sh.rounded(rows.unionByName(reshape.flatten_change_type(views.run_view(m, flat))))


@query("I4_flatten_levels", over("metrics_li", f"""
    SELECT scan_id, coalesce(tech_stack, 'Unknown') || '/' || {EXT} || '/' || team AS label,
      round(sum(value_after), 2) AS value FROM {POSITIVE} GROUP BY ALL"""))
def i4(spark, d):
    spec = ViewSpec("sum", group_by=("tech_stack", "extension", "tag:team"))
    return sh.rounded(reshape.flatten_levels(views.run_view(fx.metrics_li(spark, d), spec)))


@query("I5_leaves", over("metrics_li", f"""
    SELECT scan_id, file_path AS label, floor(value_after + 0.5) AS value,
      CASE WHEN tech_stack IS NULL THEN '' ELSE tech_stack || ':' END || category || '(' || change_type || ')' AS "group"
    FROM {POSITIVE}"""))
def i5(spark, d):
    spec = ViewSpec("sum", group_by=("tech_stack", "category"), change_type_mode="all")
    found = views.view_items(fx.metrics_li(spark, d), spec)
    return reshape.leaves(found, views.effective_keys(spec))


@query("I6_share", over("metrics_li", f"""
    SELECT scan_id, label, round(value, 2) AS value, round(value / sum(value) OVER (PARTITION BY scan_id), 6) AS share
    FROM (SELECT scan_id, coalesce(tech_stack, 'Unknown') AS label, sum(value_after) AS value FROM {POSITIVE} GROUP BY ALL)"""))
def i6(spark, d):
    spec = ViewSpec("sum", group_by=("tech_stack",), include_children=False)
    shares = reshape.share(views.run_view(fx.metrics_li(spark, d), spec).select("scan_id", "label", "value"))
    return sh.rounded(shares).withColumn("share", F.round("share", 6))


@query("I7_short_label", over("metrics_li", """
    SELECT scan_id, file_path AS label, split_part(file_path, '/', -1) AS short_label FROM metrics_li"""))
def i7(spark, d):
    return reshape.short_label(views.items(fx.metrics_li(spark, d))).select("scan_id", "label", "short_label")


@query("I8_log_levels", over("metrics_log", """
    SELECT scan_id, coalesce(sum(value_after) FILTER (metric_key = 'log_error'), 0) AS error,
      coalesce(sum(value_after) FILTER (metric_key = 'log_warn'), 0) AS warn,
      coalesce(sum(value_after) FILTER (metric_key = 'log_info'), 0) AS info FROM metrics_log GROUP BY scan_id"""))
def i8(spark, d):
    return reshape.log_levels(views.view_items(sh.metrics(sh.snapshot_log(spark, d)), ViewSpec("sum")))


@query("J_json_tags", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
      '{"file_path":"' || event_type || '","content":"' || replace(props, '"', '\\"') || '","change_type":"A"}' AS input
    FROM events""".replace("\\\\", "\\"))
def j1(spark, d):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("["), "props")).otherwise(F.col("props"))
    return fx.table(spark, d, "events").select(
        "event_id", parse_tags(text)["k"].cast("bigint").alias("k"),
        analyzer_input(F.col("event_type"), F.col("props"), F.lit("A")).alias("input"))


@query("J_text_functions", r"""
    SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, len(string_split(text, chr(10))) - 1 AS newlines,
      md5(split_part(text, chr(10), 1)) AS first_line,
      md5(regexp_replace(chr(9) || ' ' || text || chr(13) || chr(10), '^\s+|\s+$', '', 'g')) AS stripped FROM documents""")
def j2(spark, d):
    text = F.col("text")
    padded = F.concat(F.lit("\t "), text, F.lit("\r\n"))
    return fx.table(spark, d, "documents").select(
        "doc_id", F.length(text).cast("bigint").alias("chars"), F.octet_length(text).cast("bigint").alias("bytes"),
        newlines(text).cast("bigint").alias("newlines"), F.md5(first_line(text)).alias("first_line"),
        F.md5(strip(padded)).alias("stripped"))


@query("J_rounding", """
    SELECT s_suppkey, floor(s_acctbal + 0.5) AS whole, floor(-s_acctbal * 10 + 0.5) AS tenths FROM supplier
    UNION ALL SELECT c_custkey, floor(c_acctbal + 0.5), floor(-c_acctbal * 10 + 0.5) FROM customer""")
def j3(spark, d):
    def values(table, key, value):
        v = F.col(value)
        return fx.table(spark, d, table).select(
            F.col(key).alias("s_suppkey"), round_half_up(v).alias("whole"), round_half_up(-v * 10).alias("tenths"))

    return values("supplier", "s_suppkey", "s_acctbal").unionByName(values("customer", "c_custkey", "c_acctbal"))
