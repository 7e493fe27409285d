"""D: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite import shapes as sh
from suite.oracle_tables import over
from suite.q_sources import FLAT
from suite.registry import query
from treegauge.operators import catalog, diff, matches, metrics, renames
from treegauge.session import cut_lineage


@query("D1_before_after", over("metrics_diff", f"SELECT {FLAT} FROM metrics_diff"))
def d1(spark, d):
    return sh.flat(sh.metrics(sh.diff(spark, d)))


@query("D1_user_merge", """
    SELECT l_orderkey AS scan_id, l_returnflag AS tag,
      arg_max(l_quantity, l_linenumber) FILTER (l_linestatus = 'F') AS value_before,
      arg_max(l_quantity, l_linenumber) FILTER (l_linestatus <> 'F') AS value_after
    FROM (SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, max(l_quantity) AS l_quantity
          FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def d1b(spark, d):
    """Line items as one-sided entries of the file that is their order. Equal line numbers of an
    order are made one entry first, so that 'last' is well defined."""
    keys = ["l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"]
    one = sh.line_items(spark, d, *keys, "l_quantity").groupBy(*keys).agg(F.max("l_quantity").alias("value"))
    none = F.lit(None).cast("string")
    entries = one.select(
        F.col("l_orderkey").alias("scan_id"), F.lit("f").alias("file_path"), F.lit("M").alias("change_type"),
        none.alias("old_file_path"), none.alias("tech_stack"), F.lit("user").alias("analyzer_id"),
        F.create_map(F.lit("tag"), "l_returnflag").alias("tags"), none.alias("scope"),
        F.when(F.col("l_linestatus") == "F", "before").otherwise("after").alias("side"),
        F.col("l_linenumber").alias("seq"), "value")
    merged = metrics.merge_before_after(entries)
    return merged.select("scan_id", F.col("tags")["tag"].alias("tag"), "value_before", "value_after")


@query("D2_version_join", over("delta", """
    SELECT file_path, change_type, md5(old_content) AS old_digest, md5(content) AS new_digest FROM delta"""))
def d2(spark, d):
    changed = diff.changed_paths(fx.files_base(spark, d), fx.files_target(spark, d))
    return changed.select("file_path", "change_type", "old_digest", "new_digest")


@query("D3_exact_renames", over("rename_pairs", "SELECT old_path, new_path FROM rename_pairs"))
def d3(spark, d):
    changed = cut_lineage(diff.changed_paths(fx.files_base(spark, d), fx.files_target(spark, d)))
    return renames.exact_pairs(changed).select("old_path", "new_path")


@query("D3_alike_pairs", over("delta", r"""
    SELECT * FROM (WITH lines AS (
      SELECT DISTINCT change_type, file_path, trim(unnest(string_split_regex(coalesce(old_content, content), '\r?\n')), ' ') AS line
      FROM delta WHERE change_type IN ('A', 'D') AND coalesce(old_content, content) IS NOT NULL),
    sizes AS (SELECT change_type, file_path, count(*) AS n FROM lines WHERE line <> '' GROUP BY ALL),
    common AS (
      SELECT o.file_path AS old_path, n.file_path AS new_path, count(*) AS c
      FROM lines o JOIN lines n USING (line) WHERE o.change_type = 'D' AND n.change_type = 'A' AND line <> '' GROUP BY ALL)
    SELECT old_path, new_path, c / (a.n + b.n - c) AS score
    FROM common JOIN sizes a ON a.file_path = old_path AND a.change_type = 'D' JOIN sizes b ON b.file_path = new_path AND b.change_type = 'A'
    WHERE c * 2 >= a.n + b.n - c)"""))
def d3c(spark, d):
    base, target = fx.files_base(spark, d), fx.files_target(spark, d)
    return renames.alike_pairs(diff.changed_paths(base, target), base, target).select("old_path", "new_path", "score")


@query("D3_similar_renames")
def d3b(spark, d):
    changes = sh.diff(spark, d, "similar")
    return changes.where("change_type = 'M' AND old_file_path IS NOT NULL").select("file_path", "old_file_path")


_STATS = """
    SELECT project_id, name, count(scan_id) AS total_scans, max(scan_time) AS last_scan_time,
      string_agg(DISTINCT scan_mode, ',' ORDER BY scan_mode) AS scan_modes
    FROM projects LEFT JOIN scans USING (project_id) GROUP BY ALL"""


@query("D4_projects_left_join", over("projects scans", _STATS))
def d4(spark, d):
    return catalog.project_stats(fx.projects(spark, d), fx.scans(spark, d))


@query("D5_unified_projects", over("cfg_projects db_projects cached_repos", """
    SELECT name, c.name IS NOT NULL AS has_config, c.repo_path AS config_repo_path,
      r.name IS NOT NULL AS has_cached_repo, r.repo_id AS cached_repo_id,
      r.branch AS cached_repo_branch, coalesce(s.total_scans, 0) AS total_scans, s.last_scan_time, s.scan_modes
    FROM cfg_projects c FULL OUTER JOIN db_projects s USING (name) FULL OUTER JOIN cached_repos r USING (name)"""))
def d5(spark, d):
    return catalog.unified_projects(
        fx.cfg_projects(spark, d), fx.db_projects(spark, d), fx.cached_repos(spark, d))


@query("D6_scan_lookup", over("projects scans", """
    SELECT name AS project, scan_id, scan_mode FROM projects JOIN scans USING (project_id)"""))
def d6(spark, d):
    return catalog.scans_of(fx.projects(spark, d), fx.scans(spark, d)).select("project", "scan_id", "scan_mode")


@query("D7_drilldown", over("metrics_log matches_byte_snapshot_log", """
    SELECT m.scan_id, m.file_path, m.analyzer_id, line_number, matched_text, value_after
    FROM matches_byte_snapshot_log m JOIN metrics_log t USING (scan_id, file_path, analyzer_id)
    WHERE category = 'logging'"""))
def d7(spark, d):
    changes = sh.snapshot_log(spark, d)
    chosen = sh.metrics(changes).where(F.col("tags")["category"] == "logging")
    found = matches.drilldown(chosen, sh.matches(changes, "byte"))
    return sh.wide_ints(found.select("scan_id", "file_path", "analyzer_id", "line_number", "matched_text", "value_after"))


@query("D8_purge_project", over("projects scans", """
    SELECT 'project' AS kind, project_id AS id FROM projects WHERE name <> (SELECT min(c_name) FROM customer)
    UNION ALL SELECT 'scan', scan_id FROM scans WHERE project_id NOT IN
      (SELECT c_custkey FROM customer WHERE c_name = (SELECT min(c_name) FROM customer))
    UNION ALL SELECT 'metric', l_orderkey FROM lineitem WHERE l_orderkey NOT IN
      (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_name = (SELECT min(c_name) FROM customer))"""))
def d8(spark, d):
    projects = fx.projects(spark, d)
    name = projects.agg(F.min("name")).first()[0]
    left = catalog.purge_project({
        "projects": projects, "scans": fx.scans(spark, d),
        "metrics": fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"))}, name)
    return (left["projects"].select(F.lit("project").alias("kind"), F.col("project_id").alias("id"))
            .unionByName(left["scans"].select(F.lit("scan").alias("kind"), F.col("scan_id").alias("id")))
            .unionByName(left["metrics"].select(F.lit("metric").alias("kind"), F.col("scan_id").alias("id"))))


@query("D9_tag_lookup", over("matches_byte_diff_exact", """
    SELECT analyzer_id, side, CASE analyzer_id WHEN 'word_finder' THEN 'words' WHEN 'span_finder' THEN 'spans'
        WHEN 'review_finder' THEN 'review' WHEN 'diff_only_finder' THEN 'ly' ELSE 'matches' END AS metric_key,
      CASE WHEN analyzer_id NOT IN ('todo_finder', 'api_key_finder') THEN 'text' END AS category, count(*) AS n
    FROM matches_byte_diff_exact GROUP BY ALL"""))
def d9(spark, d):
    found = matches.with_tags(sh.matches(sh.diff(spark, d), "byte"), fx.ANALYZERS)
    return found.groupBy("analyzer_id", "side", F.col("tags")["metric"].alias("metric_key"),
                         F.col("tags")["category"].alias("category")).agg(F.count("*").alias("n"))
