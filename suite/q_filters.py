"""B: projections, classification and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite import shapes as sh
from suite.oracle_tables import EXT, metrics_of, over
from suite.q_sources import FLAT, MATCH
from suite.registry import query
from treegauge.functions.paths import extension, matches_any_glob
from treegauge.operators import catalog, classify, matches, metrics, views
from treegauge.operators.analyzers import analyze
from treegauge.operators.diff import changed_paths
from treegauge.operators.reshape import leaves, search_leaves
from treegauge.specs import ViewSpec


@query("B1_extension", """
    SELECT path, CASE WHEN strpos(substr(name, 2), '.') = 0 THEN '' ELSE split_part(name, '.', -1) END AS extension
    FROM (SELECT path, split_part(path, '/', -1) AS name FROM (
      SELECT CASE source WHEN 'src0' THEN lang || '/' || doc_id || '/.' || lang
        WHEN 'src1' THEN 'a.' || doc_id || '/Makefile' WHEN 'src2' THEN doc_id || '.Tar.GZ'
        WHEN 'src3' THEN doc_id || '.' ELSE source || '/' || doc_id || '.' || lang END AS path
      FROM documents))""")
def b1(spark, d):
    path = F.expr("""CASE source WHEN 'src0' THEN concat(lang, '/', doc_id, '/.', lang)
        WHEN 'src1' THEN concat('a.', doc_id, '/Makefile') WHEN 'src2' THEN concat(doc_id, '.Tar.GZ')
        WHEN 'src3' THEN concat(doc_id, '.') ELSE concat(source, '/', doc_id, '.', lang) END""")
    return fx.table(spark, d, "documents").select(path.alias("path")).select(
        "path", extension(F.col("path")).alias("extension"))


@query("B2_tech_stack", over("files_base", """
    SELECT file_path, CASE WHEN file_path LIKE '%.rs' AND split_part(file_path, '/', 1) IN ('src0', 'src1') THEN 'Core'
      WHEN file_path LIKE '%.rs' AND file_path NOT LIKE 'src2/%' THEN 'Rust'
      WHEN file_path LIKE '%.java' THEN 'Java' WHEN file_path LIKE '%.py' THEN 'Python' END AS tech_stack
    FROM files_base"""))
def b2(spark, d):
    stack = classify.tech_stack(F.col("file_path"), fx.RULES)
    return fx.files_base(spark, d).select("file_path", stack.alias("tech_stack"))


@query("B3_excluded", over("files_base", """
    SELECT file_path, (split_part(file_path, '/', 1) = 'src3'
      OR (split_part(file_path, '/', 1) = 'src0' AND file_path NOT LIKE '%.rs')) AS excluded FROM files_base"""))
def b3(spark, d):
    excluded = classify.is_excluded(F.col("file_path"), fx.RULES)
    return fx.files_base(spark, d).select("file_path", excluded.alias("excluded"))


GLOBS = {
    "root_only": "*", "one_digit": "src?/en/*", "deep": "**/de/*.java", "any_case": "SRC[1-3]/**",
    "not_digit": "**/*[!0-4].rs", "prefix": "src1*/*/*", "invalid": "src**", "everything": "**",
}


@query("B4_glob", over("files_base", r"""
    SELECT file_path, NOT contains(file_path, '/') AS root_only,
      regexp_full_match(file_path, 'src[^/]/en/[^/]*') AS one_digit,
      split_part(file_path, '/', -2) = 'de' AND file_path LIKE '%.java' AS deep,
      split_part(file_path, '/', 1) IN ('src1', 'src2', 'src3') AS any_case,
      regexp_matches(file_path, '[5-9]\.rs$') AS not_digit,
      file_path LIKE 'src1%' AS prefix, FALSE AS invalid, TRUE AS everything FROM files_base"""))
def b4(spark, d):
    path = F.col("file_path")
    return fx.files_base(spark, d).select(
        "file_path", *[matches_any_glob(path, [g]).alias(name) for name, g in GLOBS.items()])


@query("B5_select_analyzers", over("snapshot", f"SELECT {FLAT} FROM ({metrics_of('snapshot')})"))
def b5(spark, d):
    return sh.flat(analyze(sh.snapshot(spark, d), fx.ANALYZERS, fx.RULES))


@query("B6_applicability", over("diff_exact", f"""
    SELECT {FLAT} FROM ({metrics_of('diff_exact')}) WHERE analyzer_id IN ('diff_only_finder', 'file_count')"""))
def b6(spark, d):
    return sh.flat(analyze(sh.diff(spark, d), [fx.DIFF_ONLY], fx.RULES).where("analyzer_id <> 'char_count'"))


@query("B7_excluded_changes", over("delta", f"""
    SELECT file_path, change_type, regexp_matches(file_path, '(^|/)src[03]/')
      AND NOT ({EXT} = 'rs' AND file_path LIKE 'src0/%') AS excluded FROM delta"""))
def b7(spark, d):
    changed = changed_paths(fx.files_base(spark, d), fx.files_target(spark, d))
    excluded = classify.is_excluded(F.col("file_path"), fx.RULES)
    return changed.select("file_path", "change_type", excluded.alias("excluded"))


@query("B8_drop_zero", over("metrics_li", """
    SELECT file_path, value_before, value_after FROM metrics_li
    WHERE NOT ((value_before IS NULL OR value_before = 0) AND (value_after IS NULL OR value_after = 0))"""))
def b8(spark, d):
    return metrics.drop_zero(fx.metrics_li(spark, d)).select("file_path", "value_before", "value_after")


@query("B9_source_filter", over("metrics_li", """
    SELECT scan_id, file_path, value_after FROM metrics_li
    WHERE analyzer_id IN ('an_0', 'an_2') AND category = 'size'"""))
def b9(spark, d):
    spec = ViewSpec("sum", ("an_0", "an_2"), tag_filters={"category": "size"})
    return views.source_filter(fx.metrics_li(spark, d), spec).select("scan_id", "file_path", "value_after")


@query("B9_tag_filter", over("metrics_li", """
    SELECT scan_id, file_path, value_after FROM metrics_li WHERE team = 't7' AND metric_key = 'm_3'"""))
def b9b(spark, d):
    spec = ViewSpec("sum", tag_filters={"team": "t7"}, metric_key="m_3")
    return views.source_filter(fx.metrics_li(spark, d), spec).select("scan_id", "file_path", "value_after")


@query("B10_request_filter", over("metrics_li", """
    SELECT scan_id, file_path, value_after FROM metrics_li WHERE tech_stack = 'Rust' AND category = 'logging'
      AND metric_key = 'm_1' AND change_type = 'D'"""))
def b10(spark, d):
    rows = views.request_filter(fx.metrics_li(spark, d), tech_stack="Rust", category="logging",
                                metric_key="m_1", change_type="D")
    return rows.select("scan_id", "file_path", "value_after")


@query("B11_positive", over("metrics_li", """
    SELECT scan_id, file_path, value_after FROM metrics_li WHERE value_after IS NOT NULL AND value_after > 0"""))
def b11(spark, d):
    return views.positive(fx.metrics_li(spark, d)).select("scan_id", "file_path", "value_after")


@query("B12_change_type_modes", over("metrics_li", """
    SELECT scan_id, 'switchable' AS mode, coalesce(tech_stack, 'Unknown') AS label, round(sum(value_after), 2) AS value
    FROM metrics_li WHERE value_after > 0 AND change_type = 'A' GROUP BY ALL
    UNION ALL
    SELECT scan_id, 'switched', coalesce(tech_stack, 'Unknown'), round(sum(value_after), 2)
    FROM metrics_li WHERE value_after > 0 AND change_type = 'M' GROUP BY ALL
    UNION ALL
    SELECT scan_id, 'all', coalesce(tech_stack, 'Unknown') || ':' || change_type, round(sum(value_after), 2)
    FROM metrics_li WHERE value_after > 0 GROUP BY ALL"""))
def b12(spark, d):
    m = fx.metrics_li(spark, d)
    one = ViewSpec("sum", group_by=("tech_stack",), change_type_mode="switchable")
    every = ViewSpec("sum", group_by=("tech_stack",), change_type_mode="all")
    first = views.run_view(m, one).select("scan_id", F.lit("switchable").alias("mode"), "label", "value")
    second = views.run_view(m, one, change_type="M").select("scan_id", F.lit("switched").alias("mode"), "label", "value")
    third = views.deepest(views.run_view(m, every)).select(
        "scan_id", F.lit("all").alias("mode"), F.concat_ws(":", "k1", "k2").alias("label"), "value")
    return sh.rounded(first.unionByName(second).unionByName(third))


_LEAVES = """(SELECT scan_id, file_path AS label, floor(value_after + 0.5) AS value,
    tech_stack AS "group" FROM metrics_li WHERE value_after > 0)"""


@query("B13_search_leaves", over("metrics_li", f"""
    SELECT 'text' AS how, * FROM {_LEAVES} WHERE contains(lower(label), '/p1') OR contains(lower("group"), '/p1')
    UNION ALL SELECT 'exact', * FROM {_LEAVES} WHERE contains(label, 'Rus') OR contains("group", 'Rus')
    UNION ALL SELECT 'regex', * FROM {_LEAVES} WHERE regexp_matches(lower(label), '_[12]\\.py$') OR regexp_matches(lower("group"), '_[12]\\.py$')
    UNION ALL SELECT 'invalid', * FROM {_LEAVES}""".replace("\\\\", "\\")))
def b13(spark, d):
    found = leaves(views.items(views.positive(fx.metrics_li(spark, d))), ["tech_stack"])
    ways = {
        "text": search_leaves(found, "/P1"), "exact": search_leaves(found, "Rus", case_sensitive=True),
        "regex": search_leaves(found, r"_[12]\.PY$", regex=True), "invalid": search_leaves(found, "(", regex=True),
    }
    out = None
    for how, rows in ways.items():
        rows = rows.select(F.lit(how).alias("how"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("B14_search_commits", over("commit_log", """
    SELECT hash, short_hash, message, author, timestamp FROM commit_log
    WHERE contains(lower(full_message), lower('"K": 2')) """))
def b14(spark, d):
    log = catalog.commit_log(fx.commits(spark, d))
    return catalog.search_commits(log, '"K": 2').drop("full_message")


@query("B15_list_scans", over("projects scans", """
    SELECT name AS project, scan_id, commit_hash, scan_time FROM scans JOIN projects USING (project_id)
    WHERE scan_mode = 'SNAPSHOT'"""))
def b15(spark, d):
    return catalog.list_scans(fx.projects(spark, d), fx.scans(spark, d))


@query("B15_scans_of_a_project", over("projects scans", """
    SELECT name AS project, scan_id, commit_hash, scan_time FROM scans JOIN projects USING (project_id)
    WHERE scan_mode = 'DIFF' AND name = (SELECT min(name) FROM projects JOIN scans USING (project_id) WHERE scan_mode = 'DIFF')"""))
def b15b(spark, d):
    projects, scans = fx.projects(spark, d), fx.scans(spark, d)
    first = catalog.scans_of(projects, scans.where("scan_mode = 'DIFF'")).agg(F.min("project")).first()[0]
    return catalog.list_scans(projects, scans, first, mode="DIFF")


@query("B16_hits_of_a_file", over("matches_byte_snapshot_log", f"""
    SELECT {MATCH} FROM matches_byte_snapshot_log WHERE file_path = (SELECT max(file_path) FROM matches_byte_snapshot_log)"""))
def b16b(spark, d):
    found = sh.matches(sh.snapshot_log(spark, d), "byte")
    return sh.wide_ints(matches.match_filter(found, 3, file_path=found.agg(F.max("file_path")).first()[0]))


@query("B16_match_filter", over("matches_byte_snapshot_log", f"""
    SELECT {MATCH} FROM matches_byte_snapshot_log WHERE analyzer_id = 'log_warn_finder'"""))
def b16(spark, d):
    found = sh.matches(sh.snapshot_log(spark, d), "byte")
    return sh.wide_ints(matches.match_filter(found, 3, analyzer_id="log_warn_finder"))
