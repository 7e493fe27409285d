"""C: analyzers."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite import shapes as sh
from suite.oracle_tables import FOLD, GOSU_SQL, JAVA_SQL, count_sql, over
from suite.q_sources import FLAT, MATCH
from suite.registry import query
from suite.user_code import complexity_with_matches, fails_on_some_files, letters
from treegauge.functions.tags import merge_tags, tag_literal, tags_key
from treegauge.operators import matches, metrics
from treegauge.operators.user_analyzers import (
    run_user_analyzers,
    user_entries,
    user_errors,
    user_matches,
)
from treegauge.plans.presets import API_KEY_FINDER, LOG_LEVELS, TODO_FINDER
from treegauge.specs import PythonAnalyzer, ScanRules, StackRule


def _metric(table: str, ids: list[str]) -> str:
    names = ", ".join(f"'{i}'" for i in ids)
    return over(table, f"SELECT {FLAT} FROM {table} WHERE analyzer_id IN ({names})")


def _only(spark, d, ids, changes=None):
    rows = sh.metrics((changes or sh.snapshot)(spark, d), [a for a in fx.ANALYZERS if a.analyzer_id in ids])
    return sh.flat(rows.where(F.col("analyzer_id").isin(ids)))


@query("C1_file_count", _metric("metrics_snapshot", ["file_count"]))
def c1(spark, d):
    return _only(spark, d, ["file_count"])


@query("C2_char_count", _metric("metrics_diff", ["char_count"]))
def c2(spark, d):
    return _only(spark, d, ["char_count"], sh.diff)


@query("C3_regex_count", _metric("metrics_snapshot", ["word_finder", "span_finder"]))
def c3(spark, d):
    return _only(spark, d, ["word_finder", "span_finder"])


@query("C4_match_extraction", over("matches_byte_snapshot", f"SELECT {MATCH} FROM matches_byte_snapshot"))
def c4(spark, d):
    return sh.wide_ints(sh.matches(sh.snapshot(spark, d), "byte"))


@query("C5_java_complexity", over("files_base files_web", f"""
    SELECT file_path, {count_sql(JAVA_SQL, 1, 'body')} AS value FROM (
      SELECT file_path, {FOLD.format('content')} AS body FROM files_base WHERE content IS NOT NULL
      UNION ALL SELECT file_path, {FOLD.format('content')} FROM files_web)"""))
def c5(spark, d):
    return _everywhere(spark, d, "java_complexity")


@query("C6_gosu_complexity", over("files_base files_web", f"""
    SELECT file_path, {count_sql(GOSU_SQL, 1, 'body')} AS value FROM (
      SELECT file_path, {FOLD.format('content')} AS body FROM files_base WHERE content IS NOT NULL
      UNION ALL SELECT file_path, {FOLD.format('content')} FROM files_web)"""))
def c6(spark, d):
    return _everywhere(spark, d, "gosu_complexity")


def _everywhere(spark, d, analyzer_id):
    """One analyzer on every file of both trees."""
    from treegauge.sources.files import snapshot_changes, spread

    rules = ScanRules((StackRule("All", ("rs", "java", "py", "md", "html"), (analyzer_id,)),))
    files = fx.files_base(spark, d).unionByName(fx.files_web(spark, d))
    rows = sh.analyze(snapshot_changes(spread(files), rules, 1), fx.ANALYZERS, rules)
    return rows.where(F.col("analyzer_id") == analyzer_id).select("file_path", F.col("value_after").alias("value"))


@query("C7_complexity_matches", over("matches_char_snapshot", f"SELECT {MATCH} FROM matches_char_snapshot"))
def c7(spark, d):
    return sh.wide_ints(sh.matches(sh.snapshot(spark, d), "char"))


@query("C8_log_levels", _metric("metrics_log", [a.analyzer_id for a in LOG_LEVELS]))
def c8(spark, d):
    return _only(spark, d, [a.analyzer_id for a in LOG_LEVELS], sh.snapshot_log)


@query("C9_todo_and_keys", over("matches_byte_snapshot_log", f"""
    SELECT {MATCH} FROM matches_byte_snapshot_log WHERE analyzer_id IN ('todo_finder', 'api_key_finder')"""))
def c9(spark, d):
    from treegauge.operators.matches import extract_matches

    found = extract_matches(sh.snapshot_log(spark, d), [TODO_FINDER, API_KEY_FINDER], fx.RULES)
    return sh.wide_ints(found)


@query("C10_resolved_tags", over("matches_byte_snapshot_log", """
    SELECT file_path, analyzer_id, line_number, column_start, CASE analyzer_id
        WHEN 'log_info_finder' THEN 'log_info' WHEN 'log_warn_finder' THEN 'log_warn'
        WHEN 'log_error_finder' THEN 'log_error' WHEN 'log_trace_finder' THEN 'log_trace'
        WHEN 'log_debug_finder' THEN 'log_debug' WHEN 'markup_finder' THEN 'markup' ELSE 'matches' END AS metric_key,
      CASE WHEN analyzer_id LIKE 'log%' THEN 'logging' WHEN analyzer_id = 'markup_finder' THEN 'text' END AS category
    FROM matches_byte_snapshot_log"""))
def c10(spark, d):
    found = matches.with_tags(sh.matches(sh.snapshot_log(spark, d), "byte"), fx.ANALYZERS)
    return sh.wide_ints(found.select(
        "file_path", "analyzer_id", "line_number", "column_start",
        F.col("tags")["metric"].alias("metric_key"), F.col("tags")["category"].alias("category")))


@query("C11_merge_tags", over("metrics_li", """
    SELECT file_path, metric_key, CASE tech_stack WHEN 'Rust' THEN 'maintainability' ELSE category END AS category,
      team, CASE tech_stack WHEN 'Rust' THEN 'yes' END AS extra FROM metrics_li"""))
def c11(spark, d):
    overrides = F.when(F.col("tech_stack") == "Rust", tag_literal({"category": "maintainability", "extra": "yes"})
                       ).otherwise(tag_literal({}))
    tags = merge_tags(F.col("tags"), overrides)
    return fx.metrics_li(spark, d).select("file_path", tags.alias("t")).select(
        "file_path", F.col("t")["metric"].alias("metric_key"), F.col("t")["category"].alias("category"),
        F.col("t")["team"].alias("team"), F.col("t")["extra"].alias("extra"))


@query("C12_tags_key", over("metrics_li", """
    SELECT '{"category":"' || category || '","metric":"' || metric_key || '","team":"' || team || '"}' AS tags_key,
      count(*) AS n FROM metrics_li GROUP BY 1"""))
def c12(spark, d):
    return fx.metrics_li(spark, d).groupBy(tags_key(F.col("tags")).alias("tags_key")).agg(F.count("*").alias("n"))


_USER_RULES = ScanRules((
    StackRule("All", ("rs", "java", "py", "md"), ("py_complexity", "letters", "picky")),
))


def _user_changes(spark, d):
    from treegauge.operators.diff import version_diff

    base, target = fx.files_base(spark, d), fx.files_target(spark, d)
    return version_diff(base, target, _USER_RULES, F.lit(7).cast("bigint"), "exact")


@query("C13_user_analyzer", over("delta_renamed", f"""
    SELECT file_path, 'py_complexity' AS analyzer_id, 'complexity' AS metric_key, 'maintainability' AS category,
      CASE WHEN old_content IS NOT NULL THEN {count_sql(JAVA_SQL, 1, FOLD.format('old_content'))} END AS value_before,
      CASE WHEN content IS NOT NULL THEN {count_sql(JAVA_SQL, 1, FOLD.format('content'))} END AS value_after
    FROM delta_renamed WHERE content IS NOT NULL OR old_content IS NOT NULL
    UNION ALL
    SELECT file_path, 'letters', 'last', NULL,
      CAST(length(old_content) AS DOUBLE), CAST(length(content) AS DOUBLE)
    FROM delta_renamed WHERE content IS NOT NULL OR old_content IS NOT NULL"""))
def c13(spark, d):
    analyzers = [
        PythonAnalyzer("py_complexity", {"category": "maintainability"}, func=complexity_with_matches),
        PythonAnalyzer("letters", func=letters),
    ]
    results = run_user_analyzers(_user_changes(spark, d), analyzers, _USER_RULES)
    rows = metrics.merge_before_after(user_entries(results))
    return rows.select("file_path", "analyzer_id", F.col("tags")["metric"].alias("metric_key"),
                       F.col("tags")["category"].alias("category"), "value_before", "value_after")


@query("C13_user_matches", over("delta_renamed", f"""
    SELECT file_path, side, len(regexp_extract_all(body, '\\bif\\b')) AS n_if,
      len(regexp_extract_all(body, '\\bfor\\b')) AS n_for
    FROM (SELECT file_path, 'after' AS side, {FOLD.format('content')} AS body FROM delta_renamed WHERE content IS NOT NULL
      UNION ALL SELECT coalesce(old_file_path, file_path), 'before', {FOLD.format('old_content')} FROM delta_renamed
      WHERE old_content IS NOT NULL)
    WHERE regexp_matches(body, '\\bif\\b|\\bfor\\b')"""))
def c13m(spark, d):
    results = run_user_analyzers(
        _user_changes(spark, d), [PythonAnalyzer("py_complexity", func=complexity_with_matches)], _USER_RULES)
    found = user_matches(results).where("matched_text IN ('if', 'for')")
    return found.groupBy("file_path", "side").agg(
        F.count_if(F.col("matched_text") == "if").alias("n_if"),
        F.count_if(F.col("matched_text") == "for").alias("n_for"))


@query("C14_error_isolation", over("delta_renamed", """
    SELECT 'picky' AS analyzer_id, side, file_path || ': no accents please' AS error
    FROM (SELECT file_path, 'after' AS side, content AS body FROM delta_renamed WHERE content IS NOT NULL
      UNION ALL SELECT coalesce(old_file_path, file_path), 'before', old_content FROM delta_renamed
      WHERE old_content IS NOT NULL) WHERE contains(body, 'ó')"""))
def c14(spark, d):
    results = run_user_analyzers(
        _user_changes(spark, d), [PythonAnalyzer("picky", func=fails_on_some_files)], _USER_RULES)
    return user_errors(results).select("analyzer_id", "side", "error")


@query("C15_tag_keys", over("metrics_li", """
    SELECT DISTINCT scan_id, k AS tag_key FROM metrics_li, (VALUES ('metric'), ('category'), ('team')) t(k)"""))
def c15(spark, d):
    return metrics.tag_keys(fx.metrics_li(spark, d))
