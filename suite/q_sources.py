"""A: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import fixtures as fx
from suite import shapes as sh
from suite.oracle_tables import over
from suite.registry import query
from treegauge.operators import catalog, metrics
from treegauge.operators.reshape import leaves
from treegauge.operators.user_analyzers import entry_tags, parse_analyzer_output
from treegauge.operators.views import items
from treegauge.session import shared_path
from treegauge.sources.files import decode_files
from treegauge.sources.store import ScanStore
from treegauge.sources.tables import (
    export_csv,
    read_csv_export,
    read_scan_table,
    write_scan_table,
)

FLAT = ("scan_id, file_path, change_type, old_file_path, tech_stack, analyzer_id, metric_key, "
        "category, value_before, value_after")
CHANGE = ("scan_id, scan_mode, file_path, change_type, old_file_path, tech_stack, "
          "md5(content) AS digest, md5(old_content) AS old_digest")


def digested(changes):
    return changes.selectExpr(*[c.strip() for c in CHANGE.split(",")])


@query("A1_snapshot_scan", over("snapshot", f"SELECT {CHANGE} FROM snapshot"))
def a1(spark, d):
    return digested(sh.snapshot(spark, d))


@query("A2_version_diff", over("diff_plain", f"SELECT {CHANGE} FROM diff_plain"))
def a2(spark, d):
    return digested(sh.diff(spark, d, None))


@query("A3_decode_content", over("files_base", """
    SELECT source || '/' || lang || '/' || doc_id AS name,
      md5(CASE WHEN lang = 'es' AND strlen(text) <> length(text) THEN NULL
               WHEN lang <> 'es' AND source = 'src6' THEN NULL ELSE text END) AS digest
    FROM documents"""))
def a3(spark, d):
    name = F.regexp_replace("file_path", r"\.[a-z]+$", "")
    return decode_files(fx.files_raw(spark, d)).select(name.alias("name"), F.md5("content").alias("digest"))


@query("A4_write_metrics", over("metrics_snapshot", f"SELECT {FLAT} FROM metrics_snapshot"))
def a4(spark, d):
    path = shared_path(spark, "metrics")
    write_scan_table(sh.metrics(sh.snapshot(spark, d)), path)
    return sh.flat(read_scan_table(spark, path)).withColumn("scan_id", F.col("scan_id").cast("bigint"))


MATCH = ("scan_id, file_path, analyzer_id, line_number, column_start, column_end, matched_text, "
         "context_before, context_after, side")


@query("A5_write_matches", over("matches_byte_snapshot_log", f"SELECT {MATCH} FROM matches_byte_snapshot_log"))
def a5(spark, d):
    path = shared_path(spark, "matches")
    write_scan_table(sh.matches(sh.snapshot_log(spark, d), "byte"), path)
    found = sh.wide_ints(read_scan_table(spark, path))
    return found.select(*[c.strip() for c in MATCH.split(",")])


@query("A6_upsert_projects", """
    SELECT c_custkey AS project_id, c_name AS name, '/repos/' || c_name ||
           CASE WHEN c_acctbal < 0 THEN '/new' ELSE '' END AS repo_path,
           TIMESTAMP '2020-01-01 00:00:00' AS created_at FROM customer
    UNION ALL
    SELECT -c_custkey, 'new ' || c_name, '/repos/' || c_name || '/new', TIMESTAMP '2024-01-01 00:00:00'
    FROM customer WHERE c_acctbal >= 0""")
def a6(spark, d):
    incoming = fx.table(spark, d, "customer").select(
        (-F.col("c_custkey")).alias("project_id"),
        F.expr("CASE WHEN c_acctbal < 0 THEN c_name ELSE concat('new ', c_name) END").alias("name"),
        F.expr("concat('/repos/', c_name, '/new')").alias("repo_path"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("created_at"),
    )
    return catalog.upsert_projects(fx.projects(spark, d), incoming)


@query("A7_append_scans", over("scans", """
    SELECT scan_id, project_id, commit_hash, scan_mode, scan_time, CAST(NULL AS VARCHAR) AS base_commit_hash
    FROM scans UNION ALL
    SELECT -scan_id, project_id, 'next' || scan_id, 'DIFF', scan_time, commit_hash FROM scans"""))
def a7(spark, d):
    old = fx.scans(spark, d).withColumn("base_commit_hash", F.lit(None).cast("string"))
    new = old.select(
        (-F.col("scan_id")).alias("scan_id"), "project_id",
        F.expr("concat('next', cast(scan_id AS string))").alias("commit_hash"),
        F.lit("DIFF").alias("scan_mode"), "scan_time", F.col("commit_hash").alias("base_commit_hash"),
    )
    return catalog.append_scans(old, new)


SUMMARY = """
    SELECT scan_id, (SELECT count(*) FROM {0}) AS total_files_scanned,
      CAST(count(*) AS BIGINT) AS total_analyzers_loaded,
      CAST(count_if(n > 0) AS BIGINT) AS total_analyzers_executed, CAST(sum(n) AS BIGINT) AS total_analyzer_executions,
      CAST(0 AS BIGINT) AS total_errors
    FROM ({1}) GROUP BY scan_id"""


def _runs_sql(changes: str, scan_id: int) -> str:
    from suite.oracle_tables import FINDERS

    gates = {"file_count": "TRUE", "char_count": "tech_stack IS NOT NULL",
             **{name: f[0] for name, f in FINDERS.items()}}
    one = "CAST({} IS NOT NULL AS BIGINT)"
    return " UNION ALL ".join(
        f"SELECT CAST({scan_id} AS BIGINT) AS scan_id, '{name}' AS analyzer_id, "
        f"CAST(coalesce(sum({one.format('content')} + {one.format('old_content')}) FILTER ({gate}), 0) AS BIGINT) AS n "
        f"FROM {changes}" for name, gate in gates.items())


@query("A8_write_summary", over("diff_exact", f"""
    SELECT *, '["broken.wasm: bad header"]' AS load_errors,
      (SELECT '[' || string_agg('{{"analyzer_id":"' || analyzer_id || '","files_analyzed":' || n ||
              ',"execution_errors":0,"error_details":[]}}', ',' ORDER BY analyzer_id) || ']'
       FROM ({_runs_sql('diff_exact', 7)})) AS analyzer_stats
    FROM ({SUMMARY.format('diff_exact', _runs_sql('diff_exact', 7))})"""))
def a8(spark, d):
    changes = sh.diff(spark, d)
    stats = metrics.analyzer_stats(metrics.analyzer_runs(changes, fx.ANALYZERS, fx.RULES))
    record = metrics.summary_record(stats, ["broken.wasm: bad header"])
    path = shared_path(spark, "summaries")
    write_scan_table(record, path)
    return read_scan_table(spark, path).withColumn("scan_id", F.col("scan_id").cast("bigint"))


@query("A9_parse_analyzer_output", """
    SELECT event_id, CAST(n AS BIGINT) AS pos, value + n AS value,
      CASE n WHEN 0 THEN event_type ELSE 'own' END AS metric_key, 'cat' || user_id AS category,
      CASE n WHEN 0 THEN NULL ELSE 'v' || user_id END AS extra
    FROM events, (VALUES (0), (1)) t(n) WHERE event_type NOT IN ('error', 'view')""")
def a9(spark, d):
    text = F.expr("""concat('[{"value":', cast(value AS string), ',"tags":{"category":"cat', cast(user_id AS string),
        '"},"metric_key":"', event_type, '"},{"value":', CASE WHEN event_type = 'view' THEN '"none"'
        ELSE cast(value + 1 AS string) END, ',"tags":{"metric":"own","x":"v', cast(user_id AS string),
        '"},"category":"cat', cast(user_id AS string), '"}', CASE WHEN event_type = 'error' THEN '' ELSE ']' END)""")
    entries = fx.table(spark, d, "events").select(
        "event_id", F.posexplode(parse_analyzer_output(text)).alias("pos", "e"))
    tagged = entries.withColumn("tags", entry_tags(F.col("e")))
    return tagged.select(
        "event_id", F.col("pos").cast("bigint").alias("pos"), "e.value", F.col("tags")["metric"].alias("metric_key"),
        F.col("tags")["category"].alias("category"), F.col("tags")["x"].alias("extra"))


@query("A10_commit_log", over("commit_log", "SELECT * FROM commit_log"))
def a10(spark, d):
    return catalog.commit_log(fx.commits(spark, d))


@query("A11_export_csv", over("metrics_li", """
    SELECT 'team "' || tech_stack || '"(' || change_type || ')' AS "Group", file_path AS "Label",
           CAST(floor(value_after + 0.5) AS BIGINT) AS "Value"
    FROM metrics_li WHERE value_after > 0 AND tech_stack IS NOT NULL
    UNION ALL SELECT '(' || change_type || ')', file_path, CAST(floor(value_after + 0.5) AS BIGINT)
    FROM metrics_li WHERE value_after > 0 AND tech_stack IS NULL"""))
def a11(spark, d):
    rows = fx.metrics_li(spark, d).where("value_after > 0").withColumn(
        "tech_stack", F.concat(F.lit('team "'), "tech_stack", F.lit('"')))
    path = shared_path(spark, "csv")
    export_csv(leaves(items(rows), ["tech_stack", "change_type"]), path, with_group=True)
    return read_csv_export(spark, path, with_group=True)


@query("A8_error_details", over("snapshot", """
    SELECT analyzer_id, count(*) AS execution_errors, string_agg(file_path || ': accent', '|' ORDER BY file_path || ': accent') AS details
    FROM (SELECT file_path, CASE tech_stack WHEN 'Java' THEN 'java_complexity' ELSE 'char_count' END AS analyzer_id
          FROM snapshot WHERE contains(content, 'ü') AND tech_stack IS NOT NULL) GROUP BY 1"""))
def a8b(spark, d):
    """A stored summary with the texts of failed runs; those that it does not quote come from the stored error table."""
    changes = sh.snapshot(spark, d)
    failing = F.when(F.col("tech_stack") == "Java", "java_complexity").otherwise("char_count")
    failed = changes.where(F.contains("content", F.lit("ü")) & F.col("tech_stack").isNotNull()).select(
        "scan_id", failing.alias("analyzer_id"), F.concat("file_path", F.lit(": accent")).alias("error"))
    store = ScanStore(spark, shared_path(spark, "store"))
    store.write_facts({"errors": failed}, [1])
    errors = store.read_facts("errors", 1, failed.schema)
    stats = metrics.analyzer_stats(metrics.analyzer_runs(changes, fx.ANALYZERS, fx.RULES), errors)
    store.write_facts({"summaries": metrics.summary_record(stats, errors=errors)}, [1])
    stored = metrics.read_summary(store.read_facts("summaries", 1)).select("scan_id", F.inline("analyzer_stats"))
    return metrics.all_error_details(stored, errors).where("execution_errors > 0").select(
        "analyzer_id", "execution_errors", F.array_join("error_details", "|").alias("details"))


@query("A4_rescan", over("metrics_li", """
    SELECT CAST(CASE WHEN scan_id = 1996 THEN 1 ELSE 0 END AS BIGINT) AS rescanned, scan_id, count(*) AS n FROM metrics_li
    WHERE scan_id NOT IN (1994, 1996) OR (scan_id = 1996 AND value_after > 30000) GROUP BY ALL"""))
def a4b(spark, d):
    """Two scans are written again: one with fewer rows, one without any."""
    store = ScanStore(spark, shared_path(spark, "store"))
    rows = fx.metrics_li(spark, d)
    store.write_facts({"metrics": rows}, range(1990, 2000))
    store.write_facts({"metrics": rows.where("scan_id = 1996 AND value_after > 30000")}, [1994, 1996])
    left = store.read_facts("metrics").select(F.col("scan_id").cast("bigint").alias("scan_id"))
    return left.groupBy((F.col("scan_id") == 1996).cast("bigint").alias("rescanned"), "scan_id").agg(F.count("*").alias("n"))


@query("D8_purge_stored", over("projects scans", """
    SELECT 'project' AS kind, count(*) AS n FROM projects WHERE name <> (SELECT min(c_name) FROM customer JOIN orders ON o_custkey = c_custkey)
    UNION ALL SELECT 'scan', count(*) FROM scans WHERE project_id NOT IN (SELECT c_custkey FROM customer
      WHERE c_name = (SELECT min(c_name) FROM customer JOIN orders ON o_custkey = c_custkey))
    UNION ALL SELECT 'fact', count(*) FROM scans WHERE project_id IN
      (SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY c_name LIMIT 5 OFFSET 1)"""))
def d8b(spark, d):
    """A stored tree of tables loses a project. A fact row for each scan of the first six projects that have any."""
    projects, scans = fx.projects(spark, d), fx.scans(spark, d)
    first = projects.join(scans, "project_id", "left_semi").orderBy("name").limit(6)
    facts = scans.join(first, "project_id", "left_semi").select("scan_id", "commit_hash")
    store = ScanStore(spark, shared_path(spark, "store"))
    store.replace("projects", projects)
    store.replace("scans", scans)
    store.write_facts({"metrics": facts}, ())
    store.purge(first.agg(F.min("name")).first()[0])
    counts = [t.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, t in (
        ("project", store.read("projects")), ("scan", store.read("scans")), ("fact", store.read_facts("metrics")))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("A12_read_scan", over("metrics_li", f"""
    SELECT {FLAT} FROM (SELECT *, CAST(NULL AS VARCHAR) AS old_file_path FROM metrics_li)
    WHERE scan_id = 1995"""))
def a12(spark, d):
    path = shared_path(spark, "metrics-li")
    write_scan_table(fx.metrics_li(spark, d), path)
    return sh.flat(read_scan_table(spark, path, 1995)).withColumn("scan_id", F.col("scan_id").cast("bigint"))


@query("A13_read_summary", """
    SELECT event_id AS scan_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n_load_errors,
      CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS load_error,
      CASE WHEN event_type = 'view' THEN NULL ELSE 'an' || user_id END AS analyzer_id,
      CASE WHEN event_type = 'view' THEN NULL ELSE event_id END AS files_analyzed,
      CASE WHEN event_type = 'view' THEN NULL ELSE props END AS detail
    FROM events""")
def a13(spark, d):
    stat = F.struct(
        F.expr("concat('an', cast(user_id AS string))").alias("analyzer_id"),
        F.col("event_id").alias("files_analyzed"), F.lit(0).alias("execution_errors"),
        F.array("props").alias("error_details"))
    bad = F.lit("{not json")
    records = fx.table(spark, d, "events").select(
        F.col("event_id").alias("scan_id"),
        F.when(F.col("event_type") == "error", bad).otherwise(F.to_json(F.array("event_type"))).alias("load_errors"),
        F.when(F.col("event_type") == "view", bad).otherwise(F.to_json(F.array(stat))).alias("analyzer_stats"))
    read = metrics.read_summary(records)
    first = F.get("analyzer_stats", F.lit(0))
    return read.select(
        "scan_id", F.size("load_errors").alias("n_load_errors"), F.get("load_errors", F.lit(0)).alias("load_error"),
        first["analyzer_id"].alias("analyzer_id"), first["files_analyzed"].alias("files_analyzed"),
        F.get(first["error_details"], F.lit(0)).alias("detail"))
