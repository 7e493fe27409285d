"""DuckDB twins of the fixtures and of the derived tables, written independently in SQL."""

from __future__ import annotations

# A path's extension.
EXT = r"regexp_extract(split_part(file_path, '/', -1), '^.+\.([^.]*)$', 1)"
# Non-ASCII characters (letters in this corpus) as a word character that is in no letter class,
# since RE2 knows ASCII word boundaries only. Positions in characters stay the same.
FOLD = r"regexp_replace({0}, '[^\x00-\x7F]', '_', 'g')"
_DOC_PATH = ("source || '/' || lang || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'rs' "
             "WHEN 'de' THEN 'java' WHEN 'fr' THEN 'py' ELSE 'md' END")

TABLES: dict[str, str] = {}
TABLES["files_base"] = f"""
  SELECT 'corpus' AS project, 'v1' AS version, {_DOC_PATH} AS file_path,
         CASE WHEN source = 'src13' AND lang = 'es' THEN NULL ELSE text END AS content
  FROM documents"""
TABLES["files_target"] = f"""
  SELECT 'corpus' AS project, 'v2' AS version,
         CASE WHEN source IN ('src2', 'src12', 'src7') THEN 'moved/'
              WHEN source = 'src18' THEN 'fresh/' ELSE '' END || {_DOC_PATH} AS file_path,
         CASE WHEN source = 'src13' AND lang = 'es' THEN NULL
              WHEN source IN ('src7', 'src5', 'src9', 'src14', 'src17')
                THEN text || chr(10) || 'TODO: review'
              WHEN source = 'src18' THEN translate(text, 'aeiou', 'uoiea')
              ELSE text END AS content
  FROM documents"""
TABLES["files_web"] = """
  SELECT 'site' AS project, 'v1' AS version, 'web/' || page_id || '.html' AS file_path,
         html AS content FROM pages"""
TABLES["files_log"] = """
  SELECT 'logs' AS project, 'v1' AS version, 'log/' || event_type || '/' || event_id || '.html' AS file_path,
    'let x = ' || event_id || ';' || chr(10) ||
    CASE event_type WHEN 'click' THEN 'console.info' WHEN 'view' THEN 'appLogger.warning'
         WHEN 'error' THEN 'logger.fatal' WHEN 'purchase' THEN 'my_log.debug' ELSE 'console.trace' END ||
    '(' || props || ') && print(x);' || chr(10) || '// FIXME: ' || event_type || chr(10) ||
    'key = "sk-' || md5(props) || '"' AS content FROM events"""
TABLES["metrics_li"] = """
  SELECT CAST(year(l_shipdate) AS BIGINT) AS scan_id,
    's' || l_suppkey || '/p' || l_partkey || '/' || l_orderkey || '_' || l_linenumber ||
      CASE WHEN l_linestatus = 'F' THEN '.rs' WHEN l_linenumber = 1 THEN '' ELSE '.py' END AS file_path,
    CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END AS change_type,
    CASE WHEN l_linestatus = 'F' THEN 'Rust' WHEN l_linenumber = 1 THEN NULL ELSE 'Python' END AS tech_stack,
    CASE WHEN l_linenumber <= 2 THEN 'an_0' WHEN l_linenumber <= 4 THEN 'an_1' ELSE 'an_2' END AS analyzer_id,
    'm_' || l_linenumber AS metric_key,
    CASE WHEN l_linenumber IN (2, 4, 6) THEN 'size' ELSE 'logging' END AS category,
    't' || l_suppkey AS team,
    CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS value_before,
    CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END AS value_after
  FROM lineitem"""
TABLES["projects"] = """
  SELECT c_custkey AS project_id, c_name AS name, '/repos/' || c_name AS repo_path,
         TIMESTAMP '2020-01-01 00:00:00' AS created_at FROM customer"""
TABLES["scans"] = """
  SELECT o_orderkey AS scan_id, o_custkey AS project_id, 'c' || o_orderkey AS commit_hash,
         CASE WHEN o_orderstatus = 'F' THEN 'SNAPSHOT' ELSE 'DIFF' END AS scan_mode,
         o_orderdate AS scan_time FROM orders"""
TABLES["commits"] = """
  SELECT 'e' || event_id || 'abcdef0' AS hash,
         event_type || ' Fix #' || event_id || chr(13) || chr(10) || props AS message,
         CASE WHEN event_type = 'error' THEN NULL ELSE 'user' || user_id END AS author, ts FROM events"""
TABLES["commit_log"] = """
  SELECT hash, left(hash, 7) AS short_hash, rtrim(split_part(message, chr(10), 1), chr(13)) AS message,
         coalesce(author, 'Unknown') AS author,
         CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, message AS full_message FROM commits"""
TABLES["cfg_projects"] = """
  SELECT n_name AS name, '/cfg/' || n_name AS repo_path FROM nation
  WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)"""
TABLES["db_projects"] = """
  SELECT n.n_name AS name, count(o.o_orderkey) AS total_scans, max(o.o_orderdate) AS last_scan_time,
    string_agg(DISTINCT x.m, ',' ORDER BY x.m) AS scan_modes
  FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey
  LEFT JOIN orders o ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS m FROM orders GROUP BY ALL) x ON x.o_custkey = c.c_custkey
  GROUP BY n.n_name"""
TABLES["cached_repos"] = """
  SELECT n_name AS name, min(s_name) AS repo_id, max(s_name) AS branch FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE s_acctbal >= 0 GROUP BY n_name"""


def classified(files: str) -> str:
    """Kept files of a table with their stack."""
    return f"""
  SELECT *, CASE
      WHEN ext = 'rs' AND (file_path LIKE 'src0/%' OR file_path LIKE 'src1/%') THEN 'Core'
      WHEN ext = 'rs' AND file_path NOT LIKE 'src2/%' THEN 'Rust'
      WHEN ext = 'java' THEN 'Java' WHEN ext = 'py' THEN 'Python' WHEN ext = 'html' THEN 'Web'
    END AS tech_stack
  FROM (SELECT *, {EXT} AS ext FROM {files})
  WHERE NOT ((file_path NOT LIKE '%/%' OR regexp_matches(file_path, '(^|/)src[03]/'))
             AND NOT (ext = 'rs' AND (file_path LIKE 'src0/%' OR file_path LIKE 'src1/%')))"""


TABLES["kept_base"] = classified("files_base")
TABLES["kept_web"] = classified("files_web")
TABLES["kept_log"] = classified("files_log")
_SNAPSHOT = """
  SELECT CAST({0} AS BIGINT) AS scan_id, 'SNAPSHOT' AS scan_mode, file_path, 'A' AS change_type,
         CAST(NULL AS VARCHAR) AS old_file_path, tech_stack, content,
         CAST(NULL AS VARCHAR) AS old_content FROM {1}"""
TABLES["snapshot"] = _SNAPSHOT.format(1, "kept_base")
TABLES["snapshot_web"] = _SNAPSHOT.format(2, "kept_web")
TABLES["snapshot_log"] = _SNAPSHOT.format(3, "kept_log")
TABLES["delta"] = """
  SELECT coalesce(t.file_path, b.file_path) AS file_path,
    CASE WHEN b.file_path IS NULL THEN 'A' WHEN t.file_path IS NULL THEN 'D' ELSE 'M' END AS change_type,
    b.content AS old_content, t.content AS content
  FROM files_base b FULL OUTER JOIN files_target t ON b.file_path = t.file_path
  WHERE b.file_path IS NULL OR t.file_path IS NULL
     OR b.content IS DISTINCT FROM t.content"""
TABLES["rename_pairs"] = """
  SELECT d.file_path AS old_path, a.file_path AS new_path, d.old_content, a.content FROM
    (SELECT *, row_number() OVER (PARTITION BY old_content ORDER BY left(md5(file_path), 2), file_path) AS rn
     FROM delta WHERE change_type = 'D' AND old_content IS NOT NULL) d
  JOIN
    (SELECT *, row_number() OVER (PARTITION BY content ORDER BY left(md5(file_path), 2), file_path) AS rn
     FROM delta WHERE change_type = 'A' AND content IS NOT NULL) a
  ON d.old_content = a.content AND d.rn = a.rn"""
TABLES["delta_renamed"] = """
  SELECT file_path, change_type, CASE WHEN change_type = 'D' THEN file_path END AS old_file_path,
         old_content, content FROM delta
  WHERE NOT (change_type = 'D' AND file_path IN (SELECT old_path FROM rename_pairs))
    AND NOT (change_type = 'A' AND file_path IN (SELECT new_path FROM rename_pairs))
  UNION ALL SELECT new_path, 'M', old_path, old_content, content FROM rename_pairs"""
TABLES["delta_plain"] = """
  SELECT file_path, change_type, CASE WHEN change_type = 'D' THEN file_path END AS old_file_path,
         old_content, content FROM delta"""
_DIFF = """
  SELECT CAST({0} AS BIGINT) AS scan_id, 'DIFF' AS scan_mode, file_path, change_type, old_file_path,
         tech_stack, content, old_content FROM ({1})"""
TABLES["diff_plain"] = _DIFF.format(7, classified("delta_plain"))
TABLES["diff_exact"] = _DIFF.format(7, classified("delta_renamed"))

# Patterns as the oracle writes them (RE2, on folded text).
LOG_SQL = {
    "log_info": r"\b(?:(?:info|print(?:ln)?)!|print(?:ln)?\b|console\.(?:log|info)\b|(?:\w*[Ll]og(?:ger|ging)?)\.info\b)",
    "log_warn": r"\b(?:warn!|console\.warn\b|(?:\w*[Ll]og(?:ger|ging)?)\.(?:warn|warning)\b)",
    "log_error": r"\b(?:(?:error|eprint(?:ln)?)!|eprint(?:ln)?\b|console\.error\b|(?:\w*[Ll]og(?:ger|ging)?)\.(?:error|fatal|exception)\b)",
    "log_trace": r"\b(?:trace!|console\.trace\b|(?:\w*[Ll]og(?:ger|ging)?)\.trace\b)",
    "log_debug": r"\b(?:debug!|console\.debug\b|(?:\w*[Ll]og(?:ger|ging)?)\.debug\b)",
}
JAVA_SQL = [r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", "&&", r"\|\|", r"\?"]
GOSU_SQL = [r"\bif\b", r"\belse\b", r"\bfor\b", r"\bforeach\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b",
            r"\band\b", r"\bor\b", "&&", r"\|\|", r"\?"]
_CODE = "('Core', 'Rust', 'Java', 'Python')"
_TEXT = "('Core', 'Rust', 'Java', 'Python', 'Web')"
# analyzer: (files it runs on, metric key, category, patterns, base, unit)
FINDERS = {
    **{f"{key}_finder": ("tech_stack = 'Web'", key, "logging", [p], 0, "byte") for key, p in LOG_SQL.items()},
    "todo_finder": (f"tech_stack IN {_TEXT}", "matches", None, [r"(?:TODO|FIXME):[^\n]*"], 0, "byte"),
    "api_key_finder": (f"tech_stack IN {_TEXT}", "matches", None, ["sk-[a-zA-Z0-9]{32,}"], 0, "byte"),
    "word_finder": (f"tech_stack IN {_CODE}", "words", "text", [r"\b(?:the|der|que)\b"], 0, "byte"),
    "span_finder": (f"tech_stack IN {_CODE}", "spans", "text", [r"[a-z]+\.\s[A-Z][a-z]+"], 0, "byte"),
    "review_finder": (f"tech_stack IN {_CODE}", "review", "text", ["TODO: [a-z]+"], 0, "byte"),
    "markup_finder": ("tech_stack = 'Web'", "markup", "text", ["</?[a-z0-9]+"], 0, "byte"),
    "diff_only_finder": (f"tech_stack IN {_CODE} AND scan_mode = 'DIFF' AND change_type = 'M'", "ly", "text",
                         [r"[A-Z][a-z]+ly\b"], 0, "byte"),
    "java_complexity": ("tech_stack IN ('Java', 'Web')", "complexity", "maintainability", JAVA_SQL, 1, "char"),
    "gosu_complexity": ("tech_stack IN ('Core', 'Rust')", "complexity", "complexity", GOSU_SQL, 1, "char"),
}


def count_sql(patterns: list[str], base: int, content: str) -> str:
    """Sum of hit counts on folded content."""
    hits = [f"len(regexp_extract_all({content}, '{p}'))" for p in patterns]
    return f"CAST({base} + {' + '.join(hits)} AS DOUBLE)"


def metrics_of(changes: str) -> str:
    """Metric rows of a change table before zero suppression."""
    folded = (f"(SELECT *, {FOLD.format('content')} AS fa, {FOLD.format('old_content')} AS fb "
              f"FROM {changes})")
    columns = "scan_id, file_path, change_type, old_file_path, tech_stack"

    def branch(analyzer, metric, category, after, before, where):
        category = "NULL" if category is None else f"'{category}'"
        return f"""SELECT {columns}, '{analyzer}' AS analyzer_id, '{metric}' AS metric_key,
            CAST({category} AS VARCHAR) AS category,
            CASE WHEN old_content IS NOT NULL THEN {before} END AS value_before,
            CASE WHEN content IS NOT NULL THEN {after} END AS value_after
            FROM {folded} WHERE {where} AND (content IS NOT NULL OR old_content IS NOT NULL)"""

    one = "CAST(1 AS DOUBLE)"
    parts = [
        branch("file_count", "file_count", "size", one, one, "TRUE"),
        branch("char_count", "char_count", "size", "CAST(length(content) AS DOUBLE)",
               "CAST(length(old_content) AS DOUBLE)", "tech_stack IS NOT NULL"),
    ]
    for name, (where, metric, category, patterns, base, _) in FINDERS.items():
        parts.append(branch(name, metric, category, count_sql(patterns, base, "fa"),
                            count_sql(patterns, base, "fb"), where))
    return "\n UNION ALL ".join(parts)


def nonzero(metrics: str) -> str:
    return f"SELECT * FROM ({metrics}) WHERE coalesce(value_before, 0) <> 0 OR coalesce(value_after, 0) <> 0"


TABLES["metrics_snapshot"] = nonzero(metrics_of("snapshot"))
TABLES["metrics_web"] = nonzero(metrics_of("snapshot_web"))
TABLES["metrics_log"] = nonzero(metrics_of("snapshot_log"))
TABLES["metrics_diff"] = nonzero(metrics_of("diff_exact"))


def matches_of(changes: str, names: list[str] | None = None) -> str:
    """Match rows of a change table, positions from running sums over hits and gaps."""
    texts = f"""
      SELECT scan_id, 'after' AS side, file_path, scan_mode, change_type, tech_stack, content AS body
      FROM {changes} WHERE content IS NOT NULL
      UNION ALL
      SELECT scan_id, 'before', coalesce(old_file_path, file_path), scan_mode, change_type, tech_stack, old_content
      FROM {changes} WHERE old_content IS NOT NULL"""
    parts = []
    for name, (where, _, _, patterns, _, unit) in FINDERS.items():
        if names is not None and name not in names:
            continue
        width = "strlen" if unit == "byte" else "length"
        for p in patterns:
            parts.append(f"""
    SELECT scan_id, file_path, '{name}' AS analyzer_id,
      CAST(len(before_lines) AS BIGINT) AS line_number,
      CAST({width}(before_lines[-1]) + 1 AS BIGINT) AS column_start,
      CAST({width}(before_lines[-1]) + 1 + {width}(hit) AS BIGINT) AS column_end,
      hit AS matched_text,
      CASE WHEN len(before_lines) > 1 THEN trim(all_lines[len(before_lines) - 1]) END AS context_before,
      CASE WHEN len(before_lines) < len(all_lines) - CAST(all_lines[-1] = '' AS INT)
           THEN trim(all_lines[len(before_lines) + 1]) END AS context_after,
      side
    FROM (
      SELECT *, string_split(left(body, pos), chr(10)) AS before_lines, string_split(body, chr(10)) AS all_lines,
             substr(body, pos + 1, CAST(size AS BIGINT)) AS hit
      FROM (
        SELECT *, length(hits[k]) AS size,
          CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g)))
            + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS BIGINT) AS pos
        FROM (
          SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (
            SELECT *, regexp_extract_all({FOLD.format('body')}, '{p}') AS hits,
                   string_split_regex({FOLD.format('body')}, '{p}') AS gaps
            FROM ({texts}) WHERE {where}))))""")
    return "\n UNION ALL ".join(parts)


for _table in ("snapshot", "snapshot_web", "snapshot_log", "diff_exact"):
    for _unit in ("byte", "char"):
        TABLES[f"matches_{_unit}_{_table}"] = matches_of(
            _table, [n for n, f in FINDERS.items() if f[5] == _unit])

_NEEDS = {
    "kept_base": ["files_base"], "kept_web": ["files_web"],
    "snapshot": ["kept_base"], "snapshot_web": ["kept_web"],
    "delta": ["files_base", "files_target"], "rename_pairs": ["delta"],
    "delta_renamed": ["rename_pairs"], "delta_plain": ["delta"],
    "diff_plain": ["delta_plain"], "diff_exact": ["delta_renamed"],
    "kept_log": ["files_log"], "snapshot_log": ["kept_log"],
    "metrics_snapshot": ["snapshot"], "metrics_web": ["snapshot_web"], "metrics_log": ["snapshot_log"],
    "metrics_diff": ["diff_exact"],
    **{f"matches_{u}_{t}": [t] for u in ("byte", "char")
       for t in ("snapshot", "snapshot_web", "snapshot_log", "diff_exact")},
    "commit_log": ["commits"],
}


def over(tables: str, select: str) -> str:
    """The select with the named tables (and what they need) as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in tables.split():
        add(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in order)
    return f"WITH {ctes}\n{select}"
