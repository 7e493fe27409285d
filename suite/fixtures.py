"""The shapes the operators work on, derived from the whole driver tables.

Every builder here has a twin of the same name in `suite.oracle_tables`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.plans.presets import (
    API_KEY_FINDER,
    GOSU_COMPLEXITY,
    JAVA_COMPLEXITY,
    LOG_LEVELS,
    TODO_FINDER,
)
from treegauge.specs import ScanRules, StackRule, regex_analyzer

WORDS = regex_analyzer("word_finder", r"\b(?:the|der|que)\b", metric_key="words", category="text")
SPANS = regex_analyzer("span_finder", r"[a-z]+\.\s[A-Z][a-z]+", metric_key="spans", category="text")
REVIEW = regex_analyzer("review_finder", r"TODO: [a-z]+", metric_key="review", category="text")
MARKUP = regex_analyzer("markup_finder", r"</?[a-z0-9]+", metric_key="markup", category="text")
DIFF_ONLY = regex_analyzer(
    "diff_only_finder", r"[A-Z][a-z]+ly\b", metric_key="ly", category="text",
    scan_mode="diff", change_type="M",
)
ANALYZERS = (*LOG_LEVELS, TODO_FINDER, API_KEY_FINDER, JAVA_COMPLEXITY, GOSU_COMPLEXITY,
             WORDS, SPANS, REVIEW, MARKUP, DIFF_ONLY)

_TEXT = ("char_count", "word_finder", "span_finder", "review_finder", "todo_finder",
         "api_key_finder", "diff_only_finder", "no_such_analyzer")
RULES = ScanRules(
    stacks=(
        StackRule("Core", ("rs",), (*_TEXT, "gosu_complexity"), paths=("src0/**", "src1/**")),
        StackRule("Rust", ("rs",), (*_TEXT, "gosu_complexity"), excludes=("src2/**",)),
        StackRule("Java", ("java",), (*_TEXT, "java_complexity")),
        StackRule("Python", ("py",), _TEXT),
        StackRule("Web", ("html",), ("char_count", "markup_finder", "java_complexity",
                                     "todo_finder", "api_key_finder",
                                     *(a.analyzer_id for a in LOG_LEVELS))),
    ),
    global_excludes=("*", "**/src3/**", "**/SRC0/**"),
)
BUCKETS = (1000, 3000, 5000, 10000, 50000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(*prefix) -> F.Column:
    ext = F.expr("CASE lang WHEN 'en' THEN 'rs' WHEN 'de' THEN 'java' WHEN 'fr' THEN 'py' ELSE 'md' END")
    return F.concat(*prefix, "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"),
                    F.lit("."), ext)


def files_base(spark, sf_dir) -> DataFrame:
    """First version: one file per document; the Spanish files of src13 are undecodable."""
    return table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("project"),
        F.lit("v1").alias("version"),
        _path().alias("file_path"),
        F.expr("CASE WHEN source = 'src13' AND lang = 'es' THEN NULL ELSE text END").alias("content"),
    )


def files_target(spark, sf_dir) -> DataFrame:
    """Second version: src2 and src12 moved, src7 moved and extended, src18 moved and rewritten,
    src5, src9, src14 and src17 extended in place, the rest as before."""
    prefix = F.expr("CASE WHEN source IN ('src2', 'src12', 'src7') THEN 'moved/' "
                    "WHEN source = 'src18' THEN 'fresh/' ELSE '' END")
    content = F.expr("""CASE
        WHEN source = 'src13' AND lang = 'es' THEN NULL
        WHEN source IN ('src7', 'src5', 'src9', 'src14', 'src17') THEN concat(text, chr(10), 'TODO: review')
        WHEN source = 'src18' THEN translate(text, 'aeiou', 'uoiea')
        ELSE text END""")
    return table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("project"), F.lit("v2").alias("version"),
        _path(prefix).alias("file_path"), content.alias("content"),
    )


def files_raw(spark, sf_dir) -> DataFrame:
    """Files as bytes: Spanish ones in Latin-1, those of src6 with a NUL byte in front."""
    raw = F.expr("""CASE
        WHEN lang = 'es' THEN encode(text, 'ISO-8859-1')
        WHEN source = 'src6' THEN concat(x'00', encode(text, 'UTF-8'))
        ELSE encode(text, 'UTF-8') END""")
    return table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("project"), F.lit("v1").alias("version"),
        _path().alias("file_path"), raw.alias("raw"),
    )


def files_web(spark, sf_dir) -> DataFrame:
    """One HTML file per page."""
    return table(spark, sf_dir, "pages").select(
        F.lit("site").alias("project"), F.lit("v1").alias("version"),
        F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"),
        F.col("html").alias("content"),
    )


def files_log(spark, sf_dir) -> DataFrame:
    """One small script per event, with a log call of a level by event type, a note and a key."""
    content = F.expr("""concat('let x = ', cast(event_id AS string), ';', chr(10),
        CASE event_type WHEN 'click' THEN 'console.info' WHEN 'view' THEN 'appLogger.warning'
             WHEN 'error' THEN 'logger.fatal' WHEN 'purchase' THEN 'my_log.debug' ELSE 'console.trace' END,
        '(', props, ') && print(x);', chr(10), '// FIXME: ', event_type, chr(10),
        'key = "sk-', md5(props), '"')""")
    return table(spark, sf_dir, "events").select(
        F.lit("logs").alias("project"), F.lit("v1").alias("version"),
        F.expr("concat('log/', event_type, '/', cast(event_id AS string), '.html')").alias("file_path"),
        content.alias("content"),
    )


def metrics_li(spark, sf_dir) -> DataFrame:
    """A metric table of one row per line item; a scan per ship year."""
    tags = F.create_map(
        F.lit("metric"), F.expr("concat('m_', cast(l_linenumber AS string))"),
        F.lit("category"), F.expr("CASE WHEN l_linenumber IN (2, 4, 6) THEN 'size' ELSE 'logging' END"),
        F.lit("team"), F.expr("concat('t', cast(l_suppkey AS string))"),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.expr("CAST(year(l_shipdate) AS BIGINT)").alias("scan_id"),
        F.expr("""concat('s', CAST(l_suppkey AS STRING), '/p', CAST(l_partkey AS STRING), '/',
            CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING),
            CASE WHEN l_linestatus = 'F' THEN '.rs' WHEN l_linenumber = 1 THEN '' ELSE '.py' END)"""
               ).alias("file_path"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END").alias("change_type"),
        F.lit(None).cast("string").alias("old_file_path"),
        F.expr("CASE WHEN l_linestatus = 'F' THEN 'Rust' WHEN l_linenumber = 1 THEN NULL ELSE 'Python' END"
               ).alias("tech_stack"),
        F.expr("CASE WHEN l_linenumber <= 2 THEN 'an_0' WHEN l_linenumber <= 4 THEN 'an_1' ELSE 'an_2' END"
               ).alias("analyzer_id"),
        tags.alias("tags"),
        F.expr("CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END").alias("value_before"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_discount = 0 THEN 0.0D ELSE l_extendedprice END"
               ).alias("value_after"),
        F.lit(None).cast("string").alias("scope"),
    )


def projects(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"),
        F.expr("concat('/repos/', c_name)").alias("repo_path"),
        F.expr("timestamp_ntz '2020-01-01 00:00:00'").alias("created_at"),
    )


def scans(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("project_id"),
        F.expr("concat('c', CAST(o_orderkey AS STRING))").alias("commit_hash"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 'SNAPSHOT' ELSE 'DIFF' END").alias("scan_mode"),
        F.col("o_orderdate").alias("scan_time"),
    )


def commits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr("concat('e', CAST(event_id AS STRING), 'abcdef0')").alias("hash"),
        F.expr("concat(event_type, ' Fix #', CAST(event_id AS STRING), chr(13), chr(10), props)").alias("message"),
        F.expr("CASE WHEN event_type = 'error' THEN NULL ELSE concat('user', CAST(user_id AS STRING)) END"
               ).alias("author"),
        "ts",
    )


def cfg_projects(spark, sf_dir) -> DataFrame:
    """Configured projects: the nations that have a supplier in debt."""
    debtors = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(
        F.col("s_nationkey").alias("n_nationkey")).distinct()
    return table(spark, sf_dir, "nation").join(debtors, "n_nationkey", "left_semi").select(
        F.col("n_name").alias("name"), F.expr("concat('/cfg/', n_name)").alias("repo_path"))


def db_projects(spark, sf_dir) -> DataFrame:
    """Scan counts per nation of the customers."""
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("_n"), F.max("o_orderdate").alias("_t"), F.max("o_orderstatus").alias("_m"))
    return customers.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(
        F.col("n_name").alias("name")).agg(
        F.nullif(F.array_join(F.sort_array(F.collect_set("_m")), ","), F.lit("")).alias("scan_modes"),
        F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("total_scans"),
        F.max("_t").alias("last_scan_time"))


def cached_repos(spark, sf_dir) -> DataFrame:
    """One cached repository per nation with suppliers in credit."""
    return table(spark, sf_dir, "supplier").where("s_acctbal >= 0").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("name")).agg(F.min("s_name").alias("repo_id"), F.max("s_name").alias("branch"))
