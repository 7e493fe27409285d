"""Projects, scans and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from treegauge.functions.text import first_line
from treegauge.operators.paging import page_of
from treegauge.specs import SNAPSHOT

DEFAULT_COMMITS = 50


def upsert_projects(projects: DataFrame, incoming: DataFrame) -> DataFrame:
    """Projects by unique name: known names keep id and creation time and take the new repo_path.

    `incoming` has the columns of `projects`. One partial aggregate, no window.
    """
    both = projects.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    merged = both.groupBy("name").agg(
        F.min_by(F.struct("project_id", "created_at"), "_new").alias("_kept"),
        F.max_by(F.struct("repo_path"), "_new").alias("_taken"),
    )
    return merged.select("_kept.project_id", "name", "_taken.repo_path", "_kept.created_at")


def append_scans(scans: DataFrame, incoming: DataFrame) -> DataFrame:
    """The scan table with new scans at its end."""
    return scans.unionByName(incoming, allowMissingColumns=True)


def project_stats(projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Every project with its number of scans, the last scan time and the distinct modes.

    Scans are aggregated per project before the join, so a project with very many scans arrives
    as one row.
    """
    per_project = scans.groupBy("project_id").agg(
        F.count("*").alias("total_scans"),
        F.max("scan_time").alias("last_scan_time"),
        F.array_join(F.sort_array(F.collect_set("scan_mode")), ",").alias("scan_modes"),
    )
    return (
        projects.join(per_project, "project_id", "left")
        .withColumn("total_scans", F.coalesce("total_scans", F.lit(0).cast("bigint")))
        .select("project_id", "name", "total_scans", "last_scan_time", "scan_modes")
    )


def by_last_scan(stats: DataFrame) -> DataFrame:
    """Projects, most recently scanned first."""
    return stats.orderBy(F.col("last_scan_time").desc_nulls_last(), "name")


def unified_projects(config: DataFrame, stats: DataFrame, cached: DataFrame) -> DataFrame:
    """Projects known from configuration, scans or repository cache, merged by name."""
    known = F.lit(True)
    merged = (
        config.select("name", F.col("repo_path").alias("config_repo_path"), known.alias("_config"))
        .join(stats.select("name", "total_scans", "last_scan_time", "scan_modes"), "name", "full_outer")
        .join(cached.select("name", F.col("repo_id").alias("cached_repo_id"), F.col("branch").alias("cached_repo_branch"), known.alias("_cached")),
              "name", "full_outer")
    )
    return merged.select(
        "name",
        F.col("_config").isNotNull().alias("has_config"),
        "config_repo_path",
        F.col("_cached").isNotNull().alias("has_cached_repo"),
        "cached_repo_id",
        "cached_repo_branch",
        F.coalesce("total_scans", F.lit(0).cast("bigint")).alias("total_scans"),
        "last_scan_time",
        "scan_modes",
    )


def scans_of(projects: DataFrame, scans: DataFrame, name: str | None = None) -> DataFrame:
    """Scans with their project's name; of one project when a name is given."""
    if name is not None:
        projects = projects.where(F.col("name") == name)
    return scans.join(projects.select("project_id", F.col("name").alias("project")), "project_id")


def list_scans(projects: DataFrame, scans: DataFrame, name: str | None = None, mode: str = SNAPSHOT) -> DataFrame:
    """Scans of one mode, newest first."""
    found = scans_of(projects, scans.where(F.col("scan_mode") == mode), name)
    return found.select("project", "scan_id", "commit_hash", "scan_time").orderBy(
        F.col("scan_time").desc(), F.col("scan_id").desc()
    )


def latest_scan(scans: DataFrame) -> DataFrame:
    """The newest scan of every project and mode: a partial aggregate, no sort."""
    newest = F.max(F.struct("scan_time", "scan_id", "commit_hash"))
    return scans.groupBy("project_id", "scan_mode").agg(newest.alias("_s")).select(
        "project_id", "scan_mode", "_s.scan_id", "_s.commit_hash", "_s.scan_time"
    )


def purge_project(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """All tables without one project: its scans, and whatever hangs on their scan_id."""
    projects, scans = tables["projects"], tables["scans"]
    doomed = projects.where(F.col("name") == name).select("project_id")
    doomed_scans = scans.join(doomed, "project_id", "left_semi").select("scan_id")
    left = {}
    for table, rows in tables.items():
        if table == "projects":
            left[table] = rows.where(F.col("name") != name)
        elif "project_id" in rows.columns:
            left[table] = rows.join(doomed, "project_id", "left_anti")
        else:
            left[table] = rows.join(doomed_scans, "scan_id", "left_anti")
    return left


def merge_names(config: DataFrame, stats: DataFrame) -> DataFrame:
    """Project names without duplicates: configured ones (section 0), then those only scanned (1)."""
    configured = config.select(F.lit(0).alias("section"), "name")
    scanned = stats.join(config, "name", "left_anti").select(F.lit(1).alias("section"), "name")
    return configured.unionByName(scanned)


def _epoch_seconds(commits: DataFrame, name: str) -> Column:
    """Seconds since 1970; a timestamp without zone is read as UTC in any session zone."""
    if isinstance(commits.schema[name].dataType, TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("SECOND", epoch, F.col(name))
    return F.unix_timestamp(name)


def commit_log(commits: DataFrame) -> DataFrame:
    """Commits for display; `full_message` stays for searching."""
    return commits.select(
        "hash",
        F.substring("hash", 1, 7).alias("short_hash"),
        first_line(F.coalesce("message", F.lit(""))).alias("message"),
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        _epoch_seconds(commits, "ts").alias("timestamp"),
        F.coalesce("message", F.lit("")).alias("full_message"),
    )


def search_commits(log: DataFrame, text: str) -> DataFrame:
    """Commits whose full message holds the text, in any case."""
    return log.where(F.contains(F.lower("full_message"), F.lit(text.lower())))


def page_commits(log: DataFrame, offset: int = 0, limit: int = DEFAULT_COMMITS) -> DataFrame:
    """One page, newest first, with a flag on every row telling whether more follow.

    One row beyond the page is read, and the window counts these at most limit + 1 rows. A deep page sorts its own range only.
    """
    if limit < 1:
        raise ValueError(f"no page of {limit} rows")
    ahead = page_of(log.drop("full_message"), [("timestamp", True), ("hash", False)], offset, limit + 1)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return ahead.withColumn("has_more", n > limit).orderBy(F.col("timestamp").desc(), "hash").limit(limit)
