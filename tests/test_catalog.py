from datetime import datetime

from treegauge.operators import catalog

PROJECTS = "project_id bigint, name string, repo_path string, created_at timestamp"
SCANS = "scan_id bigint, project_id bigint, commit_hash string, scan_mode string, scan_time timestamp"
T = [datetime(2024, 1, d) for d in range(1, 10)]


def tables(spark):
    projects = spark.createDataFrame([(1, "one", "/1", T[0]), (2, "two", "/2", T[0]), (3, "idle", None, T[0])], PROJECTS)
    scans = spark.createDataFrame([
        (10, 1, "a", "SNAPSHOT", T[1]), (11, 1, "b", "SNAPSHOT", T[3]), (12, 1, "c", "DIFF", T[2]),
        (20, 2, "d", "SNAPSHOT", T[4])], SCANS)
    return projects, scans


def test_stats_listing_and_latest(spark):
    projects, scans = tables(spark)
    stats = {r.name: (r.total_scans, r.last_scan_time, r.scan_modes) for r in catalog.project_stats(projects, scans).collect()}
    assert stats == {"one": (3, T[3], "DIFF,SNAPSHOT"), "two": (1, T[4], "SNAPSHOT"), "idle": (0, None, None)}
    order = [r.name for r in catalog.by_last_scan(catalog.project_stats(projects, scans)).collect()]
    assert order == ["two", "one", "idle"]
    assert [r.scan_id for r in catalog.list_scans(projects, scans, "one").collect()] == [11, 10]
    assert [r.scan_id for r in catalog.list_scans(projects, scans, "one", "DIFF").collect()] == [12]
    assert catalog.list_scans(projects, scans, "nobody").count() == 0
    assert {(r.project_id, r.scan_mode): r.scan_id for r in catalog.latest_scan(scans).collect()} == {
        (1, "SNAPSHOT"): 11, (1, "DIFF"): 12, (2, "SNAPSHOT"): 20}


def test_purge_leaves_nothing_of_the_project(spark):
    projects, scans = tables(spark)
    facts = spark.createDataFrame([(10, "x"), (12, "y"), (20, "z")], "scan_id bigint, file_path string")
    left = catalog.purge_project({"projects": projects, "scans": scans, "metrics": facts, "matches": facts}, "one")
    assert [r.name for r in left["projects"].orderBy("name").collect()] == ["idle", "two"]
    assert [r.scan_id for r in left["scans"].collect()] == [20]
    assert [r.file_path for r in left["metrics"].collect()] == [r.file_path for r in left["matches"].collect()] == ["z"]


def test_upsert_keeps_id_and_takes_path(spark):
    projects, _ = tables(spark)
    incoming = spark.createDataFrame([(99, "one", "/moved", T[5]), (4, "new", "/4", T[5])], PROJECTS)
    rows = {r.name: (r.project_id, r.repo_path, r.created_at) for r in catalog.upsert_projects(projects, incoming).collect()}
    assert rows == {"one": (1, "/moved", T[0]), "two": (2, "/2", T[0]), "idle": (3, None, T[0]), "new": (4, "/4", T[5])}


def test_unified_and_merged_names(spark):
    config = spark.createDataFrame([("b", "/b"), ("a", "/a")], "name string, repo_path string")
    stats = spark.createDataFrame([("a", 2, T[0], "DIFF"), ("c", 1, T[1], "DIFF,SNAPSHOT")], "name string, total_scans bigint, last_scan_time timestamp, scan_modes string")
    cached = spark.createDataFrame([("c", "r1", "main"), ("d", "r2", None)], "name string, repo_id string, branch string")
    rows = {r.name: (r.has_config, r.has_cached_repo, r.total_scans, r.scan_modes, r.cached_repo_branch) for r in
            catalog.unified_projects(config, stats, cached).collect()}
    assert rows == {"a": (True, False, 2, "DIFF", None), "b": (True, False, 0, None, None),
                    "c": (False, True, 1, "DIFF,SNAPSHOT", "main"), "d": (False, True, 0, None, None)}
    names = [(r.section, r.name) for r in catalog.merge_names(config, stats).collect()]
    assert sorted(names) == [(0, "a"), (0, "b"), (1, "c")]


def test_commit_pages_cover_all_once(spark):
    rows = [(f"h{i:03d}xxxxxx", f"Fix {i}\nbody", None if i % 3 else "me", T[i % 7]) for i in range(130)]
    log = catalog.commit_log(spark.createDataFrame(rows, "hash string, message string, author string, ts timestamp"))
    found = catalog.search_commits(log, "BODY")
    pages = [catalog.page_commits(found, offset=o).collect() for o in (0, 50, 100)]
    assert [len(p) for p in pages] == [50, 50, 30]
    assert [p[0].has_more for p in pages] == [True, True, False]
    seen = [r for p in pages for r in p]
    assert len({r.hash for r in seen}) == 130
    assert seen == sorted(seen, key=lambda r: (-r.timestamp, r.hash))
    assert seen[0].short_hash == seen[0].hash[:7] and "\n" not in seen[0].message
    assert {r.author for r in seen} == {"me", "Unknown"}
    assert len(catalog.page_commits(log, limit=1000).collect()) == 130
    assert catalog.search_commits(log, "absent").count() == 0
    many = log.crossJoin(spark.range(4)).drop("id")
    large = catalog.page_commits(many, limit=400).collect()
    assert len(large) == 400 and large[0].has_more
