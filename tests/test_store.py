"""Stored tables: rescans, deletes, and what a failure leaves."""

import os

import pytest
from pyspark.sql import functions as F

from suite.all_queries import QUERIES
from treegauge.operators.metrics import all_error_details, quoted_errors, read_summary, summary_record
from treegauge.sources import store as stores
from treegauge.sources.store import FACTS, ScanStore


def filled(spark, tmp_path):
    store = ScanStore(spark, str(tmp_path / "store"))
    store.replace("projects", spark.createDataFrame([(1, "one"), (2, "two"), (3, "idle")], "project_id long, name string"))
    store.replace("scans", spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "scan_id long, project_id long"))
    rows = spark.createDataFrame([(s, f"f{k}") for s in (10, 11, 20) for k in range(4)], "scan_id long, file_path string")
    store.write_facts({table: rows for table in FACTS}, [10, 11, 20])
    return store


def scans_left(store):
    return {table: sorted({r.scan_id for r in store.read_facts(table).collect()}) for table in FACTS}


def test_a_rescan_without_rows_empties_the_scan(spark, tmp_path):
    store = filled(spark, tmp_path)
    fewer = spark.createDataFrame([(10, "new")], "scan_id long, file_path string")
    store.write_facts({"metrics": fewer, "matches": fewer.limit(0)}, [10, 11])
    assert [(r.scan_id, r.file_path) for r in store.read_facts("metrics").where("scan_id < 20").collect()] == [(10, "new")]
    assert scans_left(store) == {"metrics": [10, 20], "matches": [20], "errors": [10, 11, 20], "summaries": [10, 11, 20]}
    with pytest.raises(ValueError):
        store.write_facts({"projects": fewer}, [1])


def test_purge_removes_stored_partitions(spark, tmp_path):
    store = filled(spark, tmp_path)
    store.purge("one")
    assert scans_left(store) == {table: [20] for table in FACTS}
    assert [r.scan_id for r in store.read("scans").collect()] == [20]
    assert sorted(r.name for r in store.read("projects").collect()) == ["idle", "two"]
    for name in ("idle", "nobody"):
        store.purge(name)
    assert [r.name for r in store.read("projects").collect()] == ["two"] and scans_left(store)["metrics"] == [20]
    assert sorted(p for p in os.listdir(store.root) if "purge" in p or "new" in p) == []


@pytest.mark.parametrize("fails_at", range(1, 7))
def test_a_purge_that_failed_is_finished_by_the_next(spark, tmp_path, monkeypatch, fails_at):
    store, calls = filled(spark, tmp_path), []
    whole = stores.remove

    def failing(session, path):
        calls.append(path)
        if len(calls) == fails_at:
            raise OSError("lost")
        whole(session, path)

    def failing_drop(session, path, ids):
        for i in ids:
            failing(session, f"{path}/scan_id={i}")

    monkeypatch.setattr(stores, "remove", failing)
    monkeypatch.setattr(stores, "drop_scans", failing_drop)
    with pytest.raises(OSError):
        store.purge("one")
    store.purge("one")
    assert scans_left(store) == {table: [20] for table in FACTS}
    assert [r.scan_id for r in store.read("scans").collect()] == [20] and store.read("projects").count() == 2


def test_a_complete_replacement_is_put_in_place(spark, tmp_path):
    store = filled(spark, tmp_path)
    os.rename(store.path("scans"), store.path("scans") + "-new-x")
    assert store.read("scans").count() == 3


def test_summaries_quote_errors_and_stay_bounded(spark):
    stats = spark.createDataFrame([(1, "a", 5, 9, 0), (1, "b", 5, 0, 3), (1, "c", 5, 2, 2500)],
                                  "scan_id long, analyzer_id string, total_files long, files_analyzed long, execution_errors long")
    errors = spark.createDataFrame([(1, "b", f"f{k}: no") for k in (2, 0, 1)] + [(1, "c", f"{k:05d}: no") for k in range(2500)],
                                   "scan_id long, analyzer_id string, error string")
    row = read_summary(summary_record(stats, errors=errors)).first()
    details = {s.analyzer_id: s.error_details for s in row.analyzer_stats}
    assert details["a"] == [] and details["b"] == ["f0: no", "f1: no", "f2: no"]
    assert details["c"] == [f"{k:05d}: no" for k in range(1000)] and row.total_errors == 2503
    assert quoted_errors(errors, 2).agg(F.max(F.size("error_details"))).first()[0] == 2


def test_error_texts_beyond_the_quoted_come_from_the_error_table(spark, tmp_path):
    most = {"a": 0, "b": 3, "c": 1000, "d": 1001, "e": 2500}
    stats = spark.createDataFrame([(i, a, 9, 5, n) for i in (1, 2) for a, n in most.items()],
                                  "scan_id long, analyzer_id string, total_files long, files_analyzed long, execution_errors long")
    texts = [(i, a, f"{i} {k // 2:05d}: no") for i in (1, 2) for a, n in most.items() for k in reversed(range(n))]
    texts = [(*t[:2], None) if t[1:] == ("e", "1 00000: no") else t for t in texts]
    errors = spark.createDataFrame(texts, "scan_id long, analyzer_id string, error string")
    store = ScanStore(spark, str(tmp_path / "store"))
    store.write_facts({"errors": errors, "summaries": summary_record(stats, errors=errors)}, [1, 2])
    stored = read_summary(store.read_facts("summaries")).select("scan_id", F.inline("analyzer_stats"))
    assert stored.agg(F.max(F.size("error_details"))).first()[0] == 1000
    found = {(r.scan_id, r.analyzer_id): r.error_details for r in all_error_details(stored, store.read_facts("errors")).collect()}
    assert found == {(i, a): sorted(t for s, b, t in texts if (s, b) == (i, a) and t is not None) for i in (1, 2) for a in most}


@pytest.mark.parametrize("umlauts", [0, 1, 1200])
def test_all_error_texts_of_a_stored_scan(spark, tmp_path, umlauts):
    docs = [(k, "grün" if k < umlauts else "grau", "de", "src5", 4) for k in range(1300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    rows = QUERIES["A8_error_details"](spark, str(tmp_path)).collect()
    texts = sorted(f"src5/de/{k}.java: accent" for k in range(umlauts))
    assert [tuple(r) for r in rows] == ([("java_complexity", umlauts, "|".join(texts))] if texts else [])
