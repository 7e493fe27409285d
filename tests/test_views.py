import random

import pytest
from pyspark.sql import functions as F

from treegauge.operators import reshape, views
from treegauge.specs import ViewSpec

SCHEMA = ("scan_id int, file_path string, change_type string, tech_stack string, analyzer_id string, "
          "tags map<string,string>, value_after double")


def random_rows(seed, n=400):
    rng = random.Random(seed)
    pick = rng.choice
    rows = []
    for i in range(n):
        tags = {"metric": pick(["m1", "m2"]), "category": pick(["size", "logging"]), "owner": pick("xyz")}
        for k in list(tags):
            if rng.random() < 0.1:
                del tags[k]
        rows.append((pick([1, 2, 2, 2]), f"d{i % 3}/f{i}{pick(['.rs', '.py', '', '.tar.gz'])}", pick("AMD"),
                     pick(["Rust", "Python", None]), pick(["a", "b"]), tags,
                     pick([None, 0.0, -5.0, float(rng.randint(1, 40)) * 250])))
    return rows


def ext(path):
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1] if "." in name[1:] else ""


def key_of(row, key, missing):
    scan, path, change, stack, analyzer, tags, _ = row
    value = {"tech_stack": stack, "change_type": change, "analyzer_id": analyzer, "extension": ext(path),
             "category": tags.get("category"), "metric_key": tags.get("metric"),
             "tag:owner": tags.get("owner")}.get(key, "Other")
    return missing if value is None else value


KEYS = ["tech_stack", "extension", "tag:owner", "category", "nope"]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("keys", [KEYS[:1], KEYS[1:3], KEYS])
def test_tree_agrees_with_model(spark, seed, keys):
    rows = random_rows(seed)
    levels = views.run_view(spark.createDataFrame(rows, SCHEMA), ViewSpec("sum", group_by=tuple(keys)))
    got = {(r.scan_id, *(r[f"k{i + 1}"] for i in range(r.depth))): (r.value, r.label, r.group_key)
           for r in levels.collect()}
    expected = {}
    for row in rows:
        if row[-1] is not None and row[-1] > 0:
            path = [key_of(row, k, "Unknown") for k in keys]
            for depth in range(1, len(keys) + 1):
                node = (row[0], *path[:depth])
                value = expected.get(node, (0.0,))[0] + row[-1]
                expected[node] = (value, path[depth - 1], keys[depth - 1])
    assert got == expected


@pytest.mark.parametrize("seed", [3, 4])
def test_distribution_agrees_with_model(spark, seed):
    rows = random_rows(seed)
    bounds = (0.5, 1000.0, 5000.0)
    got = views.run_view(spark.createDataFrame(rows, SCHEMA), ViewSpec("distribution", buckets=bounds), 2).collect()
    counts = [0] * 4
    for row in rows:
        if row[0] == 2:
            v = row[-1] or 0.0
            counts[next((i for i, b in enumerate(bounds) if v < b), 3)] += 1
    assert [(r.bucket, r.label, r.value) for r in sorted(got)] == list(
        zip(range(4), ["< 0.5", "0.5 - 1000", "1000 - 5000", ">= 5000"], map(float, counts)))


@pytest.mark.parametrize("func", ["avg", "min", "max"])
def test_stats_agree_with_model(spark, func):
    rows = random_rows(5)
    m = spark.createDataFrame(rows, SCHEMA)
    fold = {"avg": lambda v: sum(v) / len(v), "min": min, "max": max}[func]
    by_ext, by_stack = {}, {}
    for r in rows:
        by_ext.setdefault((r[0], ext(r[1]), r[3] or ""), []).append(r[-1] or 0.0)
        by_stack.setdefault((r[0], r[3]), []).append(r[-1])
    got = views.run_view(m, ViewSpec(func, group_by=("extension", "tech_stack"))).collect()
    assert {(r.scan_id, r.k1, r.k2): r.value for r in got} == pytest.approx({k: fold(v) for k, v in by_ext.items()})
    got = views.run_view(m, ViewSpec(func, group_by=("tech_stack",))).collect()
    clean = {k: [x for x in v if x is not None] for k, v in by_stack.items()}
    assert {(r.scan_id, r.k1): r.value for r in got} == pytest.approx({k: fold(v) for k, v in clean.items()})
    assert {r.label for r in got} == {"Rust", "Python", "Unknown"}


def test_top_n_ties_scans_and_order(spark):
    rows = random_rows(6)
    m = spark.createDataFrame(rows, SCHEMA)
    for order, sign in (("desc", -1), ("asc", 1)):
        spec = ViewSpec("top_n", limit=7, order=order)
        every = views.run_view(m, spec).collect()
        for scan in (1, 2):
            expected = sorted((sign * r[-1], r[1]) for r in rows if r[0] == scan and r[-1] and r[-1] > 0)[:7]
            one = [(sign * r.value, r.label) for r in views.run_view(m, spec, scan).collect()]
            assert one == expected
            assert sorted((sign * r.value, r.label) for r in every if r.scan_id == scan) == expected


def test_top_n_over_all_scans_cuts_before_the_shuffle(spark):
    from suite.plans import final_plan

    plan = final_plan(views.run_view(spark.createDataFrame(random_rows(7), SCHEMA), ViewSpec("top_n", limit=3)))
    assert plan.count("WindowGroupLimit") == 4  # two rounds, each cut before and after its shuffle


def test_empty_scan(spark):
    m = spark.createDataFrame([], SCHEMA)
    assert views.run_view(m, ViewSpec("sum"), 9).collect()[0].asDict() == {"scan_id": 9, "label": "Total", "value": 0.0}
    assert views.run_view(m, ViewSpec("max"), 9).first().value == 0.0
    assert [r.value for r in views.run_view(m, ViewSpec("distribution", buckets=(1, 2)), 9).collect()] == [0.0] * 3


def test_blank_group_by_is_no_grouping(spark):
    m = spark.createDataFrame(random_rows(8), SCHEMA)
    spec = ViewSpec("sum", group_by=("tech_stack",))
    assert [r.label for r in views.run_view(m, spec, 1, group_by=" , ").collect()] == ["Total"]


def test_switchable_defaults_to_added(spark):
    m = spark.createDataFrame(random_rows(9), SCHEMA)
    spec = ViewSpec("top_n", limit=50, change_type_mode="switchable")
    assert {r.change_type for r in views.run_view(m, spec).collect()} == {"A"}
    assert {r.change_type for r in views.run_view(m, spec, change_type="D").collect()} == {"D"}


def test_sibling_rank(spark):
    rng = random.Random(10)
    rows = [(1, f"f{i}", "A", rng.choice("ab"), "x", {"owner": f"o{rng.randint(0, 200)}"}, float(rng.randint(1, 60)))
            for i in range(600)]
    levels = views.run_view(spark.createDataFrame(rows, SCHEMA), ViewSpec("sum", group_by=("tech_stack", "tag:owner")))
    ranked = views.sibling_rank(levels).collect()
    assert len(ranked) == levels.count()
    for r in ranked:
        siblings = [s for s in ranked if s.depth == r.depth and (r.depth == 1 or s.k1 == r.k1)]
        assert r.sibling_rank == 1 + sum(s.value > r.value for s in siblings)


def test_leaves_and_flattening(spark):
    m = spark.createDataFrame([
        (1, "a.rs", "A", "Rust", "x", {"category": "size"}, 2.5), (1, "b", "M", None, "x", {}, 1.0)], SCHEMA)
    spec = ViewSpec("sum", group_by=("tech_stack", "category"), change_type_mode="all")
    keys = views.effective_keys(spec)
    assert keys == ["tech_stack", "category", "change_type"]
    found = reshape.leaves(views.view_items(m, spec), keys).collect()
    assert {(r.label, r.value, r.group) for r in found} == {("a.rs", 3.0, "Rust:size(A)"), ("b", 1.0, "(M)")}
    flat = reshape.flatten_change_type(views.run_view(m, spec)).collect()
    assert {r.label for r in flat} == {"Rust:size(A)", "Unknown:Unknown(M)"}
    plain = reshape.leaves(views.view_items(m, spec), ["tech_stack"]).collect()
    assert {(r.label, r.group) for r in plain} == {("a.rs", "Rust"), ("b", None)}


def test_search(spark):
    rows = [(1, "src/Main.rs", 1.0, "Rust"), (1, "x.py", 2.0, None), (1, "y.py", 3.0, "mainly")]
    df = spark.createDataFrame(rows, "scan_id int, label string, value double, `group` string")

    def found(*args, **kw):
        return [r.label for r in reshape.search_leaves(df, *args, **kw).collect()]

    assert found("main") == ["src/Main.rs", "y.py"]
    assert found("main", case_sensitive=True) == ["y.py"]
    assert found(r"^\w\.PY$", regex=True) == ["x.py", "y.py"]
    assert found(r"^\w\.PY$", regex=True, case_sensitive=True) == []
    assert len(found("  ")) == len(found("(", regex=True)) == 3


def test_csv_export(spark, tmp_path):
    from treegauge.sources.tables import export_csv

    rows = [(1, 'a "b", c', 2.5, None), (1, "d", -2.5, "g")]
    df = spark.createDataFrame(rows, "scan_id int, label string, value double, `group` string").coalesce(1)
    export_csv(df, str(tmp_path / "g"), with_group=True)
    export_csv(df, str(tmp_path / "n"), with_group=False)

    def text(name):
        return next((tmp_path / name).glob("part-*.csv")).read_text().splitlines()

    assert text("g") == ['"Group","Label","Value"', '"","a ""b"", c","3"', '"g","d","-2"']
    assert text("n") == ['"Label","Value"', '"a ""b"", c","3"', '"d","-2"']


@pytest.mark.parametrize("bad", [
    {"func": "median"}, {"func": "top_n", "order": "up"}, {"func": "distribution"},
    {"func": "distribution", "buckets": (3, 1)}, {"func": "sum", "change_type_mode": "x"}])
def test_refused_views(bad):
    with pytest.raises(ValueError):
        ViewSpec(**bad)


def test_analyzer_id_may_be_one_string(spark):
    assert ViewSpec("top_n", "char_count").analyzer_id == ("char_count",)
    m = spark.createDataFrame(random_rows(11, 50), SCHEMA)
    for spec in (ViewSpec("min", "char_count", group_by=("extension",)), ViewSpec("top_n", change_type_mode="switchable")):
        views.run_view(m, spec, 2).collect()
