import random

from treegauge.operators.diff import changed_paths, version_diff
from treegauge.operators import renames
from treegauge.operators.renames import exact_pairs
from treegauge.session import cut_lineage
from treegauge.specs import ScanRules


def lines(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(n)]


def renamed(spark, tree, base, target, how):
    rows = version_diff(tree(base), tree(target), ScanRules(), 1, how).collect()
    return {r.file_path: r.old_file_path for r in rows if r.change_type == "M"}, rows


def test_hot_group_of_copies_pairs_one_to_one(spark, tree):
    base = {f"old/{i}": "same text" for i in range(900)}
    target = {f"new/{i}": "same text" for i in range(600)}
    changed = cut_lineage(changed_paths(tree(base), tree(target)))
    pairs = exact_pairs(changed).collect()
    assert len(pairs) == 600
    assert len({p.old_path for p in pairs}) == len({p.new_path for p in pairs}) == 600


def test_similar_files_pair_and_others_do_not(spark, tree):
    rng = random.Random(3)
    base, target, expected = {}, {}, {}
    for i in range(30):
        body = lines(rng, 20)
        base[f"old/{i}"] = "\n".join(body)
        target[f"new/{i}"] = "\n".join(body[:17] + lines(rng, 3))
        expected[f"new/{i}"] = f"old/{i}"
    base["old/gone"], target["new/fresh"] = "\n".join(lines(rng, 20)), "\n".join(lines(rng, 20))
    base["old/moved"] = target["new/moved"] = "exactly\nthe same"
    expected["new/moved"] = "old/moved"
    got, rows = renamed(spark, tree, base, target, "similar")
    assert {r.file_path: r.change_type for r in rows if r.change_type != "M"} == {"old/gone": "D", "new/fresh": "A"}
    assert got == expected
    row = next(r for r in rows if r.file_path == "new/5")
    assert (row.content, row.old_content) == (target["new/5"], base["old/5"])


def test_a_large_family_of_near_copies_pairs_completely(spark, tree):
    rng = random.Random(4)
    common = lines(rng, 30)
    base = {f"old/{i}": "\n".join([*common, f"unique {i}"]) for i in range(300)}
    target = {f"new/{i}": "\n".join([*common, f"other {i}"]) for i in range(300)}
    got, rows = renamed(spark, tree, base, target, "similar")
    assert len(got) == len(set(got.values())) == 300 and len(rows) == 300


def test_exact_only_leaves_similar_files_alone(spark, tree):
    got, rows = renamed(spark, tree, {"a/x": "1\n2\n3"}, {"b/x": "1\n2\n3\n4"}, "exact")
    assert not got and {r.change_type for r in rows} == {"A", "D"}


def test_rename_into_an_excluded_place_is_dropped(spark, tree):
    rules = ScanRules((), ("out/**",))
    rows = version_diff(tree({"in/a": "text"}), tree({"out/a": "text"}), rules, 1, "exact").collect()
    assert rows == []


def test_files_with_a_common_header_find_their_own_partner(spark, tree):
    rng = random.Random(5)
    header = lines(rng, 15)
    base, target = {}, {}
    for i in range(60):
        body = lines(rng, 20)
        base[f"old/{i}"] = "\n".join(header + body)
        target[f"new/{i}"] = "\n".join(header + body[:18] + lines(rng, 2))
    got, rows = renamed(spark, tree, base, target, "similar")
    assert all(new.split("/")[1] == old.split("/")[1] for new, old in got.items())
    assert len(got) == 60


def jaccard(a, b):
    a, b = set(a.split("\n")), set(b.split("\n"))
    return len(a & b) / len(a | b)


def test_no_alike_files_are_left_over(spark, tree):
    rng = random.Random(6)
    pool = lines(rng, 14)
    base = {f"old/{i}": "\n".join(rng.sample(pool, rng.randint(1, 8))) for i in range(16)}
    target = {f"new/{i}": "\n".join(rng.sample(pool, rng.randint(1, 8))) for i in range(12)}
    got, rows = renamed(spark, tree, base, target, "similar")
    assert got and len(set(got.values())) == len(got)
    assert all(jaccard(base[old], target[new]) >= 0.5 for new, old in got.items())
    gone = [r.file_path for r in rows if r.change_type == "D"]
    fresh = [r.file_path for r in rows if r.change_type == "A"]
    assert len(gone) == 16 - len(got) and len(fresh) == 12 - len(got)
    assert not [(a, b) for a in gone for b in fresh if jaccard(base[a], target[b]) >= 0.5]


def test_every_pair_just_above_the_limit_is_found(spark, tree):
    rng = random.Random(7)
    base, target = {}, {}
    for i in range(400):
        body = lines(rng, 10)
        base[f"old/{i}"] = "\n".join(body)
        target[f"new/{i}"] = "\n".join(body[:7] + lines(rng, 3))
    got, _ = renamed(spark, tree, base, target, "similar")
    assert got == {f"new/{i}": f"old/{i}" for i in range(400)}


def line_sets(spark, tree, base, target):
    base, target = tree(base), tree(target)
    return renames._line_sets(changed_paths(base, target), base, target)


def test_files_that_share_a_header_only_do_not_meet(spark, tree):
    rng = random.Random(8)
    header = lines(rng, 20)
    for body in (15, 11):
        sides = [{f"{side}/{i}": "\n".join(header + lines(rng, body)) for i in range(400)} for side in ("old", "new")]
        old, new = line_sets(spark, tree, *sides)
        assert renames.candidate_pairs(old, new).count() == 0  # of 160,000
    pool = [lines(rng, 15) for _ in range(400)]  # now each body line is also in a file of the other side, which is unlike
    base = {f"old/{i}": "\n".join(header + pool[i]) for i in range(400)}
    target = {f"new/{i}": "\n".join(header + [pool[(i + k) % 400][k] for k in range(15)]) for i in range(400)}
    old, new = line_sets(spark, tree, base, target)
    assert renames.candidate_pairs(old, new).count() <= 400 * 15


def test_alike_pairs_against_brute_force(spark, tree):
    rng = random.Random(9)
    pool = lines(rng, 60)
    for low, high in ((1, 8), (20, 45)):
        base = {f"old/{i}": "\n".join(rng.sample(pool, rng.randint(low, high)) + lines(rng, rng.randint(0, 3))) for i in range(60)}
        target = {f"new/{i}": "\n".join(rng.sample(pool, rng.randint(low, high)) + lines(rng, rng.randint(0, 3))) for i in range(50)}
        for level in renames.LEVELS:
            b, t = tree(base), tree(target)
            got = {(r.old_path, r.new_path): r.score for r in renames.alike_pairs(changed_paths(b, t), b, t, level).collect()}
            scores = {(x, y): jaccard(base[x], target[y]) for x in base for y in target}
            assert got == {k: v for k, v in scores.items() if v * level[1] >= level[0]}


def test_chosen_pairs_in_sql(spark, tree):
    """Scores of the chosen pairs and of all pairs left over, recomputed by DuckDB."""
    import duckdb

    rng = random.Random(10)
    pool = lines(rng, 25)
    base = {f"old/{i}": "\n".join(rng.sample(pool, rng.randint(2, 20))) for i in range(70)}
    target = {f"new/{i}": "\n".join(rng.sample(pool, rng.randint(2, 20))) for i in range(60)}
    got, _ = renamed(spark, tree, base, target, "similar")
    con = duckdb.connect()
    con.execute("CREATE TABLE files(path VARCHAR, content VARCHAR); CREATE TABLE pairs(old VARCHAR, new VARCHAR)")
    con.executemany("INSERT INTO files VALUES (?, ?)", [*base.items(), *target.items()])
    con.executemany("INSERT INTO pairs VALUES (?, ?)", [(old, new) for new, old in got.items()])
    least, left, twice = con.execute("""
        WITH sets AS (SELECT path, list_distinct(string_split(content, chr(10))) AS s FROM files),
        scores AS (
          SELECT a.path AS old, b.path AS new, len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) AS score
          FROM sets a, sets b WHERE a.path LIKE 'old/%' AND b.path LIKE 'new/%')
        SELECT (SELECT min(score) FROM scores JOIN pairs USING (old, new)),
          (SELECT count(*) FROM scores WHERE score >= 0.5 AND old NOT IN (SELECT old FROM pairs) AND new NOT IN (SELECT new FROM pairs)),
          (SELECT count(*) - count(DISTINCT old) + count(*) - count(DISTINCT new) FROM pairs)""").fetchone()
    assert least >= 0.5 and left == 0 and twice == 0 and len(got) > 20
