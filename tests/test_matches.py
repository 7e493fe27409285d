import random
import re

import pytest
from pyspark.sql import functions as F

from treegauge.operators.analyzers import analyze
from treegauge.operators.matches import (
    drilldown,
    extract_matches,
    match_count,
    match_filter,
    number_pages,
    page_matches,
)
from treegauge.operators.metrics import drop_zero
from treegauge.plans.presets import (
    API_KEY_FINDER,
    GOSU_COMPLEXITY,
    JAVA_COMPLEXITY,
    LOG_LEVELS,
    TODO_FINDER,
)
from treegauge.sources.files import snapshot_changes
from treegauge.specs import ScanRules, StackRule, regex_analyzer

FINDERS = [
    regex_analyzer("words", r"\b(?:if|the|é+)\b"),
    regex_analyzer("spans", r"\w\s+\w"),
    regex_analyzer("lines", r"a.*"),
]
RULES = ScanRules((StackRule("T", ("txt",), tuple(a.analyzer_id for a in FINDERS)),))


def brute_force(text, pattern, unit):
    """The hits of one pattern by plain Python."""
    lines = text.split("\n") if unit == "byte" else text.splitlines()
    if unit == "byte" and lines[-1] == "":
        lines.pop()
    size = (lambda s: len(s.encode())) if unit == "byte" else len
    for m in re.finditer(pattern, text):
        before = text[: m.start()]
        line = before.count("\n")
        column = size(before[before.rfind("\n") + 1 :]) + 1
        yield (
            line + 1, column, column + size(m.group()), m.group(),
            lines[line - 1].strip() if line > 0 else None,
            lines[line + 1].strip() if line + 1 < len(lines) else None,
        )


def extracted(df):
    return sorted(
        (r.analyzer_id, r.line_number, r.column_start, r.column_end, r.matched_text,
         r.context_before or "", r.context_after or "") for r in df.collect())


def random_text(rng, n):
    return "".join(rng.choice(["a", "if", "é", "the", " ", "  ", "\n", "\r\n", "\t", "x", "😀", "\n\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_positions_agree_with_brute_force(spark, tree, seed):
    rng = random.Random(seed)
    texts = {f"f{i}.txt": random_text(rng, rng.choice([0, 1, 5, 40, 400])) for i in range(25)}
    found = extract_matches(snapshot_changes(tree(texts), RULES, 1), FINDERS, RULES).cache()
    for path, text in texts.items():
        expected = sorted(
            (a.analyzer_id, *hit[:4], hit[4] or "", hit[5] or "")
            for a in FINDERS for hit in brute_force(text, a.patterns[0], "byte"))
        assert extracted(found.where(F.col("file_path") == path)) == expected
    found.unpersist()


def test_one_very_long_line(spark, tree):
    text = "if(x);" * 20000
    changes = snapshot_changes(tree({"min.txt": text}), RULES, 1)
    rows = extract_matches(changes, FINDERS[:1], RULES)
    stats = rows.agg(F.count("*"), F.max("column_start"), F.max("line_number")).first()
    assert tuple(stats) == (20000, 6 * 19999 + 1, 1)


JAVA = """
int grade(int points) {
    if (points > 50) {
        return 1;
    }
    for (int i = 0; i < 3; i++) { points += i; }
    return points;
}
"""
GOSU = """
function pick(list : List) {
  if (ready and list != null) { run() }
  else { stop() }
  var first = head ?: none
  foreach (x in list) {
    switch (x) { case 1: return
      case 2: return }
  }
}
"""


def complexity(tree, analyzer, text):
    rules = ScanRules((StackRule("All", ("src",), (analyzer.analyzer_id,)),))
    changes = snapshot_changes(tree({"a.src": text}), rules, 1)
    value = analyze(changes, [analyzer], rules).where(F.col("analyzer_id") == analyzer.analyzer_id)
    return value.first().value_after, extract_matches(changes, [analyzer], rules).collect()


def test_java_sample(spark, tree):
    value, found = complexity(tree, JAVA_COMPLEXITY, JAVA)
    assert value == 3
    assert [m.matched_text for m in found] == ["if", "for"]
    assert (found[0].line_number, found[0].column_start, found[0].column_end) == (3, 5, 7)


def test_gosu_sample(spark, tree):
    value, found = complexity(tree, GOSU_COMPLEXITY, GOSU)
    assert value == 8
    assert len(found) == 7


def test_else_if_counts_twice(spark, tree):
    value, _ = complexity(tree, JAVA_COMPLEXITY, "if (a) {} else\n  if (b) {}")
    assert value == 1 + 2 + 1


def test_character_columns_and_universal_line_ends(spark, tree):
    text = "é; if x\x0bsecond\nwhile é && if"
    _, found = complexity(tree, JAVA_COMPLEXITY, text)
    expected = sorted(hit for p in JAVA_COMPLEXITY.patterns for hit in brute_force(text, p, "char"))
    got = sorted((m.line_number, m.column_start, m.column_end, m.matched_text, m.context_before, m.context_after)
                 for m in found)
    assert got == expected


LOG_SAMPLE = """info!("a"); console.log(1); println("x"); appLogger.info("y")
warn!("a"); console.warn(1); Log.warning("z")
error!("a"); eprintln("b"); logging.exception("c")
trace!("t"); debug!("d"); logger.debug("e")
// TODO: tidy up
key = "sk-abcdefghijklmnopqrstuvwxyz0123456789"
"""


def test_preset_finders(spark, tree):
    finders = [*LOG_LEVELS, TODO_FINDER, API_KEY_FINDER]
    rules = ScanRules((StackRule("All", ("rs",), tuple(a.analyzer_id for a in finders)),))
    rows = drop_zero(analyze(snapshot_changes(tree({"a.rs": LOG_SAMPLE}), rules, 1), finders, rules))
    expected = {a.analyzer_id: float(len(re.findall(a.patterns[0], LOG_SAMPLE))) for a in finders}
    got = {r.analyzer_id: r.value_after for r in rows.collect() if r.analyzer_id != "file_count"}
    assert got == expected and expected["log_info_finder"] == 4


def test_counts_pages_and_drilldown(spark, tree):
    rng = random.Random(5)
    changes = snapshot_changes(tree({f"f{i}.txt": random_text(rng, 300) for i in range(4)}), RULES, 1)
    metrics = drop_zero(analyze(changes, FINDERS, RULES))
    found = extract_matches(changes, FINDERS, RULES).cache()
    counts = match_count(found, ["scan_id", "file_path", "analyzer_id"])
    joined = metrics.where("analyzer_id <> 'file_count'").join(counts, ["scan_id", "file_path", "analyzer_id"], "full_outer")
    assert all(r.value_after == r.total for r in joined.collect())
    assert drilldown(metrics, found).count() == found.count()

    whole = match_filter(found, 1, "f0.txt").count()
    pages = [page_matches(found, 1, "f0.txt", page=p, page_size=30).collect() for p in range(1, whole // 30 + 2)]
    assert sum(map(len, pages)) == whole and all(len(p) == 30 for p in pages[:-1])
    ordered = [(m.line_number, m.column_start, m.analyzer_id) for p in pages for m in p]
    assert ordered == sorted(ordered)
    assert page_matches(found, 1, "f0.txt", page=-3, page_size=10**6).count() == whole
    with pytest.raises(ValueError):
        number_pages(found, 0)
    twice = metrics.unionByName(metrics)  # as with a second set of tags
    assert drilldown(twice, found).count() == found.count()
    numbered = number_pages(found, 30).where("file_path = 'f0.txt'").groupBy("page").count().collect()
    assert sorted((r.page, r["count"]) for r in numbered) == [(i + 1, len(p)) for i, p in enumerate(pages) if p]
    found.unpersist()
