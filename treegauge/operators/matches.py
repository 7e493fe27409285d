"""Hit positions of pattern analyzers, and the drill-down from metrics to hits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treegauge.functions.tags import tag_literal
from treegauge.functions.text import (
    UNIVERSAL_LINE_BREAK,
    all_hits,
    java_pattern,
    let,
    newlines,
    running_starts,
    strip,
)
from treegauge.operators.analyzers import runs_on
from treegauge.operators.paging import page_of
from treegauge.specs import Analyzer, PatternAnalyzer, ScanRules, registry

MATCH_COLUMNS = [
    "scan_id",
    "file_path",
    "analyzer_id",
    "line_number",
    "column_start",
    "column_end",
    "matched_text",
    "context_before",
    "context_after",
]
_MATCH = (
    "array<struct<analyzer_id:string,line_number:int,column_start:int,column_end:int,"
    "matched_text:string,context_before:string,context_after:string>>"
)
_WIDTH = {"byte": F.octet_length, "char": F.length}


def _empty(array_type: str) -> Column:
    return F.array().cast(array_type)


def _placed(content: Column, finder: Column, unit: str) -> Column:
    """Hits of one finder (analyzer_id, regex, found) with their offset and zero-based line.

    The hits and the gaps between them tile the content, so running totals over both give the
    positions.
    """
    width = _WIDTH[unit]
    found = finder["found"]

    def place(gaps: Column) -> Column:
        padded = F.concat(found, F.array(F.lit("")))

        def totals(pieces: Column) -> Column:
            widths = F.transform(pieces, lambda p: width(p))
            return F.struct(
                running_starts(widths).alias("offset"),
                running_starts(F.transform(pieces, newlines)).alias("line"),
            )

        return let(
            let(F.zip_with(gaps, padded, lambda g, h: F.concat(g, h)), totals),
            lambda b: F.transform(
                found,
                lambda hit, k: F.struct(
                    finder["analyzer_id"].alias("analyzer_id"),
                    (b["offset"][k] + width(gaps[k])).alias("start"),
                    (b["line"][k] + newlines(gaps[k])).alias("line"),
                    hit.alias("text"),
                ),
            ),
        )

    return let(F.split(content, finder["regex"], -1), place)


def _all_placed(content: Column, finders: list[PatternAnalyzer], rules: ScanRules, unit: str):
    """Placed hits of every finder that runs on the file, finder by finder, pattern by pattern.

    Each pattern is searched once as a constant; only those that hit go on to be placed.
    """
    searched = F.array(
        *[
            F.struct(
                F.lit(a.analyzer_id).alias("analyzer_id"),
                F.lit(java_pattern(pattern)).alias("regex"),
                F.when(runs_on(a, rules), all_hits(content, pattern)).alias("found"),
            )
            for a in finders
            for pattern in a.patterns
        ]
    )
    hitting = F.filter(searched, lambda f: F.size(f["found"]) > 0)
    return F.flatten(F.transform(hitting, lambda f: _placed(content, f, unit)))


def _with_lines(content: Column, hits: Column, unit: str) -> Column:
    """Hits with line numbers, columns and the stripped lines around them."""
    width = _WIDTH[unit]

    def finish(hits: Column, starts: Column, context: Column) -> Column:
        n_lines = F.size(context) - (F.element_at(context, -1) == "").cast("int")

        def one(hit: Column, n: Column) -> Column:
            line, column = hit["line"], hit["start"] - starts[hit["line"]] + 1
            return F.struct(
                hit["analyzer_id"].alias("analyzer_id"),
                (line + 1).alias("line_number"),
                column.alias("column_start"),
                (column + width(hit["text"])).alias("column_end"),
                hit["text"].alias("matched_text"),
                F.when(line > 0, strip(F.get(context, line - 1))).alias("context_before"),
                F.when(line + 1 < n, strip(F.get(context, line + 1))).alias("context_after"),
            )

        return let(n_lines, lambda n: F.transform(hits, lambda hit: one(hit, n))).cast(_MATCH)

    def with_starts(hits: Column, lines: Column) -> Column:
        widths = F.transform(lines, lambda line: width(line) + 1)
        context = lines if unit == "byte" else F.split(content, UNIVERSAL_LINE_BREAK, -1)
        return let(
            running_starts(widths), lambda s: let(context, lambda ctx: finish(hits, s, ctx))
        )

    return let(
        hits,
        lambda hs: F.when(F.size(hs) == 0, _empty(_MATCH)).otherwise(
            let(F.split(content, "\n", -1), lambda lines: with_starts(hs, lines))
        ),
    )


def extract_matches(
    file_changes: DataFrame, analyzers: Iterable[Analyzer], rules: ScanRules
) -> DataFrame:
    """One row per hit of the selected pattern analyzers, old and new side (`side`).

    Narrow: positions come from array arithmetic within the row, so neither content nor hits are
    shuffled. Old-side hits carry the old path. Line numbers and columns count from 1; columns
    count bytes or characters as the analyzer's unit says.
    """
    finders = [
        a
        for a in registry(analyzers).values()
        if isinstance(a, PatternAnalyzer) and rules.stacks_using(a.analyzer_id)
    ]
    content = F.col("_content")
    sides = F.array(
        F.struct(
            F.lit("before").alias("side"),
            F.coalesce("old_file_path", "file_path").alias("file_path"),
            F.col("old_content").alias("_content"),
        ),
        F.struct(
            F.lit("after").alias("side"),
            F.col("file_path"),
            F.col("content").alias("_content"),
        ),
    )
    texts = file_changes.select(
        "scan_id", "scan_mode", "change_type", "tech_stack", F.inline(sides)
    ).where(content.isNotNull())

    by_unit = []
    for unit in _WIDTH:
        of_unit = [a for a in finders if a.unit == unit]
        if of_unit:
            by_unit.append(_with_lines(content, _all_placed(content, of_unit, rules, unit), unit))
    found = F.concat(*by_unit) if by_unit else _empty(_MATCH)
    return texts.select("scan_id", "file_path", "side", F.inline(found)).select(
        *MATCH_COLUMNS, "side"
    )


def match_filter(
    matches: DataFrame,
    scan_id: int,
    file_path: str | None = None,
    analyzer_id: str | None = None,
) -> DataFrame:
    """Hits of one scan, optionally of one file or one analyzer."""
    chosen = matches.where(F.col("scan_id") == scan_id)
    for name, value in (("file_path", file_path), ("analyzer_id", analyzer_id)):
        if value is not None:
            chosen = chosen.where(F.col(name) == value)
    return chosen


def match_count(matches: DataFrame, keys: Iterable[str] = ("scan_id", "file_path")) -> DataFrame:
    """Number of hits per key."""
    return matches.groupBy(*keys).agg(F.count("*").alias("total"))


def _page_size(size: int) -> int:
    if size < 1:
        raise ValueError(f"a page holds at least one row, not {size}")
    return size


_PAGE_ORDER = ["line_number", "column_start", "analyzer_id", "column_end"]


def page_matches(
    matches: DataFrame,
    scan_id: int,
    file_path: str,
    analyzer_id: str | None = None,
    page: int = 1,
    page_size: int = 100,
) -> DataFrame:
    """One page of the hits of one file, by line; pages are as large as asked for. A deep page sorts its own range only."""
    size = _page_size(page_size)
    rows = match_filter(matches, scan_id, file_path, analyzer_id)
    return page_of(rows, [(name, False) for name in _PAGE_ORDER], (max(page, 1) - 1) * size, size)


def number_pages(matches: DataFrame, page_size: int = 100) -> DataFrame:
    """All hits with the page of their file they stand on; a window holds the hits of one file,
    which came out of one row."""
    size = _page_size(page_size)
    w = Window.partitionBy("scan_id", "file_path").orderBy(*_PAGE_ORDER)
    page = ((F.row_number().over(w) - 1) / size).cast("bigint") + 1
    return matches.withColumn("page", page)


def drilldown(metrics: DataFrame, matches: DataFrame) -> DataFrame:
    """The hits behind metric rows: equi-join on scan, file and analyzer.

    Each hit comes once. Where an analyzer has several rows for a file (by tags), their values are added up.
    """
    keys = ["scan_id", "file_path", "analyzer_id"]
    chosen = metrics.groupBy(*keys).agg(F.min("tech_stack").alias("tech_stack"), F.sum("value_after").alias("value_after"))
    return matches.join(chosen, keys)


def with_tags(matches: DataFrame, analyzers: Iterable[Analyzer]) -> DataFrame:
    """Hits with the tags of their analyzer; the lookup is a constant map of the given specs."""
    specs = registry(analyzers)
    tags = None
    for analyzer_id, analyzer in specs.items():
        hit, literal = F.col("analyzer_id") == analyzer_id, tag_literal(analyzer.tags)
        tags = F.when(hit, literal) if tags is None else tags.when(hit, literal)
    return matches.withColumn("tags", tags)
