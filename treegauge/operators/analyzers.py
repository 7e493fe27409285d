"""Built-in analyzers: every selected analyzer over both sides of a file in one narrow pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.functions.tags import tag_literal
from treegauge.functions.text import count_hits
from treegauge.specs import (
    FILE_COUNT,
    Analyzer,
    CharCount,
    FileCount,
    PatternAnalyzer,
    PythonAnalyzer,
    ScanRules,
    registry,
)

FILE_KEYS = ["scan_id", "file_path", "change_type", "old_file_path", "tech_stack"]
METRIC_COLUMNS = [
    *FILE_KEYS,
    "analyzer_id",
    "tags",
    "value_before",
    "value_after",
    "scope",
]


def runs_on(analyzer: Analyzer, rules: ScanRules) -> Column:
    """True where the analyzer is selected for the file and fits its scan mode and change type."""
    if analyzer.analyzer_id == FILE_COUNT.analyzer_id:
        selected = F.lit(True)
    else:
        stacks = rules.stacks_using(analyzer.analyzer_id)
        selected = F.coalesce(F.col("tech_stack").isin(stacks), F.lit(False))
    for name in ("scan_mode", "change_type"):
        value = analyzer.restriction(name)
        if value is not None:
            selected = selected & (F.upper(F.col(name)) == value)
    return selected


def is_selectable(analyzer: Analyzer, rules: ScanRules) -> bool:
    """False for an analyzer that no stack uses: it can never run."""
    return analyzer.analyzer_id == FILE_COUNT.analyzer_id or bool(
        rules.stacks_using(analyzer.analyzer_id)
    )


def value_of(analyzer: Analyzer, content: Column) -> Column:
    """The analyzer's value for one content column."""
    if isinstance(analyzer, FileCount):
        return F.lit(1.0)
    if isinstance(analyzer, CharCount):
        return F.length(content).cast("double")
    if isinstance(analyzer, PatternAnalyzer):
        return (count_hits(content, list(analyzer.patterns)) + F.lit(analyzer.base)).cast("double")
    raise TypeError(f"{type(analyzer).__name__} is not a built-in analyzer")


def analyze(
    file_changes: DataFrame, analyzers: Iterable[Analyzer], rules: ScanRules
) -> DataFrame:
    """Metric rows of all built-in analyzers, zeros included.

    A value is NULL where its side is absent or undecodable, so before and after stand side by
    side without a join. Python analyzers in the list are left to `user_analyzers`.
    """
    entries = []
    for analyzer in registry(analyzers).values():
        if isinstance(analyzer, PythonAnalyzer) or not is_selectable(analyzer, rules):
            continue
        runs = runs_on(analyzer, rules)
        sides = [
            F.when(runs & F.col(side).isNotNull(), value_of(analyzer, F.col(side))).alias(name)
            for side, name in (("old_content", "value_before"), ("content", "value_after"))
        ]
        entries.append(
            F.struct(
                F.lit(analyzer.analyzer_id).alias("analyzer_id"),
                tag_literal(analyzer.tags).alias("tags"),
                *sides,
                F.lit(None).cast("string").alias("scope"),
            )
        )
    rows = file_changes.select(*FILE_KEYS, F.inline(F.array(*entries)))
    return rows.where(F.col("value_before").isNotNull() | F.col("value_after").isNotNull())
