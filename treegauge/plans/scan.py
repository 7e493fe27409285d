"""Whole scans: from file versions to metrics, matches and a summary."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from treegauge.operators.analyzers import analyze
from treegauge.operators.diff import version_diff
from treegauge.operators.matches import extract_matches
from treegauge.operators.metrics import (
    analyzer_runs,
    analyzer_stats,
    drop_zero,
    merge_before_after,
    scan_summary,
)
from treegauge.operators.user_analyzers import (
    run_user_analyzers,
    user_entries,
    user_errors,
    user_matches,
)
from treegauge.session import shared_path
from treegauge.sources.files import snapshot_changes, spread
from treegauge.specs import Analyzer, PythonAnalyzer, ScanRules, registry


@dataclass(frozen=True)
class Scan:
    """The tables of one scan. errors is None without Python analyzers."""

    changes: DataFrame
    metrics: DataFrame
    matches: DataFrame
    stats: DataFrame
    summary: DataFrame
    errors: DataFrame | None


def scan_changes(changes: DataFrame, analyzers: Iterable[Analyzer], rules: ScanRules) -> Scan:
    """Run all analyzers over file changes.

    Python results are written once to the shared folder, since three tables are taken from them.
    """
    specs = list(registry(analyzers).values())
    metrics = analyze(changes, specs, rules)
    matches = extract_matches(changes, specs, rules)
    errors = None
    user = [a for a in specs if isinstance(a, PythonAnalyzer) and rules.stacks_using(a.analyzer_id)]
    if user:
        spark = changes.sparkSession
        path = shared_path(spark, "user-results")
        run_user_analyzers(changes, user, rules).write.parquet(path)
        results = spark.read.parquet(path)
        metrics = metrics.unionByName(merge_before_after(user_entries(results)))
        matches = matches.unionByName(user_matches(results))
        errors = user_errors(results)
    stats = analyzer_stats(analyzer_runs(changes, specs, rules), errors)
    return Scan(changes, drop_zero(metrics), matches, stats, scan_summary(stats), errors)


def snapshot_scan(
    files: DataFrame, analyzers: Iterable[Analyzer], rules: ScanRules, scan_id: int | Column
) -> Scan:
    """Scan one version of a tree."""
    return scan_changes(snapshot_changes(spread(files), rules, scan_id), analyzers, rules)


def diff_scan(
    base: DataFrame,
    target: DataFrame,
    analyzers: Iterable[Analyzer],
    rules: ScanRules,
    scan_id: int | Column,
    renames: str | None = "similar",
) -> Scan:
    """Scan what changed from base to target."""
    changes = version_diff(base, target, rules, scan_id, renames)
    return scan_changes(changes, analyzers, rules)
