"""Frozen descriptions of rules, analyzers and views, with argument checks only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from treegauge.functions.tags import CATEGORY, METRIC
from treegauge.functions.text import java_pattern

SNAPSHOT = "SNAPSHOT"
DIFF = "DIFF"


@dataclass(frozen=True)
class StackRule:
    """A named group of files: extension AND (no paths OR one path glob) AND no exclude glob."""

    name: str
    extensions: tuple[str, ...]
    analyzers: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()


@dataclass(frozen=True)
class ScanRules:
    """Ordered stack rules and global exclude globs of one project."""

    stacks: tuple[StackRule, ...] = ()
    global_excludes: tuple[str, ...] = ()

    def stacks_using(self, analyzer_id: str) -> list[str]:
        """Names of the stacks that run an analyzer; of equally named stacks the first counts."""
        first: dict[str, StackRule] = {}
        for stack in self.stacks:
            first.setdefault(stack.name, stack)
        return [name for name, stack in first.items() if analyzer_id in stack.analyzers]


@dataclass(frozen=True)
class Analyzer:
    """What all analyzers share. scan_mode and change_type restrict where it runs; None or 'all'
    means everywhere."""

    analyzer_id: str
    tags: Mapping[str, str] = field(default_factory=dict)
    scan_mode: str | None = None
    change_type: str | None = None

    def restriction(self, name: str) -> str | None:
        """Upper-case restriction value, or None for no restriction."""
        value = getattr(self, name)
        return None if value is None or value.lower() == "all" else value.upper()


@dataclass(frozen=True)
class FileCount(Analyzer):
    """1 per file; runs on every file."""


@dataclass(frozen=True)
class CharCount(Analyzer):
    """Number of Unicode code points."""


@dataclass(frozen=True)
class PatternAnalyzer(Analyzer):
    """base + number of hits of all patterns; its matches count columns in bytes or characters."""

    patterns: tuple[str, ...] = ()
    base: int = 0
    unit: str = "byte"

    def __post_init__(self):
        if not self.patterns or self.unit not in ("byte", "char"):
            raise ValueError("a pattern analyzer needs patterns and unit 'byte' or 'char'")
        for pattern in self.patterns:
            java_pattern(pattern)


@dataclass(frozen=True)
class PythonAnalyzer(Analyzer):
    """User code: func(file_path, content, change_type) -> list of dicts
    {value, tags?, metric_key?, category?, matches?}, or the same as JSON text.
    `tags` are overrides that win over what the code returns; a call may take `time_limit` seconds."""

    func: Callable | None = None
    time_limit: float = 60.0


FILE_COUNT = FileCount("file_count", {METRIC: "file_count", CATEGORY: "size"})
CHAR_COUNT = CharCount("char_count", {METRIC: "char_count", CATEGORY: "size"})


def resolve_tags(
    tags: Mapping[str, str] | None = None,
    metric_key: str | None = "matches",
    category: str | None = None,
) -> dict[str, str]:
    """Explicit tags, then metric_key and category on top of them."""
    resolved = dict(tags or {})
    if metric_key is not None:
        resolved[METRIC] = metric_key
    if category is not None:
        resolved[CATEGORY] = category
    return resolved


def regex_analyzer(
    analyzer_id: str,
    pattern: str,
    *,
    tags: Mapping[str, str] | None = None,
    metric_key: str = "matches",
    category: str | None = None,
    scan_mode: str | None = None,
    change_type: str | None = None,
) -> PatternAnalyzer:
    """Counts the hits of one pattern; match columns are byte positions."""
    return PatternAnalyzer(
        analyzer_id,
        resolve_tags(tags, metric_key, category),
        scan_mode,
        change_type,
        patterns=(pattern,),
    )


def registry(analyzers: Iterable[Analyzer]) -> dict[str, Analyzer]:
    """Analyzers by id, the built-in ones first; on a name clash the last one counts."""
    return {a.analyzer_id: a for a in (FILE_COUNT, CHAR_COUNT, *analyzers)}


VIEW_FUNCS = ("top_n", "sum", "avg", "min", "max", "distribution")
CHANGE_TYPE_MODES = (None, "switchable", "all")


@dataclass(frozen=True)
class ViewSpec:
    """An aggregation view. metric_key and category are shorthand for the tag filters."""

    func: str
    analyzer_id: tuple[str, ...] | str = ()
    tag_filters: Mapping[str, str] = field(default_factory=dict)
    metric_key: str | None = None
    category: str | None = None
    group_by: tuple[str, ...] = ()
    include_children: bool = True
    change_type_mode: str | None = None
    limit: int = 10
    order: str = "desc"
    buckets: tuple[float, ...] = ()

    def __post_init__(self):
        if self.func not in VIEW_FUNCS:
            raise ValueError(f"unknown view function {self.func!r}")
        if self.change_type_mode not in CHANGE_TYPE_MODES:
            raise ValueError(f"unknown change type mode {self.change_type_mode!r}")
        if self.order not in ("asc", "desc") or self.limit < 0:
            raise ValueError("order is 'asc' or 'desc', limit is not negative")
        if list(self.buckets) != sorted(set(self.buckets)):
            raise ValueError("bucket bounds must ascend")
        if self.func == "distribution" and not self.buckets:
            raise ValueError("a distribution needs bucket bounds")
        ids = (self.analyzer_id,) if isinstance(self.analyzer_id, str) else self.analyzer_id
        object.__setattr__(self, "analyzer_id", tuple(ids))

    @property
    def all_tag_filters(self) -> dict[str, str]:
        """Tag filters with the shorthand fields merged in."""
        return resolve_tags(self.tag_filters, self.metric_key, self.category)
