"""Tag maps: literals, canonical text and override merging."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

METRIC = "metric"
CATEGORY = "category"


def tag_literal(tags: Mapping[str, str]) -> Column:
    """A map<string,string> constant."""
    if not tags:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in sorted(tags.items()) for x in pair])


def tags_key(tags: Column) -> Column:
    """Canonical JSON text with sorted keys: equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def merge_tags(tags: Column, overrides: Column) -> Column:
    """Both maps together; the overrides win on shared keys."""
    kept = F.map_filter(tags, lambda k, _: ~F.map_contains_key(overrides, k))
    return F.map_concat(kept, overrides)


def parse_tags(text: Column) -> Column:
    """JSON object text as a map; NULL where the text is no valid object."""
    return F.from_json(text, "map<string,string>")
