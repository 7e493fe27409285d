"""User analyzers for the checks, as a user would write them."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

# Executors get these functions with the query; they need not have this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def complexity_with_matches(file_path, content, change_type):
    """Branch keywords, with the hits of two of them."""
    patterns = (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b",
                r"&&", r"\|\|", r"\?")
    value = 1 + sum(len(re.findall(p, content)) for p in patterns)
    found = [
        {"line_number": content.count("\n", 0, m.start()) + 1, "matched_text": m.group(),
         "file_path": "ignored", "analyzer_id": "ignored"}
        for p in (r"\bif\b", r"\bfor\b") for m in re.finditer(p, content)
    ]
    return [{"value": value, "metric_key": "complexity", "category": "complexity", "matches": found}]


def letters(file_path, content, change_type):
    """Two entries with equal tags: the last one counts."""
    return [{"value": -1.0, "tags": {"metric": "last"}}, {"value": len(content), "tags": {"metric": "last"}}]


def fails_on_some_files(file_path, content, change_type):
    if "ó" in content:
        raise ValueError("no accents please")
    return [{"value": 1.0, "tags": {"metric": "plain"}}]
