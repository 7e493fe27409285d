"""Path columns: extension, last segment and glob predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """Last path segment."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; '' for no dot and for dot-files. Case is kept."""
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)


def _segment_regex(segment: str) -> str | None:
    """Regex of one glob path segment, or None when the segment is not a valid glob."""
    if "**" in segment:
        return None
    pieces = re.findall(r"\*|\?|\[!?.[^\]]*\]|[^*?\[]+|\[", segment, flags=re.S)
    out = []
    for piece in pieces:
        if piece == "*":
            out.append("[^/]*")
        elif piece == "?":
            out.append("[^/]")
        elif piece == "[":
            return None
        elif piece.startswith("["):
            negated = piece.startswith("[!")
            members = piece[2 if negated else 1 : -1]
            members = re.sub(r"([\\\[\]^&~])", r"\\\1", members)
            out.append(f"(?!/)[{'^' if negated else ''}{members}]")
        else:
            out.append(re.escape(piece))
    return "".join(out)


def glob_regex(glob: str) -> str | None:
    """Java regex for a glob: `*` and `?` stay within a segment, a whole `**` segment spans any
    number of them. None for an invalid glob, which matches nothing."""
    *parents, last = glob.split("/")
    out = []
    for segment in parents:
        if segment == "**":
            out.append("(?:.*/)?")
        else:
            regex = _segment_regex(segment)
            if regex is None:
                return None
            out.append(regex + "/")
    tail = ".*" if last == "**" else _segment_regex(last)
    return None if tail is None else "".join(out) + tail


def matches_any_glob(path: Column, globs: Iterable[str]) -> Column:
    """True where the path matches one of the globs (ASCII case-insensitive): one regex for all."""
    regexes = [r for r in map(glob_regex, globs) if r is not None]
    if not regexes:
        return F.lit(False)
    return path.rlike("(?is)^(?:" + "|".join(regexes) + r")\z")
