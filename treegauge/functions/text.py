"""Text columns: regex dialect, counting, running totals over arrays, trimming, rounding."""

from __future__ import annotations

import functools
import re
from re import _parser as parser  # the parsed form of a pattern: literals, groups, branches and repeats
from collections.abc import Callable
from functools import reduce

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters at which Python's str.splitlines ends a line, as a Java regex.
UNIVERSAL_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


# The characters of the bracketed ASCII classes, as first and last code points.
ASCII_CLASSES = {
    "alnum": ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)),
    "alpha": ((0x41, 0x5A), (0x61, 0x7A)),
    "ascii": ((0x00, 0x7F),),
    "blank": ((0x09, 0x09), (0x20, 0x20)),
    "cntrl": ((0x00, 0x1F), (0x7F, 0x7F)),
    "digit": ((0x30, 0x39),),
    "graph": ((0x21, 0x7E),),
    "lower": ((0x61, 0x7A),),
    "print": ((0x20, 0x7E),),
    "punct": ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "space": ((0x09, 0x0D), (0x20, 0x20)),
    "upper": ((0x41, 0x5A),),
    "word": ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)),
    "xdigit": ((0x30, 0x39), (0x41, 0x46), (0x61, 0x66)),
}
# Texts that are searched before a pattern: so many at most, and none shorter.
MOST_TEXTS, LEAST_TEXT = 8, 2
_PIECE = re.compile(r"\\.|\[:(\^?)([a-z]+):\]|\[\^?\]?|\]|\(\?P?<[A-Za-z_]\w*>|\$|.", re.S)


def _ascii_class(name: str, negated: bool, top: str) -> str:
    """The inside of a bracket for one named class; `top` is the last code point in the engine's spelling."""
    if name not in ASCII_CLASSES:
        raise ValueError(f"unknown character class [:{name}:]")
    ranges = ASCII_CLASSES[name]
    if not negated:
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)
    starts = [0, *(b + 1 for _, b in ranges)]
    gaps = [(a, b - 1) for a, (b, _) in zip(starts, ranges) if a < b]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in gaps) + f"\\u{starts[-1]:04x}-{top}"


def _translated(pattern: str, end: str, top: str) -> str:
    """Named classes spelled out, named groups without their names, and `$` as the end of the text."""
    keep_ends = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out, depth = [], 0
    for piece in _PIECE.finditer(pattern):
        text = piece[0]
        if text.startswith("[:") and len(text) > 2:
            if not depth:
                raise ValueError(f"{text} belongs inside brackets: {pattern!r}")
            text = _ascii_class(piece[2], bool(piece[1]), top)
        elif text.startswith("["):
            depth += 1
        elif text == "]":
            depth = max(depth - 1, 0)
        elif not depth and text.startswith("(?"):
            text = "("
        elif not depth and text == "$" and not keep_ends:
            text = end
        out.append(text)
    return "".join(out)


@functools.lru_cache(maxsize=1024)
def compiles(regex: str) -> bool:
    """Whether the engine that runs Spark's regex functions accepts the pattern; asked on the driver."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(regex)
    except IllegalArgumentException:
        return False
    return True


def java_pattern(pattern: str) -> str:
    """The pattern for Spark's regex functions, with Unicode classes and `.` stopping at \\n only.

    Bracketed classes such as [[:alpha:]] are ASCII, (?P<name>...) is a group, and `$` is the end of the text
    unless the pattern sets the multi-line flag.

    Refused: look-around, back-references, atomic groups and possessive quantifiers (not part of the accepted
    dialect) and patterns that can match the empty string (engines differ in which empty hits they report).
    """
    if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(?:<?[=!]|>)|\\[1-9])", pattern):
        raise ValueError(f"look-around, back-references and atomic groups are not supported: {pattern!r}")
    if re.search(r"[+*?}]\+", re.sub(r"\\.|\[\^?\]?(?:\\.|\[:\^?[a-z]+:\]|[^\]\\])*\]", "x", pattern, flags=re.S)):
        raise ValueError(f"possessive quantifiers are not supported: {pattern!r}")
    try:
        can_be_empty = re.compile(_translated(pattern, r"\Z", r"\U0010ffff")).search("") is not None
    except re.error:  # valid for Java only, e.g. \p{L}
        can_be_empty = False
    if can_be_empty or re.fullmatch(r"(?:\\[bB]|\^|\$)+", pattern):
        raise ValueError(f"pattern can match the empty string: {pattern!r}")
    return "(?Ud)" + _translated(pattern, r"\z", r"\x{10ffff}")


def _least_texts(parsed) -> list[str] | None:
    """Texts of which every match of a parsed pattern holds at least one; None where nothing is sure."""
    best, run = None, ""

    def better(found: list[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for kind, value in [*parsed, (None, None)]:
        if kind is parser.LITERAL:
            run += chr(value)
            continue
        better([run] if run else None)
        run = ""
        if kind is parser.SUBPATTERN:
            _, on, off, inner = value
            better(None if on or off else _least_texts(inner))
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
            better(_least_texts(value[2]))
        elif kind is parser.BRANCH:
            branches = [_least_texts(b) for b in value[1]]
            better(None if None in branches else sorted({t for b in branches for t in b}))
    return best


@functools.lru_cache(maxsize=1024)
def required_texts(pattern: str) -> tuple[str, ...]:
    """Texts of which any content that the pattern hits holds at least one; empty where that cannot be told."""
    try:
        parsed = parser.parse(_translated(pattern, r"\Z", r"\U0010ffff"))
    except re.error:  # valid for Java only
        return ()
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ()
    texts = _least_texts(parsed)
    return tuple(texts) if texts and len(texts) <= MOST_TEXTS and min(map(len, texts)) >= LEAST_TEXT else ()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, also when body uses it in a lambda.

    The value is the start value of an aggregate over nothing, which hands it to `body` uncopied.
    """
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, value, lambda acc, _: acc, body)


def total(xs: Column) -> Column:
    """Sum of an int array."""
    return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)


# Elements of a block of running totals.
BLOCK = 16


def running_totals(xs: Column) -> Column:
    """Inclusive running totals of a non-empty int array by doubling: after the pass of stride s, an element holds the
    sum of itself and the 2 s - 1 before it."""
    last = F.ceil(F.log2(F.size(xs))).cast("int")
    strides = F.transform(F.sequence(F.lit(0), last), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(strides, xs, lambda sums, stride: F.transform(
        sums, lambda x, i: x + F.when(i >= stride, sums[i - stride]).otherwise(0)))


def running_starts(xs: Column) -> Column:
    """Exclusive running totals of a non-empty int array: [0, x1, x1+x2, ...].

    Blocks of `BLOCK` elements are summed, these sums are added up by doubling, and each element adds what stands before
    it in its block. So an element costs about as many additions in an array of a million as in one of a thousand, and a
    row needs no explode, window or shuffle. Short arrays are one block.
    """

    def block(xs: Column) -> Column:
        return F.transform(xs, lambda _, j: total(F.slice(xs, 1, j)))

    def shifted(xs: Column, by: Column) -> Column:
        return F.transform(xs, lambda _, j: by + total(F.slice(xs, 1, j)))

    def by_blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))

        def joined(blocks: Column, ends: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), ends)
            return let(starts, lambda s: F.flatten(F.transform(blocks, lambda x, b: let(s[b], lambda by: shifted(x, by)))))

        return let(cut, lambda bs: let(F.transform(bs, total), lambda ts: let(running_totals(ts), lambda ends: joined(bs, ends))))

    return let(xs, lambda a: F.when(F.size(a) <= BLOCK, block(a)).otherwise(by_blocks(a)))


def _by_charset(content: Column, pattern: str, search: Callable[[Column, Column], Column], nothing: Column) -> Column:
    """The search with Unicode classes, or on pure ASCII content, where both mean the same, with
    the faster ASCII classes; `nothing` where the content lacks what every hit holds."""
    unicode_regex = java_pattern(pattern)
    if not compiles(unicode_regex):
        raise ValueError(f"not a valid pattern: {pattern!r}")
    ascii_regex = unicode_regex.replace("(?Ud)", "(?d)", 1)
    ascii_only = F.octet_length(content) == F.length(content)
    found = F.when(ascii_only, search(content, F.lit(ascii_regex))).otherwise(
        search(content, F.lit(unicode_regex))
    )
    texts = required_texts(pattern)
    if not texts:
        return found
    may_hit = reduce(lambda a, b: a | b, [F.contains(content, F.lit(t)) for t in texts])
    return F.when(~may_hit, nothing).otherwise(found)


def all_hits(content: Column, pattern: str) -> Column:
    """Texts of all non-overlapping hits."""
    return _by_charset(content, pattern, lambda c, regex: F.regexp_extract_all(c, regex, F.lit(0)), F.array().cast("array<string>"))


def count_hits(content: Column, patterns: list[str]) -> Column:
    """Number of non-overlapping hits, summed over the patterns."""
    counts = [_by_charset(content, p, F.regexp_count, F.lit(0)) for p in patterns]
    return reduce(lambda a, b: a + b, counts)


def newlines(x: Column) -> Column:
    """Number of newline characters."""
    return F.length(x) - F.length(F.replace(x, F.lit("\n")))


# The characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends (Spark's plain trim takes spaces only)."""
    return F.trim(x, F.lit(WHITE_SPACE))


def first_line(x: Column) -> Column:
    """First line, without a carriage return at its end."""
    return F.regexp_replace(F.substring_index(x, "\n", 1), r"\r\z", "")


def round_half_up(x: Column) -> Column:
    """Nearest whole number with halves towards plus infinity, also below zero."""
    return F.floor(x + F.lit(0.5)).cast("double")
