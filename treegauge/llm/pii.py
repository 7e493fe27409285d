"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions beside them.

Base spans are what four patterns match, leftmost and without overlap within a kind, less those that fail a check
(numbers of an address, Luhn digit, number of digits). They are found by linear scans of the whole text. A match that takes in a
neighbour fails as a whole, so two items side by side can hide each other: such spans are the tagger's to find.

* Candidates: an item of these kinds holds a digit or an @, so only stretches of `REACH` characters around those are
  tagged. That is a property of the kinds, not a cap: every such character of every text lies in a stretch.
* Labelled spans: windows of at most `MAX_WINDOWS` stretches (by a hash of the stretch, each wording once) with their base
  spans; windows where a match failed its check are left out, as it may be anything. Beside them, as many windows
  in which items of the sample and made-up items of the four kinds and of unlike kinds (versions, keys, dates, amounts) stand
  apart or side by side in the words of the sample. The tagger (`char_tagger`) is trained on these on the driver, in numpy, with
  a fixed seed and number of steps; its weights are a few thousand numbers.
* Windows of `WINDOW` characters, each begun `STRIDE` after the one before, cover a stretch of any length. Each is
  decoded into tag probabilities; those of overlapping windows are averaged, the middle of a window counting most; one best path
  over the whole stretch, under the rules of begin and inside tags, gives the spans.
* An exact check of its kind holds for a span that the tagger finds, too, and a base span is never touched: a found span
  that overlaps one is dropped. Scoring is one narrow stage.

Null and empty texts have no spans; ids are never looked at, so null and repeated ids are rows like others. A very long text is
scanned whole; its stretches are tagged in blocks of `BLOCK` windows. An empty table gives an empty result; without any
labelled span the made-up ones are all there is to learn from. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegauge.llm import char_tagger
from treegauge.llm.char_tagger import Tagger
from treegauge.llm.common import chosen

KINDS = ("email", "ip", "card", "phone")
MAX_WINDOWS = 3_000
REACH, WINDOW, STRIDE, BLOCK = 24, 96, 48, 256
HIDDEN, STEPS, BATCH, RATE, SEED = 24, 400, 32, 0.03, 7
#: A tagged span counts when its tags are as likely as that on average.
LEAST_CERTAINTY = 0.6

N_TAGS = 1 + 2 * len(KINDS)
_ALLOWED = np.array([[b % 2 == 1 or b == 0 or a in (b, b - 1) for b in range(N_TAGS)] for a in range(N_TAGS)])
_MAY_START = np.array([b % 2 == 1 or b == 0 for b in range(N_TAGS)])

_MAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]")
_MAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Every second digit from the right counts twice, its digits summed; the total ends in 0."""
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _MAIL_NAME.match(text, start - 1):
            start -= 1
        host = _MAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append((start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    runs = [m.span() for m in _DIGITS.finditer(text)]
    joined = [i + 1 < len(runs) and runs[i + 1][0] == runs[i][1] + 1 and text[runs[i][1]] == "." for i in range(len(runs))]
    out, i = [], 0
    while i < len(runs):
        if i + 3 < len(runs) and joined[i] and joined[i + 1] and joined[i + 2]:
            out.append((runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    return out


def is_email(item: str) -> bool:
    name, at, host = item.partition("@")
    return bool(name and at and "@" not in host and _MAIL_HOST.fullmatch(host))


def is_address(item: str) -> bool:
    parts = item.split(".")
    return len(parts) == 4 and all(_DIGITS.fullmatch(p) and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def is_card(item: str) -> bool:
    digits = _NO_DIGIT.sub("", item)
    return 14 <= len(digits) <= 19 and _CARD.fullmatch(item) is not None and luhn(digits)


def is_phone(item: str) -> bool:
    return _PHONE.fullmatch(item) is not None and 10 <= len(_NO_DIGIT.sub("", item)) <= 15


CHECKS = {"email": is_email, "ip": is_address, "card": is_card, "phone": is_phone}


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """What the patterns match: kind, start, end, and whether the check of the kind holds."""
    found = {"email": _emails(text) if "@" in text else [], "ip": _addresses(text),
             "card": [m.span() for m in _CARD.finditer(text)],
             "phone": [m.span() for m in _PHONE.finditer(text)] if "+" in text else []}
    return [(kind, a, b, kind == "email" or CHECKS[kind](text[a:b])) for kind in KINDS for a, b in found[kind]]


def in_order(spans: list[Span]) -> list[Span]:
    """By start, then kind as listed."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """The base spans of a text, in order."""
    return in_order([(kind, a, b) for kind, a, b, holds in base_matches(text) if holds])


def joined_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def stretches(text: str) -> list[tuple[int, int]]:
    """All that lies within `REACH` of a digit or an @."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(length, dtype=np.int8)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        if not y[a:b].any():
            y[a:b] = 2 + 2 * k
            y[a] = 1 + 2 * k
    return y


# --- labelled windows -----------------------------------------------------------------------------------------------


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        out = []
        for text in part["text"]:
            matches = base_matches(text)
            for a, b in ((x + k, min(x + k + WINDOW, y)) for x, y in stretches(text) for k in _starts(y - x)):
                near = [m for m in matches if m[1] < b and m[2] > a]
                if all(m[3] or (m[0] in ("ip", "card") and m[2] - m[1] < 8) for m in near):  # short failed runs are plain numbers
                    spans = [(k, s - a, e - a) for k, s, e, holds in near if holds and s >= a and e <= b]
                    if len(spans) == sum(m[3] for m in near):
                        out.append((text[a:b], joined_spans(spans)))
        yield pd.DataFrame(out, columns=["window", "spans"])


def labelled_windows(docs: DataFrame, limit: int = MAX_WINDOWS) -> list[tuple[str, list[Span]]]:
    """At most `limit` windows of the corpus with their base spans, each wording once, in the order of a hash."""
    hits = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    rows = hits.mapInPandas(_window_rows, "window string, spans string").distinct()
    chosen_rows = rows.orderBy(F.md5("window"), "window").limit(limit).collect()
    return [(r["window"], [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]) for r in chosen_rows]


def _digits(rng: random.Random, low: int, high: int) -> str:
    return "".join(rng.choices("0123456789", k=rng.randint(low, high)))


def _letters(rng: random.Random, low: int, high: int) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(low, high)))


def _made_up(kind: str, rng: random.Random) -> str:
    """An item of a kind that passes its check."""
    if kind == "email":
        name = _letters(rng, 2, 9) + rng.choice(["", ".", "_", "-"]) + rng.choice([_letters(rng, 1, 6), _digits(rng, 1, 3)])
        return f"{name}@{_letters(rng, 3, 8)}{_digits(rng, 0, 1)}.{rng.choice(['', _letters(rng, 3, 8) + '.'])}{_letters(rng, 2, 3)}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = rng.choice("3456") + _digits(rng, 14, 14)
        digits = next(body + d for d in "0123456789" if luhn(body + d))
        mark = rng.choice(["", "", " ", "-"])
        return mark.join(digits[k:k + 4] for k in range(0, 16, 4))
    area, one, two = _digits(rng, 3, 3), _digits(rng, 3, 3), _digits(rng, 4, 4)
    return "+" + _digits(rng, 1, 2) + rng.choice([f" ({area}) {one}-{two}", f" {area} {one} {two}", f"{area}{one}{two}", f" {area}.{one}.{two}"])


def _unlike(rng: random.Random) -> str:
    """Digits that are none of the kinds."""
    return rng.choice([
        lambda: f"{_digits(rng, 1, 1)}.{_digits(rng, 1, 2)}", lambda: f"{_digits(rng, 1, 2)}.{_digits(rng, 1, 2)}.{_digits(rng, 1, 2)}",
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([18, 32, 40]))), lambda: f"20{_digits(rng, 2, 2)}-{_digits(rng, 2, 2)}-{_digits(rng, 2, 2)}",
        lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=20)), lambda: f"${_digits(rng, 1, 3)},{_digits(rng, 3, 3)}",
        lambda: f"{_letters(rng, 3, 8)}={_digits(rng, 2, 8)}", lambda: _digits(rng, 1, 7), lambda: f"{_digits(rng, 2, 2)}:{_digits(rng, 2, 2)}",
        lambda: f"@{_letters(rng, 3, 8)}", lambda: f"{_digits(rng, 1, 2)}. {_letters(rng, 2, 6)}", lambda: f"#{_digits(rng, 1, 4)}"])()


def composed_windows(sample: list[tuple[str, list[Span]]], count: int, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Windows of items, made up and of the sample, apart or side by side among the sample's words."""
    rng = random.Random(seed)
    words = [w for text, _ in sample for w in text.split() if not _TRIGGER.search(w)] or ["word", "and", "other"]
    held = {kind: [text[a:b] for text, spans in sample for k, a, b in spans if k == kind] for kind in KINDS}
    out = []
    for _ in range(count):
        text, spans = " ".join(rng.choices(words, k=rng.randint(0, 4))), []
        for _ in range(rng.choice([1, 2, 2, 3])):
            text += rng.choice([" ", " ", " ", " ", ", ", "; ", "\n", " / ", ": "]) if text else ""
            if rng.random() < 0.25:
                text += _unlike(rng)
            else:
                kind = rng.choice(KINDS)
                item = rng.choice(held[kind]) if held[kind] and rng.random() < 0.5 else _made_up(kind, rng)
                spans.append((kind, len(text), len(text) + len(item)))
                text += item
            if rng.random() < 0.4:
                text += rng.choice(["", "", ".", "!!", "###", ","]) + " " + " ".join(rng.choices(words, k=rng.randint(1, 3)))
        text += rng.choice(["", ".", "!!", "%%%", ","]) + rng.choice(["", " " + " ".join(rng.choices(words, k=rng.randint(0, 3)))])
        cut = WINDOW if len(text) > WINDOW else len(text)
        while any(a < cut < b for _, a, b in spans):
            cut -= 1
        out.append((text[:cut], [s for s in spans if s[2] <= cut]))
    return out


def _arrays(windows: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    windows = [w for w in windows if w[0]]
    x, y = (np.zeros((len(windows), WINDOW), dtype=np.int8) for _ in range(2))
    for row, (text, spans) in enumerate(windows):
        x[row, :len(text)], y[row, :len(text)] = char_tagger.classes(text), _tags(len(text), spans)
    return x, y.astype(np.int64)


def fit(docs: DataFrame, limit: int = MAX_WINDOWS, steps: int = STEPS) -> Tagger:
    """The tagger; `limit` bounds what is learned from, whatever the size of the corpus."""
    sample = labelled_windows(docs, limit)
    x, y = _arrays(sample + composed_windows(sample, max(1_000, len(sample))))
    return char_tagger.train(x, y, N_TAGS, HIDDEN, steps, BATCH, RATE, SEED)


# --- tagging --------------------------------------------------------------------------------------------------------


def _starts(length: int) -> list[int]:
    """Where the windows of a stretch begin; the last one ends with it."""
    if length <= WINDOW:
        return [0]
    return [*range(0, length - WINDOW, STRIDE), length - WINDOW]


def tagged_spans(texts: list[str], model: Tagger) -> list[list[Span]]:
    """The spans that the tagger alone finds in these stretches: windows decoded in blocks, reconciled over each stretch."""
    places = [(k, a) for k, text in enumerate(texts) for a in _starts(len(text))]
    codes = [char_tagger.classes(text) for text in texts]
    total = [np.zeros((len(text), N_TAGS)) for text in texts]
    places.sort(key=lambda p: min(len(texts[p[0]]), WINDOW))
    for block in range(0, len(places), BLOCK):
        mine = places[block:block + BLOCK]
        width = min(WINDOW, max(len(texts[k]) for k, _ in mine))
        x = np.zeros((len(mine), width), dtype=np.int8)
        for row, (k, a) in enumerate(mine):
            part = codes[k][a:a + WINDOW]
            x[row, :len(part)] = part
        likely = model.posteriors(x)
        for row, (k, a) in enumerate(mine):
            size = min(WINDOW, len(texts[k]) - a)
            weight = 1.0 + np.minimum(np.arange(size), np.arange(size)[::-1])
            total[k][a:a + size] += likely[row, :size] * weight[:, None]
    return [_reconciled(t / t.sum(axis=1, keepdims=True)) if len(t) else [] for t in total]


def _reconciled(likely: np.ndarray) -> list[Span]:
    """Spans of the best path over a stretch that are certain enough."""
    if likely[:, 0].min() > 0.5:
        return []
    path = char_tagger.best_path(np.log(likely + 1e-9), _ALLOWED, _MAY_START)
    out, at = [], 0
    while at < len(path):
        if path[at] == 0:
            at += 1
            continue
        end = at + 1
        while end < len(path) and path[end] == path[at] + 1:
            end += 1
        kind = (path[at] - 1) // 2
        if likely[at:end, 1 + 2 * kind:3 + 2 * kind].sum(axis=1).mean() >= LEAST_CERTAINTY:
            out.append((KINDS[kind], at, end))
        at = end
    return out


def _trimmed(text: str, span: Span) -> Span:
    kind, a, b = span
    while a < b and text[a].isspace():
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:!?-("):
        b -= 1
    return kind, a, b


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and base and found spans together, of every text."""
    areas = [(k, a, b) for k, text in enumerate(texts) for a, b in stretches(text)]
    found: list[list[Span]] = [[] for _ in texts]
    for (k, a, _), spans in zip(areas, tagged_spans([texts[k][a:b] for k, a, b in areas], model)):
        found[k] += [_trimmed(texts[k], (kind, a + s, a + e)) for kind, s, e in spans]
    out = []
    for text, more in zip(texts, found):
        base = base_spans(text)
        new = [s for s in more if CHECKS[s[0]](text[s[1]:s[2]]) and all(s[2] <= a or s[1] >= b for _, a, b in base)]
        out.append((base, in_order(base + new)))
    return out


def spans_column(model: Tagger):
    """A vectorised function: text (null where it has neither digit nor @) -> counts, digest and spans."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            whole = [t if isinstance(t, str) else "" for t in texts]
            out = []
            for base, every in all_spans(whole, model):
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(joined_spans(base).encode()).hexdigest(), joined_spans(every)))
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return scan


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = MAX_WINDOWS) -> DataFrame:
    """Per document: doc_id, numbers of base spans by kind, digest of the base spans, all spans (kind:start:end, joined by commas)."""
    rows = chosen(docs, doc_id=doc_id, text=text)
    scan = spans_column(fit(rows, limit))
    touched = F.when(F.col("text").rlike("[0-9@]"), F.col("text"))
    return rows.select("doc_id", scan(touched).alias("s")).select("doc_id", "s.*")


def span_frame(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = MAX_WINDOWS) -> DataFrame:
    """A row a span: doc_id, kind, start, end, item, base (whether a pattern finds it, too)."""
    rows = chosen(docs, doc_id=doc_id, text=text)
    model = fit(rows, limit)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = list(part["text"])
            out = [(i, k, a, b, t[a:b], (k, a, b) in base) for i, t, (base, every) in zip(part["id"], texts, all_spans(texts, model)) for k, a, b in every]
            yield pd.DataFrame(out, columns=["id", "kind", "start", "end", "item", "base"])

    found = rows.where(F.col("text").rlike("[0-9@]")).select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(
        spans, "id string, kind string, start long, end long, item string, base boolean")
    return found.select(F.col("id").cast(rows.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "end", "item", "base")
