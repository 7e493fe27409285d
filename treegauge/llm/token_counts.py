"""Token counts per field or section by offset mapping.

The fields of a row are joined with a line feed and the whole is encoded once with a byte-level BPE.
Tokens of such a BPE tile the text's bytes, so their spans are running sums of token lengths. Sections
are spans too: every field, and inside a field every line. Both span lists are sorted and do not overlap, so the
interval join is two binary searches a row, and nothing is shuffled. A token that lies in one section
counts there. A token that crosses a boundary goes, by the rule given,
  "majority": to the section that holds most of its bytes, the earlier one in a tie;
  "start": to the section of its first byte.
The line feed that ends a section belongs to it.

Null fields are empty. An empty field is one empty section without tokens. Repeated rows give repeated
results; extra columns are not read; an empty table gives an empty result. Special-token strings in a
text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("majority", "start")
_OUT = "doc_id long, field string, section int, n_chars long, n_tokens long, n_crossing long"


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    """The encoding of a rank file, and the byte length of every token."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a boundary; ends are excluded offsets."""
    if not len(token_ends):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = first != last
    section = first.copy()
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            inner = np.arange(first[t], last[t] + 1)
            begins = np.maximum(np.concatenate([[0], section_ends])[inner], starts[t])
            section[t] = inner[np.argmax(np.minimum(section_ends[inner], token_ends[t]) - begins)]
    return section, crossing


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, fields: tuple[str, ...] = ("text",), rule: str = "majority",
                 doc_id: str = "doc_id") -> DataFrame:
    """Per document and section: doc_id, field, section (a line of the field), n_chars, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, lengths = _encoder(ranks_path, pattern)
        for part in batches:
            for begin in range(0, len(part), 500):
                block = part.iloc[begin:begin + 500]
                ids, names, numbers, chars, counts, crossings = [], [], [], [], [], []
                for key, *values in block.itertuples(index=False):
                    lines = [[line for line in (v if isinstance(v, str) else "").split("\n")] for v in values]
                    flat = [line for part_lines in lines for line in part_lines]
                    whole = "\n".join(flat)
                    tokens = np.array(encoder.encode_ordinary(whole), dtype=np.int64)
                    ends = np.cumsum([len(line.encode()) + 1 for line in flat])
                    ends[-1] -= 1
                    section, crossing = allocate(np.cumsum(lengths[tokens]), ends, rule)
                    counts.append(np.bincount(section, minlength=len(flat)))
                    crossings.append(np.bincount(section[crossing], minlength=len(flat)))
                    ids += [key] * len(flat)
                    names += [f for f, part_lines in zip(fields, lines) for _ in part_lines]
                    numbers += [i for part_lines in lines for i in range(len(part_lines))]
                    chars += map(len, flat)
                if ids:
                    yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "field": names, "section": np.array(numbers, dtype="int32"),
                                        "n_chars": chars, "n_tokens": np.concatenate(counts), "n_crossing": np.concatenate(crossings)})

    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                         *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return picked.mapInPandas(rows, _OUT)
