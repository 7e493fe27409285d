"""Quality rules, with the frequency of lines across the documents of a host.

Every line of a text is normalised (lower case, white space to single spaces) and hashed. Per host
(column `source`) the documents that hold a line are counted, copies of a text under other ids too.
Lines above the limit are template lines and go. A document is depleted, and
rejected, when template lines held more than `max_lost` of its words. Base rules reject short texts
and texts that repeat themselves.

Whole texts are read once, in Arrow batches; counts and joins run on hashes in Spark, with sums before
every shuffle. The limit is a number of documents that grows with the logarithm of the host's size, so that a
hot host keeps no line that hundreds of its documents repeat.

Null and empty texts have no words and fail the base rules. A null host is a host of its own. Rows with
the same id and text are one document: each gets that document's result. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.llm.common import chosen, written

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")
_SPACE = re.compile("[\x20\x09-\x0d]")

#: Base rules: fewest words, and most words in repeated windows of three, in percent.
MIN_WORDS = 50
MAX_REPEATED = 50
#: A template line is in more documents of a host than the floor. Where the share is above the floor, the limit is
#: the floor and once more the floor for every tenfold of share over floor.
LINE_SHARE = 0.1
LINE_FLOOR = 20
#: A document may lose this share of its words to template lines.
MAX_LOST = 0.7

_PASS = ("doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
         "n_repeat_words bigint, content binary, lines array<struct<line:bigint,words:int>>")


def repeated_words(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words inside three-word windows that a document holds at least twice, per document.

    words: codes of all words of a batch in order; owner: the document of each; n: number of documents.
    """
    out = np.zeros(n, dtype=np.int64)
    if len(words) < 3:
        return out
    pair, _ = pd.factorize(words[:-1].astype(np.int64) << 32 | words[1:])
    window, kinds = pd.factorize(pair[:-1].astype(np.int64) << 32 | words[2:])
    inside = (owner[:-2] == owner[2:]).nonzero()[0]
    own, _ = pd.factorize(owner[inside].astype(np.int64) * (len(kinds) + 1) + window[inside])
    again = inside[np.bincount(own)[own] > 1] if len(own) else inside
    hit = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        hit[again + shift] = True
    np.add.at(out, owner[hit], 1)
    return out


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for start in range(0, len(whole), 1000):
            part = whole.iloc[start:start + 1000]
            texts = [t if isinstance(t, str) else "" for t in part["text"]]
            split = [t.encode().split() for t in texts]
            sizes = np.array([len(w) for w in split], dtype=np.int64)
            codes, _ = pd.factorize(np.array(list(itertools.chain.from_iterable(split)) + [None], dtype=object)[:-1])
            repeated = repeated_words(codes, np.repeat(np.arange(len(split)), sizes), len(split))
            rows = {"chars": [], "symbols": [], "dup": [], "content": [], "lines": []}
            for text in texts:
                rows["chars"].append(len(text) - len(_SPACE.findall(text)))
                rows["symbols"].append(len(_SYMBOL.findall(text)))
                seen: set[str] = set()
                lines: dict[int, int] = {}
                dup = 0
                for line in text.split("\n"):
                    words = line.encode().lower().split() if line.isascii() else line.lower().encode().split()
                    if not words:
                        continue
                    if line in seen:
                        dup += 1
                    seen.add(line)
                    key = int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)
                    lines[key] = lines.get(key, 0) + len(words)
                rows["dup"].append(dup)
                rows["content"].append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                rows["lines"].append([{"line": k, "words": n} for k, n in lines.items()])
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "host": part["host"].to_numpy(), "n_words": sizes,
                "word_chars": rows["chars"], "n_symbols": rows["symbols"], "n_dup_lines": rows["dup"],
                "n_repeat_words": repeated, "content": rows["content"], "lines": rows["lines"]})


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def template_lines(measured: DataFrame, line_share: float, line_floor: int) -> DataFrame:
    """(t_host, t_line): lines in more documents of a host than the limit allows."""
    # host and content in one key without nulls: both sides of the join come shuffled by it already
    keyed = measured.withColumn("text_key", F.concat("content", F.when(F.col("host").isNull(), F.lit(b"\0")).otherwise(
        F.concat(F.lit(b"\1"), F.col("host").cast("binary")))))
    documents = keyed.select("host", "text_key", "doc_id").distinct()
    hosts = documents.groupBy("host").agg(F.count("*").alias("n_docs")).withColumnRenamed("host", "h_host")
    copies = documents.groupBy("text_key").agg(F.count("*").alias("copies"))
    lines = (keyed.select("text_key", "host", "lines").dropDuplicates(["text_key"]).join(copies, "text_key")
             .select("host", "copies", F.explode("lines").alias("l")))
    counts = lines.groupBy("host", F.col("l.line").alias("line")).agg(F.sum("copies").alias("n")).where(F.col("n") > line_floor)
    over = F.log10(F.greatest(F.lit(1.0), line_share * F.col("n_docs") / max(line_floor, 1)))
    return (counts.join(hosts, _same("host", "h_host")).where(F.col("n") > line_floor * (1 + over))
            .select(F.col("host").alias("t_host"), F.col("line").alias("t_line")))


def score_documents(docs: DataFrame, line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR,
                    max_lost: float = MAX_LOST, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Per document: base counts, base_failed, kept, n_template_words."""
    rows = chosen(docs, doc_id=doc_id, host=host, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    measured = written(rows.mapInPandas(_measure, _PASS), "quality")
    templates = written(template_lines(measured, line_share, line_floor), "templates")
    lost = (
        measured.dropDuplicates(["host", "content"]).select("host", "content", F.explode("lines").alias("l"))
        .join(templates, _same("host", "t_host") & (F.col("l.line") == F.col("t_line")))
        .groupBy("host", "content").agg(F.sum("l.words").alias("lost_words"))
        .select(F.col("host").alias("l_host"), F.col("content").alias("l_content"), "lost_words")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    gone = F.coalesce(F.col("lost_words"), F.lit(0)).cast("bigint")
    return (
        measured.drop("lines").join(lost, _same("host", "l_host") & (F.col("content") == F.col("l_content")), "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                failed.alias("base_failed"), (~failed & (gone <= max_lost * F.col("n_words"))).alias("kept"),
                gone.alias("n_template_words"))
    )


def remove_template_lines(docs: DataFrame, line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR,
                          doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, text): every text without the template lines of its host."""
    rows = chosen(docs, doc_id=doc_id, host=host, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    measured = written(rows.mapInPandas(_measure, _PASS), "quality")
    templates = template_lines(measured, line_share, line_floor)
    bad = (
        measured.dropDuplicates(["host", "content"]).select("host", "content", F.explode("lines.line").alias("line"))
        .join(templates, _same("host", "t_host") & (F.col("line") == F.col("t_line")))
        .groupBy("host", "content").agg(F.collect_set("line").alias("bad"))
        .select(F.col("host").alias("b_host"), F.col("content").alias("b_content"), "bad")
    )

    def content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part["content"] = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in part["text"]]
            yield part

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for text, bad in zip(part["text"], part["bad"]):
                if text is not None and bad is not None:
                    gone = set(bad)
                    text = "\n".join(line for line in text.split("\n") if _line_key(line) not in gone)
                out.append(text)
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "text": out})

    keyed = rows.mapInPandas(content, "doc_id bigint, host string, text string, content binary")
    return (keyed.join(bad, _same("host", "b_host") & (F.col("content") == F.col("b_content")), "left")
            .select("doc_id", "text", "bad").mapInPandas(cut, "doc_id bigint, text string"))


def _line_key(line: str) -> int | None:
    words = line.lower().encode().split()
    if not words:
        return None
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)
