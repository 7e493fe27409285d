"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled rows (`max_labelled`, one text an id):
1. Units of evidence are whole tokens and their beginnings of `LEAST_STEM` letters and more, so that the forms of one
   stem add up, in any language. For every unit the distinct lines that hold it are counted, in toxic and in other
   texts; for the units that this leaves, distinct neighbours of its tokens are counted (neither copies nor
   repetition count as evidence, and near copies repeat a token between the same words). Units get log-odds with an
   informative Dirichlet prior: the prior of a unit is its share of all tokens times `PRIOR`. A unit's score is the
   lower end of its confidence interval where that is above `LEAST_SCORE`. Each token is then given to one of its
   units, the longest of those within `LEVEL` of the best, and units are counted again over their own tokens only:
   a short beginning does not live on the evidence of a longer one. A token's score is its best unit's, less a drift,
   so that a random text has a negative mean.
2. On the other part of the sample, segments of texts without the label give the constants of the
   extreme-value law E = K n exp(-lambda S): the expected number of segments of score S or more in n tokens.
3. A logistic curve, fitted on that part too, maps the evidence of a text to a probability.

Score, over all texts: a linear scan finds every maximal segment; only tokens with a positive score
open one, so the scan touches those and the running sums between. Segments with E below `SIGNIFICANT`
are toxic passages. The evidence of a text is that of its r best segments together, for the r that says most: the sum
of their normalised scores lambda S - ln K n follows exp(-t) t^(r-1) / (r! (r-1)!), and trying r costs r - 1 bits.
The model is of bounded size (a score a labelled row at most), so scoring is one narrow stage over whole texts.

Null and empty texts have no tokens and get the score of a text without evidence. A null id counts as
the empty string for the split. Null labels are not used; of several labels for an id the largest
counts, of several texts the one with the smallest hash. Without labelled rows of both kinds every text gets the share
of toxic rows (0.5 without rows). Very long texts are scanned whole in linear time.
Repeated rows give repeated results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.llm.common import chosen, written

#: Bound on the labelled rows that a model is fitted on, and on its scores.
MAX_LABELLED = 20_000
PRIOR = 5_000.0
DRIFT = 0.03
CONFIDENCE = 2.5
#: A unit counts when it at least doubles the odds.
LEAST_SCORE = math.log(2)
LEAST_STEM = 3
LEVEL = 0.5
#: Rounds of giving tokens to units and counting these again.
ROUNDS = 3
#: The rate of the extreme-value law starts as if so many segments had exceeded the least score by 1 on average.
PRIOR_SEGMENTS = 20
SIGNIFICANT = 0.01
THRESHOLD = 0.7
#: Evidence is kept between these bounds before the logistic curve.
EVIDENCE = (-5.0, 15.0)
#: Texts are scored as if they had so many tokens at least.
LEAST_TOKENS = 50
#: Distinct tokens whose scores a task remembers.
REMEMBERED = 200_000

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _TOKEN.findall(text.lower())


def units(token: str) -> list[str]:
    """The whole token, marked by a final $, and its beginnings, the longest first."""
    return [f"{token}$", *(token[:k] for k in range(len(token), LEAST_STEM - 1, -1))]


@dataclass(frozen=True)
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0
    space: float = 1e-6
    intercept: float = 0.0
    slope: float = 0.0

    def scorer(self):
        """A function from a token to its score, with a memory of bounded size."""
        known: dict[str, float] = {}
        starts = {u[:LEAST_STEM] for u in self.scores}

        def score(token: str) -> float:
            if token[:LEAST_STEM] not in starts and f"{token}$" not in self.scores:
                return 0.0
            found = known.get(token)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[token] = max((self.scores.get(u, 0.0) for u in units(token)), default=0.0)
            return found

        return score

    def segments(self, words: list[str], score=None) -> list[tuple[int, int, float]]:
        """All maximal segments (start, end, score) of a token list, in order."""
        values = np.array([*map(score or self.scorer(), words)])
        return maximal_segments(values - self.drift) if values.any() else []

    def evidence(self, score: float, n: int) -> float:
        """-ln E of a segment among n tokens."""
        return self.rate * score - math.log(self.space * max(n, LEAST_TOKENS))

    def passages(self, words: list[str], score=None) -> list[tuple[int, int, float]]:
        """Significant segments as (start, end, evidence)."""
        least = -math.log(SIGNIFICANT)
        scored = [(a, b, self.evidence(s, len(words))) for a, b, s in self.segments(words, score)]
        return [x for x in scored if x[2] >= least]

    def text_evidence(self, scores: list[float], n: int) -> float:
        """Evidence, within bounds, of a text of n tokens with segments of these scores."""
        low, high = EVIDENCE
        return min(max(joint_evidence([self.evidence(s, n) for s in scores]), low), high)

    def total_evidence(self, words: list[str], score=None) -> tuple[float, int]:
        """Evidence of a text within bounds, and its number of passages."""
        found = [s for _, _, s in self.segments(words, score)]
        least = -math.log(SIGNIFICANT)
        return self.text_evidence(found, len(words)), sum(self.evidence(s, len(words)) >= least for s in found)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.intercept + self.slope * evidence)))


def joint_evidence(normalised: list[float]) -> float:
    """-ln of the chance that the r best of these normalised scores sum to as much, for the r that says most."""
    best, total = -math.inf, 0.0
    for r, value in enumerate(sorted(normalised, reverse=True), 1):
        total += value
        if r > 1 and (value <= 0 or total <= r):
            break
        chance = total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r)
        best = max(best, chance - (r - 1) * math.log(2))
    return best


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence: linear in its length, as each candidate is merged once."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    held: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and after, last one that begins lower
    for i in np.flatnonzero(values > 0).tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((start, end, left, right, j))
                break
            start, left, before = held[j][0], held[j][2], held[j][4]
            del held[j:]
            j = before
    return [(a, b, r - x) for a, b, x, r, _ in held]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, toxic, part) of at most `limit` labelled rows that may be learned from; the part is 0, 1 or 2.

    The ids are bounded by `limit`, so they are broadcast and texts of other rows are not moved; one text an id stays.
    """
    order = F.md5(F.concat(F.lit("fit:"), F.col("l_id").cast("string")))
    ids = (
        labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").alias("toxic"))
        .where(F.col("l_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("l_id")))
        .groupBy("l_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("order", order).orderBy("order", "l_id").limit(limit)
        .withColumn("part", (F.conv(F.substring("order", 1, 4), 16, 10).cast("int") % 3))
    )
    found = docs.join(F.broadcast(ids), docs["doc_id"] == ids["l_id"]).groupBy("l_id")
    return found.agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"),
                     F.first("part").alias("part")).drop("l_id")


def _count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for line, toxic in zip(part["line"], part["toxic"]):
            counts[toxic].update(set(tokens(line)))
        words = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"token": words, "clean": [counts[0][w] for w in words], "toxic": [counts[1][w] for w in words]})


def _by_unit(counts: DataFrame) -> DataFrame:
    """(token, unit, clean, toxic): a row for each unit of each token."""
    token = F.col("token")
    stems = F.when(F.length(token) >= LEAST_STEM, F.transform(
        F.sequence(F.lit(LEAST_STEM), F.length(token)), lambda k: F.substring(token, F.lit(1), k)))
    whole = F.array(F.concat(token, F.lit("$")))
    return counts.select("token", F.explode(F.concat(F.coalesce(stems, F.array().cast("array<string>")), whole)).alias("unit"),
                         "clean", "toxic")


def unit_scores(sample: DataFrame, most: int) -> dict[str, float]:
    """Scores of the units whose log-odds are above 0, the `most` clearest at most."""
    lines = (
        sample.where("part < 2 and text is not null")
        .select((F.col("toxic") > 0).cast("int").alias("toxic"), F.explode(F.split("text", "\n")).alias("line")).distinct()
    )
    counts = written(
        lines.mapInPandas(_count_tokens, "token string, clean long, toxic long")
        .groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "tokens")
    n_clean, n_toxic = (float(x or 0) for x in counts.agg(F.sum("clean"), F.sum("toxic")).first())
    if not n_clean or not n_toxic:
        return {}
    first = written(_clearest(_by_unit(counts), n_clean, n_toxic, most).select("unit"), "likely")
    likely = {r["unit"] for r in first.collect()}

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for line, toxic in zip(part["line"], part["toxic"]):
                words = ["", *tokens(line), ""]
                out += [(w, toxic, f"{words[i]} {words[i + 2]}") for i, w in enumerate(words[1:-1]) if not likely.isdisjoint(units(w))]
            yield pd.DataFrame(out, columns=["token", "toxic", "context"])

    met = written(
        lines.mapInPandas(contexts, "token string, toxic int, context string").distinct()
        .groupBy("token").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")), "met")
    pairs = own = _by_unit(met).join(F.broadcast(first), "unit")  # all tokens of these units were met
    for _ in range(ROUNDS - 1):
        scored = pairs.join(F.broadcast(_clearest(own, n_clean, n_toxic, most)), "unit")
        best = scored.groupBy("token").agg(F.max("score").alias("best"))
        near = scored.join(best, "token").where(F.col("score") >= F.col("best") - LEVEL)
        own = written(near.groupBy("token", "clean", "toxic").agg(F.max_by("unit", F.length("unit")).alias("unit")), "units")
    return {r["unit"]: r["score"] for r in _clearest(own, n_clean, n_toxic, most).collect()}


def _clearest(pairs: DataFrame, n_clean: float, n_toxic: float, most: int) -> DataFrame:
    """Units whose log-odds are above 0 with confidence, and the lower ends of their intervals: `most` rows at most."""
    counts = pairs.groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic > 0")
    prior = PRIOR * (F.col("clean") + F.col("toxic")) / (n_clean + n_toxic)
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    rest_toxic, rest_clean = (F.greatest(n + PRIOR - x, F.lit(1.0)) for n, x in ((F.lit(n_toxic), a), (F.lit(n_clean), b)))
    odds = F.log(a / rest_toxic) - F.log(b / rest_clean)
    margin = CONFIDENCE * F.sqrt(1 / a + 1 / b)
    return (
        counts.select("unit", (odds - margin).alias("score"))
        .where(F.col("score") > LEAST_SCORE).orderBy(F.col("score").desc(), "unit").limit(most)
    )


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope with normal priors around (-2, 0.5), by Newton steps; the slope stays positive."""
    mean, weight = np.array([-2.0, 0.5]), np.diag([1 / 4.0, 1 / 0.0625])
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.array([-2.0, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + weight,
                               design.T @ (y - p) - weight @ (beta - mean))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.05))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """The model; docs has doc_id and text, labels has doc_id and toxic. What reaches the driver is bounded by `max_labelled`."""
    sample = written(labelled_sample(docs, labels, max_labelled), "labelled")
    share = sample.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    scores = unit_scores(sample, max_labelled)
    if not scores:
        p = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return ToxicityModel(intercept=math.log(p / (1 - p)))
    draft = ToxicityModel(scores=scores)

    def segment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = draft.scorer()
        for part in batches:
            words = [tokens(t) if t is not None else [] for t in part["text"]]
            yield pd.DataFrame({"toxic": (part["toxic"] > 0).astype("int32").to_numpy(), "n": [len(w) for w in words],
                                "segments": [[s for _, _, s in draft.segments(w, score)] for w in words]})

    rows = written(sample.where("part = 2").mapInPandas(segment_rows, "toxic int, n long, segments array<double>"), "segments")
    least = min(scores.values()) - DRIFT
    above = F.aggregate("segments", F.lit(0.0), lambda total, s: total + s - least)
    clean = rows.where("toxic = 0").agg(F.sum(F.size("segments")), F.sum(above), F.sum("n")).first()
    n_segments, excess, n_tokens = (float(x or 0) for x in clean)
    rate = (n_segments + PRIOR_SEGMENTS) / (excess + PRIOR_SEGMENTS)
    space = (n_segments + 0.5) * math.exp(rate * least) / max(1.0, n_tokens)
    model = ToxicityModel(scores=scores, rate=rate, space=space)

    def evidence_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"toxic": part["toxic"], "x": [model.text_evidence(list(s), n) for s, n in zip(part["segments"], part["n"])]})

    points = rows.mapInPandas(evidence_rows, "toxic int, x double").toPandas()
    intercept, slope = _logistic(points["x"].to_numpy(dtype=float), points["toxic"].to_numpy(dtype=float))
    return ToxicityModel(scores=scores, rate=rate, space=space, intercept=intercept, slope=slope)


def probability_column(model: ToxicityModel):
    """A vectorised function: text -> (score, passages)."""

    @F.pandas_udf("score double, passages int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for texts in batches:
            out = [model.total_evidence(tokens(t), score) if isinstance(t, str) else (EVIDENCE[0], 0) for t in texts]
            yield pd.DataFrame({"score": [model.probability(e) for e, _ in out], "passages": np.array([n for _, n in out], dtype="int32")})

    return scored


def passage_frame(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Toxic passages: doc_id, first and last token (end excluded), evidence, the passage's tokens."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for part in batches:
            out = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                words = tokens(text) if isinstance(text, str) else []
                out += [(doc_id, a, b, e, " ".join(words[a:b])) for a, b, e in model.passages(words, score)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "evidence", "passage"])

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, start long, end long, evidence double, passage string")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_passages."""
    rows = chosen(docs, doc_id=doc_id, text=text)
    scored = probability_column(fit(rows, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("s")).select(
        "doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= threshold).cast("int").alias("predicted"),
        F.col("s.passages").alias("n_passages"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted toxic."""
    scored = probability_column(fit(chosen(docs, doc_id=doc_id, text=text), labels))
    return docs.where(scored(F.col(f"`{text}`"))["score"] < threshold)
