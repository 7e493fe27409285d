"""Whitening of embeddings by an incremental eigendecomposition.

1. Entries become integers, floor(1024 c) + 100000. Every partition adds its vectors one after another to a spectrum
   (`spectra.Spectrum`): a centred rank-one term each, whose eigenvalues are roots of a secular equation, with
   deflation; so a task holds one d x d matrix however many vectors it reads.
2. Spectra are combined in groups of `FAN_IN`, round after round: the eigenpairs of one are rank-one terms for the other,
   and so is the distance of their means. One spectrum of d x d numbers reaches the driver.
3. Rayleigh-Ritz refinement: all vectors, centred by the exact mean, are projected on that basis; their covariance there,
   summed by partitions and combined alike, is decomposed once more. That removes what the updates have rounded away.
4. All vectors are projected on the leading components; the covariance of the result is summed in the same way and held
   against the identity.

Sums of entries are exact integers; the order of additions is that of the partitions, so reruns agree. Each round is
written to the shared folder. What grows on the driver or in a closure is d x d, never the number of vectors.

Vectors that are null or empty, hold a null or non-finite entry, or one beyond 2**40 in size (whose sums would not be exact)
are dropped, as are those of another length than the most frequent one (the smaller of equally frequent ones). Null and
repeated ids are rows like others; every repeated row counts. Components whose eigenvalue is no more than `LEAST_SHARE` of
the trace cannot be scaled to unit variance and are not returned: equal vectors, or a single one, give an empty result, as
does an empty table. A deviation that does not fit a long is null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegauge.llm.common import chosen, written
from treegauge.llm.spectra import Spectrum

SCALE, ORIGIN = 1024, 100_000
COMPONENTS = 8
FAN_IN = 16
LEAST_SHARE = 1e-12
LARGEST = float(2 ** 40)

_SPECTRUM = "part long, n long, sums array<bigint>, mean array<double>, spectrum array<double>, vectors array<double>"
_SUMS = "part long, sums array<double>"
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that take part, as integers."""
    chosen_rows = chosen(rows, vec_id=vec_id, embedding=embedding)
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST))  # not for NaN: it is above all
    kept = chosen_rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(fine, F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + ORIGIN)
    whole = written(kept.select("vec_id", x.alias("x")), "vectors")
    size = whole.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return whole.where(F.size("x") == (size["size"] if size is not None else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows of integers."""
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.int64)


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, sums = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch)
        if state is None:
            state, sums = Spectrum.empty(x.shape[1]), np.zeros(x.shape[1], dtype=np.int64)
        sums += x.sum(axis=0)
        for vector in (x - ORIGIN).astype(float):
            state.add(vector)
    if state is not None:
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([state.n], pa.int64()),
            "sums": pa.array([sums], pa.list_(pa.int64())), "mean": pa.array([state.mean], pa.list_(pa.float64())),
            "spectrum": pa.array([state.values], pa.list_(pa.float64())), "vectors": pa.array([state.vectors.ravel()], pa.list_(pa.float64()))})


def _combined(rows: DataFrame, schema: str, merge: Callable[[pd.DataFrame], pd.DataFrame]):
    """One row from a row a partition: groups of `FAN_IN` neighbours are merged in order, round after round."""
    rows = written(rows, "parts")
    last = rows.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def in_order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", ignore_index=True)
        return merge(group).assign(part=group["part"].iloc[0] // FAN_IN)

    while last:
        rows = written(rows.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(in_order, schema), "parts")
        last //= FAN_IN
    return rows.first()


def _merge_spectra(group: pd.DataFrame) -> pd.DataFrame:
    states = [Spectrum(int(r.n), np.array(r.mean), np.array(r.spectrum), np.array(r.vectors).reshape(len(r.mean), -1))
              for r in group.itertuples()]
    for other in states[1:]:
        states[0].merge(other)
    one, sums = states[0], np.sum(np.stack(group["sums"].to_list()), axis=0)
    return pd.DataFrame({"n": [one.n], "sums": [sums], "mean": [one.mean], "spectrum": [one.values], "vectors": [one.vectors.ravel()]})


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"sums": [np.sum(np.stack(group["sums"].to_list()), axis=0)]})


def _sum_over(rows: DataFrame, term: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of what `term` gives for a block of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = term(_matrix(batch)).ravel()
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              "sums": pa.array([total], pa.list_(pa.float64()))})

    return np.array(_combined(rows.mapInArrow(partial, _SUMS), _SUMS, _add_up)["sums"])


@dataclass(frozen=True)
class Whitening:
    """n vectors with these sums of entries; directions (columns), their variances and the trace; how far from the identity."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def project(self, x: np.ndarray) -> np.ndarray:
        """Integer vectors, centred and whitened."""
        return ((self.n * x - self.sums) / self.n) @ self.directions / np.sqrt(self.variances)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of `integer_vectors`; None where no direction has any variance."""
    draft = _combined(vectors.mapInArrow(_spectra, _SPECTRUM), _SPECTRUM, _merge_spectra)
    if draft is None:
        return None
    n, sums = draft["n"], np.array(draft["sums"], dtype=np.int64)
    basis = np.linalg.qr(np.array(draft["vectors"]).reshape(len(sums), -1))[0]
    ritz = _sum_over(vectors, lambda x: _second_moment(((n * x - sums) / n) @ basis)).reshape(len(sums), -1) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_SHARE * np.trace(ritz)]
    if not len(order):
        return None
    model = Whitening(n, sums, basis @ turn[:, order], values[order], float(np.trace(ritz)))
    k = len(order)
    moments = _sum_over(vectors, lambda x: _with_sums(model.project(x))) / n
    covariance = moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k])
    return Whitening(n, sums, model.directions, model.variances, model.trace, float(np.abs(covariance - np.eye(k)).max()))


def _second_moment(y: np.ndarray) -> np.ndarray:
    return y.T @ y


def _with_sums(w: np.ndarray) -> np.ndarray:
    return np.concatenate([w.sum(axis=0), _second_moment(w).ravel()])


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = integer_vectors(rows, vec_id, embedding)
    model = fit(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], _RESULT)
    k = len(model.variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch)
            scaled = model.n * x - model.sums
            fits = np.square(scaled.astype(float)).sum(axis=1) < 9.2e18
            deviation = np.square(np.where(fits[:, None], scaled, 0)).sum(axis=1)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, model.n, dtype=np.int64)),
                "deviation": pa.array(deviation[each], mask=~fits[each]),
                "whitened": pa.array(model.project(x).ravel()),
                "explained": pa.array(np.tile(model.variances / model.trace, m)),
                "identity_error": pa.array(np.full(m * k, model.identity_error))})

    return vectors.mapInArrow(project, _RESULT)
