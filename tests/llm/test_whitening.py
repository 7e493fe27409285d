"""Incremental spectra and whitening against dense decompositions."""

import numpy as np
import pytest

from treegauge.llm import whitening
from treegauge.llm.spectra import Spectrum, secular_roots

ROWS = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 0) for i, v in vectors], ROWS).repartition(parts)


def check_against_dense(got, vectors, components=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in vectors], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, dense = np.linalg.eigh(centred.T @ centred / n)
    values, dense = values[::-1][:components], dense[:, ::-1][:, :components]
    by_row = {(r.vec_id, r.component): r for r in got}
    assert len(by_row) == len(got) == n * min(components, x.shape[1])
    for c in range(min(components, x.shape[1])):
        w = np.array([by_row[i, c + 1].whitened for i, _ in vectors])
        expected = centred @ dense[:, c] / np.sqrt(values[c])
        sign = np.sign(w @ expected)
        assert np.abs(w - sign * expected).max() < 1e-8
        assert by_row[vectors[0][0], c + 1].explained == pytest.approx(values[c] / np.trace(centred.T @ centred / n), rel=1e-9)
    for i, (vec_id, _) in enumerate(vectors):
        row = by_row[vec_id, 1]
        assert row.deviation == sum(int(y) ** 2 for y in n * x[i] - sums) and row.n == n
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_secular_roots_against_dense():
    rng = np.random.default_rng(3)
    for k in (1, 2, 5, 30):
        for scale in (1e-9, 1.0, 1e9):
            poles, z = np.sort(rng.uniform(0, 1, k)), rng.normal(size=k) * np.sqrt(scale)
            roots, away = secular_roots(poles, z)
            expected = np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z))
            assert np.abs(roots - expected).max() <= 1e-13 * max(1, abs(expected).max())
            assert np.allclose(away, roots[None, :] - poles[:, None], atol=1e-12 * max(1, scale))


@pytest.mark.parametrize("kind", ["plain", "copies", "flat"])
def test_spectrum_follows_rank_one_terms(kind):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(150, 12)) * np.linspace(1, 200, 12)) + 1e5
    if kind == "copies":
        x[30:120] = x[30]
    if kind == "flat":
        x[:, 5:] = x[0, 5:]  # rank below the dimension: equal eigenvalues throughout
    one, two = Spectrum.empty(12), Spectrum.empty(12)
    for v in x[:70]:
        one.add(v)
    for v in x[70:]:
        two.add(v)
    one.merge(two)
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    top = np.linalg.eigvalsh(scatter)[-1]
    assert np.abs(one.values - np.linalg.eigvalsh(scatter)).max() < 1e-12 * top
    assert np.abs(one.vectors.T @ one.vectors - np.eye(12)).max() < 1e-12
    assert np.abs(scatter @ one.vectors - one.vectors * one.values).max() < 1e-11 * top
    assert one.n == 150 and np.abs(one.mean - x.mean(0)).max() < 1e-8


def test_whitening_against_dense(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(16, 16))
    vectors = [(i, [float(c) for c in rng.normal(size=16) @ mixed * 0.3]) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(150)]  # a third are copies
    check_against_dense(whitening.whiten(frame(spark, vectors, 5)).collect(), vectors)


def test_more_partitions_than_one_round_merges(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(c) for c in rng.normal(size=4) * (1, 2, 3, 4)]) for i in range(400)]
    check_against_dense(whitening.whiten(frame(spark, vectors, 40)).collect(), vectors)


def test_rows_that_do_not_take_part(spark):
    rng = np.random.default_rng(7)
    good = [(i, [float(c) for c in rng.normal(size=3) * (1, 2, 3)]) for i in range(20)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 1.0]),
           (105, [1.0, 2.0]), (106, [3e30, 0.0, 0.0])]
    docs = frame(spark, good + bad).withColumnRenamed("label", "x")
    check_against_dense(whitening.whiten(docs).collect(), good, 3)
    nulls = frame(spark, [(None, v) for _, v in good])
    assert {r.vec_id for r in whitening.whiten(nulls).collect()} == {None}


def test_no_direction_no_rows(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)], [(1, None)]):
        assert whitening.whiten(frame(spark, vectors)).count() == 0


def test_large_deviations_are_null(spark):
    rows = [(k, [1e9 * (-1) ** k, 0.0]) for k in range(6)]
    assert all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-9 for r in whitening.whiten(frame(spark, rows)).collect())
