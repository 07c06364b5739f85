import math

import numpy as np
import pytest
from llm_fixtures import CLASHING

from tablescope.llm import whitening as op
from tablescope.llm.queries import QUERIES


def spectrum(number, random):
    """Covariances of full and low rank, with repeated eigenvalues, zeros, and tiny gaps."""
    size = int(random.integers(1, 40))
    sample = random.normal(size=(size, int(random.integers(1, 60))))
    basis = np.linalg.qr(random.normal(size=(size, size)))[0]
    return [
        sample @ sample.T,
        sample @ sample.T + 1e3 * np.eye(size),
        basis @ np.diag(np.repeat([5.0, 2.0, 1.0], [size // 3, size // 3, size - 2 * (size // 3)])) @ basis.T,
        np.diag(random.integers(0, 4, size)).astype(float),
        np.full((size, size), 3.0),
        basis @ np.diag(1 + 1e-9 * np.arange(size)) @ basis.T,
        np.zeros((size, size)),
    ][number % 7]


@pytest.mark.parametrize("number", range(42))
def test_components(number):
    matrix = spectrum(number, np.random.default_rng(number))
    values, vectors = op.components_of(matrix, 8)
    expected = np.linalg.eigvalsh(matrix)[::-1][:8]
    scale = max(np.abs(matrix).max(), 1.0)
    assert np.abs(values - expected).max() <= 1e-12 * scale
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-12 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() <= 1e-12


def test_polar_sign():
    random = np.random.default_rng(5)
    basis = np.linalg.qr(random.normal(size=(12, 12)))[0]
    values = np.array([1e-12, -1e-12, *random.normal(size=10)])
    sign = op.polar_sign(basis @ np.diag(values) @ basis.T)
    assert np.abs(sign - basis @ np.diag(np.sign(values)) @ basis.T).max() < 1e-3
    assert np.abs(sign @ sign - np.eye(12)).max() < 1e-12


def check(rows, vectors):
    """Against numpy: exact counts and deviations, whitened values up to the sign of a component."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(x.astype(float).T, bias=True))
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    expected = (x.astype(float) - x.astype(float).mean(axis=0)) @ basis / np.sqrt(values)
    deviations = [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    place = {k: i for i, (k, _) in enumerate(vectors)}
    got = np.zeros((n, len(values)))
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviations[place[r.vec_id]] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(np.cov(x.astype(float).T, bias=True)), rel=1e-9)
    assert len(rows) == got.size
    assert np.abs(got * np.sign((got * expected).sum(axis=0)) - expected).max() < 1e-8


def test_query(spark, table):
    vectors = sorted((r.vec_id, r.embedding) for r in table("embeddings").collect())
    check(QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001").collect(), vectors)


def test_unusable_and_repeated_rows(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.normal(size=5).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5), (104, [math.inf] * 5)]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").selectExpr("*", *[f"'{c}' AS {c}" for c in [*CLASHING, "x", "i", "white", "deviation"]], "1 AS label")
    check(op.whiten(frame).collect(), rows)
    again = op.whiten(frame.where("vec_id < 3").unionByName(frame.where("vec_id = 1"))).collect()
    assert {r.n for r in again} == {4} and len(again) == 8 and len({round(r.whitened, 9) for r in again if r.vec_id == 1}) == 2
    keyless = op.whiten(frame.withColumn("vec_id", op.F.lit(None).cast("bigint"))).collect()
    assert len(keyless) == 200 and {r.vec_id for r in keyless} == {None}


def test_degenerate(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert op.whiten(frame).count() == op.whiten(frame.limit(1)).count() == op.whiten(frame.where("false")).count() == 0
    assert op.whiten(frame.where("false")).columns == op.whiten(frame.unionByName(frame.selectExpr("3L AS vec_id", "array(0.5D) AS embedding"))).columns
    huge = op.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id bigint, embedding array<double>")).collect()
    assert {r.deviation for r in huge} == {None, (3 * 100_000 - 3 * 100_000) ** 2} and all(abs(r.whitened) < 2 for r in huge)
    # short vectors are filled with zeros
    rows = [(1, [1.0, 0.0]), (2, [0.5]), (3, [0.0, 0.25])]
    check(op.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect(), [(k, (v + [0.0])[:2]) for k, v in rows])
