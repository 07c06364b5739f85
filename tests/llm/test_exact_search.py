import math

import brute
import numpy as np

from tablescope.llm import exact_search as op


def test_ties_repeats_and_unusable_vectors(spark):
    rows = [(i, [float((i * 7) % 5) / 4, 0.5, -1.0]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0, None, 1.0]), (203, [math.nan, 1.0, 1.0]), (204, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(5, rows[5][1]), (250, [2.0]), (300, [1.0, 1.0, 1.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    usable = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    got = {}
    for r in op.top_k(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute.top_k(usable, 5, 50)
    assert op.top_k(frame.where("false")).count() == 0
    assert op.top_k(frame.where("vec_id = 50")).count() == 0


def test_blocks_equal_brute_force(monkeypatch, table, spark):
    want = sorted(map(tuple, op.top_k(table("embeddings")).collect()))
    monkeypatch.setattr(op, "BLOCK", 64)
    assert sorted(map(tuple, op.top_k(table("embeddings")).collect())) == want


def test_bounds_hold():
    random = np.random.default_rng(1)
    a, b = random.integers(-300, 300, (40, 33)).astype(float), random.integers(-300, 300, (50, 33)).astype(float)
    last = None
    for cuts in op.levels_of(np.geomspace(9, 1, 33)):
        (m, s), (n, t) = op.statistics(a, cuts), op.statistics(b, cuts)
        bound = m @ n.T + s @ t.T
        assert (bound >= a @ b.T - 1e-6).all()
        assert last is None or bound.mean() < last * 1.1
        last = bound.mean()
    assert np.allclose(last, (a @ b.T).mean())


def shares_of(vectors, k=5):
    """Share of all pairs left after each level, with the threshold of a first block of a quarter of the rows."""
    keys = np.arange(len(vectors))
    moments, axes = np.linalg.eigh((vectors.T @ vectors).astype(float))
    axes, levels = axes.T[::-1], op.levels_of(moments[::-1])
    queries = vectors[::50]
    scores = queries @ vectors[: len(vectors) // 4].T
    floors = np.sort(scores, axis=1)[:, -k - 1].astype(float)  # the query itself may be in the block
    shares = []
    found = op.best_of_block(keys[::50], queries, floors, keys, vectors, axes, levels, k, shares)
    assert len(found[0]) == k * len(queries)
    return shares


def test_levels_leave_few(table):
    """Vectors that share a few directions are dropped at coarse levels, the given ones at fine levels; few reach the exact score."""
    random = np.random.default_rng(2)
    given = np.array([[math.floor(256 * c) for c in r.embedding] for r in table("embeddings").collect()])
    spread = random.normal(size=(2000, 64)) * np.geomspace(1, 0.02, 64)
    mixed = np.floor(256 * spread @ np.linalg.qr(random.normal(size=(64, 64)))[0]).astype(np.int64)
    coarse = shares_of(mixed)
    assert coarse[-1] < 0.05 and coarse[-3] < 0.1  # 16 of 64 segments already tell
    fine = shares_of(given)
    assert fine[-1] < 0.1 and fine[-2] < 0.8 and fine == sorted(fine, reverse=True)


def test_sizes_and_clashing_columns(spark):
    rows = [(i, [1e300 if i % 2 else -1e300, float(i)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", *[f"'{c}' AS {c}" for c in ("key", "values", "rows", "floor", "block", "rank", "score", "query_id")])
    usable = {i: [max(-(1 << 26), min(1 << 26, math.floor(256 * x) if abs(x) < 1e30 else int(math.copysign(1 << 26, x)))) for x in v] for i, v in rows}
    got = {}
    for r in op.top_k(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute.top_k(usable, 5, 50)


def test_pairs_of_blocks_are_not_collected(monkeypatch, table):
    """Small compressed tables of blocks made a broadcast of all pairs, collected on the driver."""
    monkeypatch.setattr(op, "BLOCK", 64)
    plan = op.top_k(table("embeddings"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan


def test_thresholds_rise_to_the_best_scores_seen():
    best = np.full((3, 2), -np.inf)
    best = op.best_scores(best, np.array([0, 0, 2]), np.array([5, 3, 9]))
    assert best.tolist() == [[3, 5], [-np.inf, -np.inf], [-np.inf, 9]]
    assert op.best_scores(best, np.array([0, 1, 1, 2]), np.array([4, 1, 1, 9])).tolist() == [[4, 5], [1, 1], [9, 9]]
