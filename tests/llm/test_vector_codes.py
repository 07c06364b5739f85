import hashlib
import math

import numpy as np
import pytest
from llm_fixtures import CLASHING

from tablescope.llm import vector_codes as op
from tablescope.llm.queries import QUERIES


def nearest(parts, codebooks):
    distance = ((parts[:, :, None, :] - codebooks[None]) ** 2).sum(axis=3)
    return distance.argmin(axis=2), distance.min(axis=2)


def brute(rows, parts, entries, rounds):
    """{key: (code, error, label error)} and the codebooks by comparing every part with every entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(256 * c) for c in r[2]]))
    width = -(-max(len(v) for _, _, v in rows) // parts) * parts
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (width - len(v)) for _, _, v in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        code, _ = nearest(x, books)
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    code, error = nearest(x, books)
    total = {}
    for (_, label, _), e in zip(rows, error.sum(axis=1)):
        total[label] = total.get(label, 0) + int(e)
    return sorted((repr(k), "".join(f"{v:02x}" for v in c), int(e), total[label]) for (k, label, _), c, e in zip(rows, code, error.sum(axis=1))), books


def got(frame):
    return sorted((repr(r.key), r.code, r.error, r.label_error) for r in frame.collect())


@pytest.mark.parametrize("seed", range(30))
def test_dual_tree_equals_brute_force(seed, monkeypatch):
    """Ties by few values, leaves and entries in every number, also fewer than a leaf holds."""
    random = np.random.default_rng(seed)
    monkeypatch.setattr(op, "LEAF", int(random.integers(1, 20)))
    rows, parts, entries, width, reach = int(random.integers(1, 600)), int(random.integers(1, 4)), int(random.integers(1, 70)), int(random.integers(1, 5)), [3, 30, 1 << 26][seed % 3]
    x = random.integers(-reach, reach + 1, (rows, parts, width))
    books = random.integers(-reach, reach + 1, (parts, entries, width))
    own = op.Assignment(x, books)
    code, _ = nearest(x, books)
    assert (own.codes(rows) == code).all()
    sums, counts = own.sums()
    for p in range(parts):
        for e in range(entries):
            assert counts[p, e] == (code[:, p] == e).sum() and (sums[p, e] == x[code[:, p] == e, p].sum(axis=0)).all()


def test_whole_nodes_are_assigned(table):
    """Clustered parts are mostly assigned by nodes; on the given vectors few entries of 64 are left in a leaf."""
    random = np.random.default_rng(1)
    centres = random.integers(-500, 500, (16, 4))
    x = centres[random.integers(0, 16, 5000)] + random.integers(-3, 4, (5000, 4))
    own = op.Assignment(x[:, None, :], centres[None])
    assert sum(own.tree.counts[level][nodes].sum() for level, nodes, _ in own.whole) > 0.9 * 5000
    pairs = []
    original = op.Assignment._leaves
    op.Assignment._leaves = lambda self, entries, node, entry: (pairs.append((len(node), len(np.unique(node)))), original(self, entries, node, entry))[1]
    try:
        vectors = np.floor(256 * np.array([r.embedding for r in table("embeddings").collect()])).astype(int).reshape(-1, 16, 4)
        for p in range(16):
            op.Assignment(vectors[:, p : p + 1], vectors[:64].transpose(1, 0, 2)[p : p + 1])
    finally:
        op.Assignment._leaves = original
    assert sum(n for n, _ in pairs) < 0.5 * 64 * sum(n for _, n in pairs)


def test_odd_rows(spark, monkeypatch):
    random = np.random.default_rng(4)
    rows = [(i, int(i % 3) if i % 4 else None, np.round(random.normal(size=10), 1).tolist()) for i in range(200)]
    rows += [(5, 7, [0.5] * 10), (None, None, [0.25] * 10), (201, 1, [1.0] * 3), (202, 1, [-2.0]), (203, 2, rows[3][2]), (203, 2, rows[3][2])]
    bad = [(300, 1, None), (301, 1, []), (302, 1, [None] * 10), (303, 1, [math.nan] * 10), (304, 1, [-math.inf] * 10)]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, label int, embedding array<double>").selectExpr("*", *[f"'{c}' AS {c}" for c in [*CLASHING, "x", "code", "error", "label_error", "of_label", "salt", "of_salt"]])
    expected, books = brute(rows, 4, 8, 2)
    codes, found = op.compress(frame, parts=4, entries=8)
    assert got(codes) == expected and (found == books).all()
    monkeypatch.setattr(op, "BLOCK", 7)
    monkeypatch.setattr(op, "MOST_LABELS", 0)
    codes, found = op.compress(frame, parts=4, entries=8)
    assert got(codes) == expected and (found == books).all()
    back = op.decode(codes, found).where("key IS NOT NULL").collect()
    assert all(len(r.decoded) == 12 for r in back)
    for r in back[:20]:
        assert r.decoded == [v / 256 for p in range(4) for v in books[p, int(r.code[2 * p : 2 * p + 2], 16)]]


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(2, None, [1.0, 2.0]), (1, None, [0.0, -1.0])], "vec_id bigint, label int, embedding array<double>")
    codes, books = op.compress(frame)
    assert [(r.key, r.code, r.error, r.label_error) for r in codes.orderBy("key").collect()] == [(1, "0000" + "00" * 14, 0, 0), (2, "0101" + "00" * 14, 0, 0)]
    assert books.shape == (16, 2, 1)
    empty, books = op.compress(frame.where("false"))
    assert empty.count() == 0 and books.size == 0 and empty.columns == codes.columns
    huge, _ = op.compress(spark.createDataFrame([(1, 1, [1e300]), (2, 1, [-1e300])], "vec_id bigint, label int, embedding array<double>"))
    assert huge.count() == 2


def test_query(spark, table):
    rows = [(r.vec_id, r.label, r.embedding) for r in table("embeddings").collect()]
    expected, books = brute(rows, 16, 64, 2)
    result = QUERIES["op13_vector_codes"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in result) == expected
    text = ",".join(str(v) for p in books for e in p for v in e)
    assert {r.codebooks_sha256 for r in result} == {hashlib.sha256(text.encode()).hexdigest()}
