import brute
import numpy as np
import pyarrow as pa
import random
from llm_fixtures import documents, none, odd  # noqa: F401

from tablescope.llm import ngram_jaccard as op


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in frame.collect()}


def test_equals_all_pairs(table, documents):
    assert result(op.jaccard_join(table("documents"))) == brute.jaccard_groups(documents, 4, 85)
    assert result(op.jaccard_join(table("documents"), shingle=5, percent=80)) == brute.jaccard_groups(documents, 5, 80)


def test_near_copies_around_the_threshold(spark):
    random.seed(7)
    base, docs = [f"w{random.randrange(500)}" for _ in range(300)], []
    for i in range(120):
        own = list(base[: random.randrange(20, 300)])
        for _ in range(random.randrange(6)):
            own[random.randrange(len(own))] = f"x{i}"
        docs.append((i, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(op.jaccard_join(frame)) == brute.jaccard_groups(docs, 4, 85)


def test_large_families_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP_DOCUMENTS", 7)
    random.seed(3)
    base, docs = [f"w{i}" for i in range(80)], []
    for i in range(60):
        own = list(base)
        own[random.randrange(80)] = own[random.randrange(80)] = f"x{i}"
        docs.append((i, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(op.jaccard_join(frame)) == brute.jaccard_groups(docs, 4, 85)


def test_bounds_hold():
    for low, high, differ, blocks in op.bands(3000, 85):
        for a in {low, high}:
            for b in range(a, a * 100 // 85 + 1):
                meet = -(-85 * (a + b) // 185)
                assert a + b - 2 * meet <= differ < blocks


def test_odd_rows(odd, none):
    rows = op.jaccard_join(odd).collect()
    assert len(rows) == odd.count()
    by_key = {r.doc_id: r for r in rows}
    assert (by_key[1].component_id, by_key[2].component_id, by_key[2].n_links) == (1, 1, 1)
    assert [by_key[k].n_shingles for k in (3, 4, 5, 6)] == [0, 0, 0, 1]
    assert [(by_key[k].component_id, by_key[k].n_links) for k in (3, 4, 5)] == [(3, 0), (4, 0), (5, 0)]
    assert op.jaccard_join(none).count() == 0


def test_one_of_each_group(odd, none):
    kept = op.one_of_each_group(odd)
    assert kept.columns == odd.columns
    keys = sorted(str(r.doc_id) for r in kept.collect())
    assert keys == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "11", "None", "12"])
    assert op.one_of_each_group(none).count() == 0


def test_hot_key_falls_back_to_a_chain(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(op, "KEY_DOCUMENTS", 3)
    batch = pa.RecordBatch.from_pydict({"hash": [5] * 6, "key": list(range(6)), "differ": [0] * 6, "sketch": [bytes([i] * 8) for i in range(6)]})
    pairs = {tuple(p) for out in op.meet(iter([batch])) for p in zip(*(c.to_pylist() for c in out.columns))}
    assert pairs == {(i, i + 1) for i in range(5)}


def test_keys_shared_by_the_same_documents_are_one_bucket(monkeypatch):
    rows = [(1, 7, 0), (1, 8, 0), (2, 8, 0), (3, 8, 0), (3, 7, 0), (4, 7, 1), (4, 8, 1), (5, 7, 0), (5, 8, 0), (5, 9, 0)]
    whole = pa.RecordBatch.from_pydict({"hash": pa.array([r[0] for r in rows]), "key": pa.array([r[1] for r in rows]), "band": pa.array([r[2] for r in rows], pa.int32())})
    for most in (100, 1):  # cut into batches of any size; hashes of too many rows stand for themselves
        monkeypatch.setattr(op, "BUCKET_ROWS", most)
        for size in (1, 3, 10):
            found = pa.Table.from_batches(op.shared(whole.slice(i, size) for i in range(0, len(rows), size)))
            sets = {}
            for bucket, key, band in zip(*(c.to_pylist() for c in found.columns)):
                sets.setdefault((bucket, band), set()).add(key)
            assert sorted((band, sorted(keys)) for (_, band), keys in sets.items()) == [(0, [7, 8])] * (1 if most > 1 else len(sets) - 2) + [(0, [7, 8, 9]), (1, [7, 8])]
            assert found.num_rows == 9 and (most == 1 or len(sets) == 3)


def test_keys_of_most_documents_are_left_out(spark):
    random = np.random.default_rng(4)
    known = op.bands(1000, 80)
    band = op.band_of(220, 80)
    size, _, differ, blocks = known[band]  # of the smallest size most blocks are weak
    common = random.integers(0, 1 << 63, 12, dtype=np.uint64)  # a passage of all documents
    sets = [np.unique(np.concatenate([common, random.integers(0, 1 << 63, size - 12, dtype=np.uint64)])) for _ in range(250)]
    for i in range(10):  # near copies of the first ones
        copy = sets[i].copy()
        copy[random.choice(size, 17, replace=False)] = random.integers(0, 1 << 63, 17, dtype=np.uint64)
        sets.append(np.unique(copy))
    rows, spares = [], []
    for key, elements in enumerate(sets):
        keys, spare = op.block_keys(elements, band, differ, blocks)
        assert len(keys) - abs(spare) == differ + 1  # with one more key left out an equal block would not be certain
        rows += [(h, key, band) for h in keys.view(np.int64).tolist()]
        spares.append((key, band, spare))
    rows.sort()
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["hash", "key", "band"])
    met = pa.Table.from_batches(op.shared(iter([batch])))
    hashes = spark.createDataFrame(met.to_pandas()).groupBy("bucket", "key", "band").count().withColumnRenamed("count", "hashes")
    left = op.without_spare(hashes, spark.createDataFrame(spares, "key bigint, band bigint, spare int"))
    found = {}
    for r in left.collect():
        found.setdefault(r.bucket, set()).add(r.key)
    assert all(any({i, 250 + i} <= keys for keys in found.values()) for i in range(10))
    assert max(map(len, found.values())) < 25 < met.to_pandas().groupby("bucket").key.nunique().max()


def test_buckets_sort_by_their_documents():
    powers, hashes = np.array([1, 9, 16], np.uint64), np.array([6, -7, 2], np.int64)
    made = op.ordered(op.mix(np.arange(3, dtype=np.uint64)), powers, hashes).view(np.int64)
    assert (np.diff(made) > 0).all() and (made > 0).all() and (made & 1).tolist() == [0, 1, 0]
