"""Substring dedup, token shards, BPE codec, language-model scores, quality classifier."""

import collections
import hashlib
import math
import zlib

import brute
import numpy as np
import pytest
from llm_fixtures import documents, labels, none, odd  # noqa: F401

from tablescope.llm import bpe_codec, lm_scoring, quality_classifier, substring_dedup, token_shards
from tablescope.llm.shared import scratch_path
from tablescope.llm.tokenizer_files import Cache

TEXTS = [
    "", "  ", "a<|endoftext|>b <|startoftext|>C", "ÀÉ Σ ΑΣ İstanbul ﬁ ½ ² 日本語 é   x", "I'll don't 'S 12ab34 _x_ ---!!", "\U0001f468‍\U0001f469 zw", "a" * 3000,
    "<|endoftext|", "ab\x00c\x1c\x85d", "'s't'", "x\n", "x \n", "x ", "\nx", " x", "a\n\nb \n c", "é 　x", *(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(1, 0x180)),
]


def test_codec_equals_the_library(documents):
    coder = bpe_codec.coder(bpe_codec.vocabulary(bpe_codec.VOCABULARY))
    for text in [*TEXTS, *(t for _, t in documents[:60])]:
        ids = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids, text[:50]
        assert coder.decode(ids) == coder.tokenizer.decode(ids, skip_special_tokens=False) == " ".join(p[2] for p in coder.encode_parts(text))


def test_shard_encoder_equals_the_library(documents):
    own = token_shards.encoder(token_shards.vocabulary(token_shards.VOCABULARY))
    for text in [*TEXTS, *(t for _, t in documents[:60])]:
        assert np.frombuffer(own.encode(text), own.type).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def test_fragments_cut_only_where_no_token_reaches():
    coder = bpe_codec.coder(bpe_codec.vocabulary(bpe_codec.VOCABULARY))
    cuts = coder.fragments("qzxjkvbqwxq")
    assert len(cuts) > 1 and "".join(cuts) == "qzxjkvbqwxq"
    assert coder.fragments("the") == ["the"]


def test_codec_frames(odd, none):
    rows = bpe_codec.digest_documents(odd).collect()
    assert len(rows) == odd.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in rows if r.doc_id in (3, 4, 5)} == dict.fromkeys((3, 4, 5), (0, empty))
    assert bpe_codec.digest_documents(none).count() == 0
    assert bpe_codec.encode_documents(odd, keep=("doc_id", "key", "words")).columns == ["doc_id", "key", "words", "n_tokens", "ids", "decoded"]


def test_workers_hold_no_caches_after_encoding(spark):
    frame = spark.createDataFrame([(i, "heldbynobody") for i in range(40)], "doc_id bigint, text string").repartition(4)
    assert bpe_codec.encode_documents(frame).where("n_tokens > 0").count() == 40

    def held(batches):
        for batch in batches:
            caches = [cache for c in bpe_codec._coders.values() for cache in (c.words, c.chunks)]
            yield batch.from_pydict({"held": [any("heldbynobody" in g for cache in caches for g in (cache.young, cache.old))]})

    assert not any(r.held for r in spark.range(0, 8, 1, 8).mapInArrow(held, "held boolean").collect())


def test_cache_forgets_in_generations(monkeypatch):
    monkeypatch.setattr("tablescope.llm.tokenizer_files.CACHE_ENTRIES", 3)
    cache = Cache(lambda pieces: [p.upper() for p in pieces])
    for pieces in (["a", "b"], ["c", "d", "a"], ["a", "e" * 100, "a"], ["b", "f"]):
        assert cache.of(pieces) == [p.upper() for p in pieces]
    assert len(cache.young) <= 6


def test_shards_round_trip(spark, table, documents):
    path = scratch_path(spark, "shards")
    rows = token_shards.round_trip(table("documents"), path).orderBy("start").collect()
    library = token_shards.encoder(token_shards.vocabulary(token_shards.VOCABULARY)).tokenizer
    start = 0
    for r, (key, text) in zip(rows, sorted(documents)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    manifest = token_shards.manifest_of(spark, path).orderBy("shard").collect()
    shard = token_shards.Shard(path, manifest[0].file)
    assert shard.ids(len(shard) - 1)[-1] == 2 and len(shard) == manifest[0].documents
    with pytest.raises(ValueError):
        _broken(path, manifest[0].file)


def _broken(path, name):
    """Opens a shard whose dictionary is another one."""
    import os
    import shutil

    folder = path.removeprefix("file:")
    copy = f"{folder}-copy"
    shutil.copytree(folder, copy)
    for file in os.listdir(copy):
        if file.endswith(".dict"):
            with open(f"{copy}/{file}", "ab") as out:
                out.write(b"x")
    return token_shards.Shard(copy, name)


def test_shards_of_odd_rows(spark, odd, none):
    rows = token_shards.round_trip(odd, scratch_path(spark, "shards")).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0].doc_id is None
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert token_shards.round_trip(none, scratch_path(spark, "shards")).count() == 0


def test_repeats_equal_counting_windows(spark, table, documents):
    def found(frame, window):
        return sorted(map(tuple, substring_dedup.remove_repeated_windows(frame, window=window).collect()))

    assert found(table("documents"), 35) == sorted(brute.without_repeats(documents, 35))
    assert found(table("documents"), 8) == sorted(brute.without_repeats(documents, 8))
    docs = [(0, "a b " * 50), (1, "c " * 35), (2, "d " * 36), (3, " ".join(map(str, range(100)))), (4, " ".join(map(str, range(17, 60)))), (5, " ".join(map(str, range(40, 74))))]
    assert found(spark.createDataFrame(docs, "doc_id bigint, text string"), 35) == brute.without_repeats(docs, 35)


def test_repeats_of_odd_rows(odd, none):
    rows = substring_dedup.remove_repeated_windows(odd)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in rows.collect()), key=repr)
    want = sorted(((k, n, g) for k, n, g, _ in brute.without_repeats([(r.doc_id, r.text) for r in odd.collect()], 35)), key=repr)
    assert got == want
    assert substring_dedup.remove_repeated_windows(none).count() == 0


def test_lattice_sums_all_segmentations():
    scores = {"▁": -1.0, "▁a": -2.0, "a": -1.5, "b": -2.5, "ab": -0.7, "▁ab": -3.0}
    lattice = lm_scoring.Lattice(scores, [-9.0] * 256)

    def total(text):
        return 1.0 if not text else sum(math.exp(scores[text[:i]]) * total(text[i:]) for i in range(1, len(text) + 1) if text[:i] in scores)

    assert math.isclose(lattice.log_probability(b"ab"), math.log(total("▁ab")))
    assert math.isclose(lattice.log_probability("aé".encode()), math.log(total("▁a")) - 18)
    expected = collections.Counter()
    for piece, share in lattice.expected(b"ab"):
        expected[piece] += share
    assert math.isclose(sum(expected[p] * len(p) for p in scores), 3)
    assert math.isclose(expected["▁ab"], math.exp(-3) / total("▁ab"))


def test_scores(spark, table, documents):
    rows = {r.doc_id: r for r in lm_scoring.score_documents(table("documents"), frequent_words=500).collect()}
    tokens = {k: [*t.encode().lower().split(), None] for k, t in documents}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    count = collections.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    total, distinct = sum(count.values()), len(count)
    for k, t in tokens.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(count[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), rel_tol=1e-9)
    whole = lm_scoring.score_documents(table("documents")).collect()
    assert all(math.isclose(r.score, rows[r.doc_id].score, rel_tol=1e-9) for r in whole)
    start = lm_scoring.score_documents(table("documents"), passes=1).collect()
    gain = lambda found: sum(r.score for r in found if r.held_out)
    assert gain(whole) > gain(start)  # more passes help on texts not learnt from
    # words seen in training score about as the base does; the base spends nothing on the spelling of others
    known = [r for r in whole if r.n_known == r.n_tokens]
    assert known and sum(r.score for r in known) > 1.1 * sum(r.base_score for r in known)


def plain_scores(documents, passes):
    """{key: log10 probability} by scalar recursions over the distinct words, one by one."""
    tokens = {k: (t or "").encode().lower().split() for k, t in documents}
    train = [k for k in tokens if zlib.crc32(str(k).encode()) % 10]
    count = collections.Counter(w for k in train for w in tokens[k])
    once, twice = (sum(c == n for c in count.values()) for n in (1, 2))
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9)
    pieces, single = lm_scoring.piece_scores()
    for _ in range(passes):
        lattice, found = lm_scoring.Lattice(pieces, single), collections.Counter()
        for word in count:
            for piece, share in lattice.expected(word):
                found[piece] += share * discount
        total = sum(found.values()) + sum(c - discount for c in count.values()) + len(train) + 0.1 * (len(pieces) + 257)
        pieces = {p: math.log((found[p] + 0.1) / total) for p in pieces}
        single = [math.log((found[b] + 0.1) / total) for b in range(256)]
    lattice = lm_scoring.Lattice(pieces, single)
    own = {w: math.log10(max(count[w] - discount, 0) / total + math.exp(lattice.log_probability(w))) for t in tokens.values() for w in set(t)}
    return {k: sum(own[w] for w in t) + math.log10((len(train) + 0.1) / total) for k, t in tokens.items()}


def test_score_equals_plain_recursions(spark):
    texts = ["the quick brown fox " * 9 + "jumps", "Ünïcödé wörds 日本 the end", "a" * 19 + " " + "b" * 20 + " " + "c" * 45, "fox foxes foxy \x00 x", None, "the the quick"]
    docs = [(i, texts[i % len(texts)] if i % 4 else f"{texts[0]} word{i} {i} ü{i}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for passes in (1, 3):
        plain = plain_scores(docs, passes)
        for r in lm_scoring.score_documents(frame, passes=passes).collect():
            assert math.isclose(r.score, plain[r.doc_id], rel_tol=1e-4), (r.doc_id, r.score, plain[r.doc_id])


def test_scores_of_odd_rows(odd, none):
    rows = lm_scoring.score_documents(odd).collect()
    assert len(rows) == odd.count() and all(r.n_tokens >= 1 and math.isfinite(r.score) for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (3, 4, 5, 6)} == {3: 1, 4: 1, 5: 1, 6: 2}
    assert lm_scoring.score_documents(none).count() == 0


def test_classifier_on_documents_kept_from_training(table):
    labels = table("labels")
    taught = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    rows = quality_classifier.score_quality(table("documents"), taught).join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert len(rows) > 20 and right >= 0.9 * len(rows)


def test_co_training_gains_from_the_pool():
    random = np.random.default_rng(5)
    y = random.integers(0, 2, 2000).astype(float)
    views = [y[:, None] * 2.5 + random.normal(size=(2000, 1)), y[:, None] * 2.5 + random.normal(size=(2000, 1))]
    views = [np.hstack([v, random.normal(size=(2000, 12))]) for v in views]
    few, pool, test = slice(0, 24), slice(24, 1000), slice(1000, 2000)
    right = lambda m: np.mean([((model.log_odds(v[test]) > 0) == (y[test] > 0)).mean() for model, v in zip(m, views)])
    alone = quality_classifier.co_train([v[few] for v in views], y[few], [v[pool] for v in views], rounds=0)
    taught = quality_classifier.co_train([v[few] for v in views], y[few], [v[pool] for v in views], rounds=5)
    assert right(taught) > right(alone)


def test_classifier_on_odd_rows(odd, none, labels):
    for known in (labels, labels.where("false"), labels.where("quality = 1")):
        rows = quality_classifier.score_quality(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.score_quality(none, labels).count() == 0
