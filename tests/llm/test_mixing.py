import brute
from pyspark.sql import functions as F
from llm_fixtures import documents, none, odd  # noqa: F401

from tablescope.llm import mixing as op


def water_filling(sizes, weights=(5, 2, 1), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        target |= {s: float(epochs * sizes[s]) for s in over} if over else {s: weight[s] * level for s in open_}
        open_ = open_ - over if over else set()
    return target


def test_sources_come_near_their_targets(table, documents):
    docs = table("documents")
    rows = op.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    texts, sizes, taken = dict(documents), {}, {}
    for r in rows:
        assert r["size"] == len(brute.words(texts[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    target = water_filling(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 5 for s in target)


def test_capped_sources_and_reruns(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else "tiny" if i % 60 == 0 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = sorted(map(tuple, op.mix(docs).collect()))
    assert first == sorted(map(tuple, op.mix(docs.repartition(7)).collect()))
    sums = {}
    for (key, size, source_size, target, taken), (_, _, source) in zip(first, rows):
        entry = sums.setdefault(source, [source_size, target, 0])
        entry[2] += taken
    want = water_filling({s: e[0] for s, e in sums.items()})
    assert want["tiny"] == 3 * sums["tiny"][0]
    assert all(abs(e[1] - want[s]) < 1e-6 * want[s] and abs(e[2] - e[1]) <= 0.03 * e[1] + 5 for s, e in sums.items())


def test_small_sources_do_not_depend_on_the_cap_of_slots(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAST_SLOTS", 512)
    monkeypatch.setattr(op, "MOST_SLOTS", 512)
    words = {"a": 60_000, "b": 30_000, "c": 10, "d": 95, "e": 333, "f": 1}  # a slot is worth about 177 words
    rows = [(i, "w " * 5, s) for s, n in words.items() for i in range(n // 5)] + [(0, "w " * (n % 5), s) for s, n in words.items() if n % 5]
    sizes, taken = {}, {}
    numbered = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("doc_id", F.concat_ws("-", "source", "doc_id", "text"))
    for r in op.mix(numbered).collect():
        source = r.doc_id[0]
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[source], taken[source] = sizes.get(source, 0) + r["size"], taken.get(source, 0) + r.taken
    assert sizes == words
    target = water_filling(words)
    for s in words:
        assert abs(taken[s] - target[s]) <= (0.03 if s in "ab" else 0.01) * target[s], s
    assert all(taken[s] == 3 * words[s] for s in "cdef")


def test_many_sources_smaller_than_a_slot(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAST_SLOTS", 64)
    monkeypatch.setattr(op, "MOST_SLOTS", 64)
    words = {f"s{i:03}": 50 + 37 * i % 400 for i in range(200)} | {"t": 90_000}  # one source far larger than its target
    docs = spark.createDataFrame([(s, "w " * n, s) for s, n in words.items() if s != "t"] + [(f"t{i}", "w " * 30, "t") for i in range(3_000)], "doc_id string, text string, source string")
    taken = {}
    for r in op.mix(docs).collect():
        source = "t" if r.doc_id[0] == "t" else r.doc_id
        taken[source] = taken.get(source, 0) + r.taken
    target = water_filling(words)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in words)


def test_own_slots_are_spread(spark):
    goals = spark.createDataFrame([(1, 64), (2, 3), (3, 0), (4, None)], "source_no int, own_slots bigint")
    slots = sorted(map(tuple, op.own_slots(goals, 6400).collect()))
    ones = [(slot, rank) for slot, source, rank in slots if source == 1]
    assert [rank for _, rank in ones] == list(range(64)) and sum(source == 2 for _, source, _ in slots) == 3 and len(slots) == 67
    assert all(abs(n - slot / 100) < 4 for n, (slot, _) in enumerate(ones))


def test_every_prefix_of_the_schedule_is_mixed(spark):
    shares = spark.createDataFrame([(1, 0, op.POINTS // 2), (2, op.POINTS // 2, op.POINTS * 3 // 4), (3, op.POINTS * 3 // 4, op.POINTS)], "source_no int, low bigint, high bigint")
    slots = sorted(map(tuple, op.schedule(shares, 4000).collect()))
    assert [s[0] for s in slots] == list(range(4000))
    seen = {1: 0, 2: 0, 3: 0}
    for n, (_, source, rank) in enumerate(slots, 1):
        assert rank == seen[source]
        seen[source] += 1
        assert all(abs(seen[s] - n * p) < 12 for s, p in ((1, 0.5), (2, 0.25), (3, 0.25)))


def test_odd_rows(odd, none):
    rows = op.mix(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r["size"] for r in rows if r.doc_id in (3, 4, 5, 6)} == {3: 0, 4: 0, 5: 0, 6: 1}
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert op.mix(none).count() == 0 and op.mix(odd.where("doc_id in (3, 4)")).count() == 2
    assert op.mixed_rows(odd).columns == odd.columns and op.mixed_rows(none).count() == 0


def test_no_python_on_the_path(odd):
    assert not any(w in op.mix(odd)._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))
    assert op.mix(odd).agg(F.sum("size")).first()[0] > 30_000
