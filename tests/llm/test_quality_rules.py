import math

import brute
from pyspark.sql import functions as F
from llm_fixtures import documents, labels, none, odd  # noqa: F401

from tablescope.llm import quality_rules as op


def test_counts(spark, table, documents):
    rows = {r.doc_id: r for r in op.judge(table("documents"), table("labels")).collect()}
    for key, text in documents:
        own, r = brute.words(text), rows[key]
        expected = (len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), brute.repeated_lines(text), brute.repeated_words(text))
        assert tuple(r[c] for c in op.COUNTS) == expected
        assert r.base_failed == (len(own) < 50 or 100 * expected[4] > 50 * len(own))
        assert not (r.kept and r.base_failed)


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 10, 400) for k in (0, 1, 5, 9) if k <= n for p in (0.01, 0.3)]
    frame = spark.createDataFrame(cases, "n bigint, k bigint, p double")
    for n, k, p, got in frame.withColumn("tail", op.binomial_tail(F.col("n"), F.col("k"), F.col("p"))).collect():
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(got), want, rel_tol=1e-9)


def labelled(spark, good, bad):
    text = "plain words of a clean and quite ordinary document number {} " * 1
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{clean} {text.format(i)}", "en") for i in range(good)]
    rows += [(good + i, " ".join(f"word{i}{j}***" for j in range(60)), "en") for i in range(bad)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return docs, docs.select("doc_id", (F.col("doc_id") < good).cast("int").alias("quality"))


def test_cutoffs_need_proof(spark):
    docs, labels = labelled(spark, 4000, 50)
    rows = op.judge(docs, labels).groupBy((F.col("doc_id") < 4000).alias("good"), "kept").count().collect()
    assert {(r.good, r.kept): r["count"] for r in rows} == {(True, True): 4000, (False, False): 50}
    docs, labels = labelled(spark, 100, 50)  # too few good documents to prove a cutoff
    assert op.judge(docs, labels).where("not kept").count() == 0


def test_few_hundred_labels_prove_cutoffs_in_every_stratum(spark):
    docs, labels = labelled(spark, 1000, 40)
    docs = docs.withColumn("lang", F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("doc_id") % 4 + 1).cast("int")))
    rows = op.judge(docs, labels).groupBy((F.col("doc_id") < 1000).alias("good"), "kept").count().collect()
    assert {(r.good, r.kept): r["count"] for r in rows} == {(True, True): 1000, (False, False): 40}
    fewer = labels.where("doc_id >= 136 or quality = 0")  # 216 good labels in each stratum, one too few
    assert op.judge(docs, fewer).where("not kept").count() == 0
    fewer = labels.where("doc_id >= 132 or quality = 0")  # 217
    assert op.judge(docs, fewer).where("not kept").count() == 40


def test_path_ends_before_the_first_step_without_proof(spark):
    grid = {"a": (1.0, 2.0, 3.0), "b": (1.0, 2.0)}
    assert op.tightening(grid) == [("a", 3.0), ("b", 2.0), ("a", 2.0), ("b", 1.0), ("a", 1.0)]
    # 14 rejected ones of 1000 are too many for a proof of 2 %, 9 are not
    rows = [(i, "x", False, 2.5 if i < 9 else 0.0, 1.5 if 100 <= i < 105 else 0.0) for i in range(1000)]
    metrics = spark.createDataFrame(rows, "doc_id bigint, lang string, base_failed boolean, a double, b double")
    good = metrics.select("doc_id", F.lit(1).alias("quality"))
    tail = lambda k: sum(math.comb(1000, i) * 0.02**i * 0.98 ** (1000 - i) for i in range(k + 1))
    assert tail(9) <= 0.05 < tail(14)
    cuts = op.thresholds(metrics, good, "doc_id", "lang", grid=grid).collect()
    assert [tuple(r) for r in cuts] == [("x", 1000, 2.0, 2.0)]  # a's 1.0 comes after the step that ends the path


def test_false_rejections_are_limited(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, clean + " #" * (i % 50 == 0) * 40, "en") for i in range(5000)]  # two in a hundred good ones carry symbols
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = op.judge(docs, docs.select("doc_id", F.lit(1).alias("quality"))).where("kept").count()
    assert kept == 5000


def test_odd_rows(odd, none, labels):
    rows = op.judge(odd, labels)
    assert rows.count() == odd.count()
    by_key = {r.doc_id: r for r in rows.collect()}
    assert [by_key[k].n_words for k in (3, 4, 5, 6)] == [0, 0, 0, 1]
    assert by_key[8].n_words == 30_000 and by_key[8].n_repeat_words == 0
    kept = op.filter_kept(odd, labels)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [8]
    assert op.judge(none, labels).count() == 0 and op.judge(odd, labels.where("false")).count() == odd.count()


def test_no_python_on_the_path(odd, labels):
    assert not any(w in op.filter_kept(odd, labels)._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))
