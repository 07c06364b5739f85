import brute
from pyspark.sql import functions as F
from llm_fixtures import documents, none, odd  # noqa: F401

from tablescope.llm import personal_data as op

TRICKY = [
    "a@b.c_d@e.f x.@y.z.@q.r +a@b-c.d.e.f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "12 34-56 4532-0151-1283-0366 4532015112830366 453201511283036600000",
    "+1 (743) 555-3824. +4 +49.30.1234567) +123456789 +1234567890123456", "é\U0001f600 a@b.c é 10.0.0.1", "@ a@ @b.c a@b a@b. 1", "9" * 3000 + " " + "a" * 3000 + "@" + "b." * 500 + "c",
    "+1" + "(" * 2000 + "1", "x@y.z,x@y.z\n\n\t+1 111 111 1111",
]


def spans(frame):
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in frame.collect()}


def test_base_equals_plain_patterns(spark, documents):
    docs = [*documents, *((10_000 + i, t) for i, t in enumerate(TRICKY))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert spans(op.find_personal_data(frame)) == {k: brute.base_spans(t) for k, t in docs}


def test_context_finds_unseen_identifiers(spark):
    seen = [(i, f"some prose here. Hotline: +1 (743) 555-38{i:02d} is open all day") for i in range(20)]
    unseen = [(100, "other prose. Hotline: 0743-5553 is open"), (101, "page 0743-5553 of a book"), (102, "Hotline: closed, 12 of 30 pages")]
    frame = spark.createDataFrame(seen + unseen, "doc_id bigint, text string")
    found = {r.doc_id: r for r in op.digest(op.find_personal_data(frame)).collect()}
    assert found[100].spans == "phone:22:31" and found[100].n_phone == 0
    assert found[101].spans == found[102].spans == ""
    assert all(found[i].n_phone == 1 and found[i].spans.count("phone") == 1 for i in range(20))


def test_redaction_and_odd_rows(odd, none):
    masked = op.redact(odd)
    assert masked.columns == odd.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[12] == "mail me at <email> or <phone>, card <card>, host <ip>"
    assert texts[3] is None and texts[4] == "" and texts[1] == odd.where("doc_id = 1").first().text
    assert masked.count() == odd.count()
    assert op.redact(none).count() == 0
    assert op.find_personal_data(odd).count() == odd.count()
    assert op.find_personal_data(none).count() == 0


def test_no_python_on_the_path(odd):
    frame = op.find_personal_data(odd)
    assert not any(w in frame._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))
    assert frame.agg(F.count("spans")).first()[0] == odd.count()
