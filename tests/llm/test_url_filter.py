import re

from llm_fixtures import CLASHING

from tablescope.llm import url_filter as op
from tablescope.llm.queries import QUERIES

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("a.b.example.com", "", "block"), ("com", "/d", "allow"), ("com", "/de/x", "block"), ("EXAMPLE.org", "/fr/a", "block"),
    ("b.example.com", "/de/x", "allow"), ("com", "/d", "block"), ("a", "/", "allow"), ("", "/secret", "block"), ("example.net:80", "/", "allow"),
]


def judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    best = None
    for rule_host, rule_path, verdict in rules:
        rule_host = rule_host.lower()
        if (rule_host in ("", host) or host.endswith("." + rule_host)) and path.startswith(rule_path):
            best = max(best or (-1,), (len(rule_host + rule_path), len(rule_host), rule_host + rule_path, verdict))
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


URLS = [
    None, "", "no scheme", "://", "http://", "http:///fr/x", "http://NET/", "http://net", "http://net?x=/en/", "http://x.net#a", "https://example.net/en/1",
    "https://a.example.net/en/", "https://a.example.net/en", "https://notexample.net/en/1", "https://example.net./en/1", "https://example.net:80/en/1",
    "https://user@example.net/en/1", "http://a.b.example.com", "http://x.a.b.example.com/de/x", "http://b.example.com/de/xy", "http://c.example.com/de/xy",
    "http://example.org/fr/ab", "http://org/fr/", "http://org/fr", "http://x.com/d", "http://a/", "http://a", "http://ÄÖ.example.org/fr/é\U0001f600", "http://x.io/secret/1",
    "http://" + "a." * 3000 + "com/de/x", "http://x.com/d" + "y" * 100_000, "http://..net/", "http://.com/d", "x://a://net/", "http://x.com/d\nfoo",
]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_odd_urls_and_rules(spark):
    numbered = [(i, u) for i, u in enumerate(URLS)] + [(0, "http://net/"), (None, "http://net/"), (3, "://")]
    pages = spark.createDataFrame(numbered, "page_id bigint, url string").selectExpr("*", *[f"'{c}' AS {c}" for c in [*CLASHING, "host", "path", "rule", "verdict", "labels", "part", "salt", "page", "k0"]])
    rules = op.rules_frame(spark, [*RULES, (None, "/", "block"), ("x.io", "/", None), ("x.io", "secret", "block"), ("io", None, "allow")])
    expected = sorted(((i, *judge(u, [*RULES, ("io", "", "allow")])) for i, u in numbered), key=repr)
    assert rows(op.filter_urls(pages, rules)) == expected
    kept = op.filter_urls(pages, rules, keep=("key", "host", "k0"), default="block")
    assert kept.columns == ["key", "k0", "host", "path", "rule", "verdict"] and kept.count() == len(numbered)
    assert op.filter_urls(pages, rules, keep=()).count() == len(numbered)
    assert op.filter_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in op.filter_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_parts_equal_one_part(spark, monkeypatch):
    """Many parts, a host and a URL that hold most rows, and rules that span parts."""
    numbered = [(i, f"http://h{i % 7 if i % 3 else 0}.example.{'net' if i % 3 else 'com'}/{'de' if i % 5 else 'en'}/{i % 40 if i % 3 else 1}") for i in range(3000)]
    pages = spark.createDataFrame(numbered, "page_id bigint, url string")
    more = RULES + [(f"h{i}.example.net", f"/de/{j}", "block") for i in range(5) for j in range(20)]
    rules = op.rules_frame(spark, more)
    expected = sorted(((i, *judge(u, more)) for i, u in numbered), key=repr)
    monkeypatch.setattr(op, "LEAST_PART", 100)
    monkeypatch.setattr(op, "MOST_PART", 100)
    assert rows(op.filter_urls(pages, rules)) == expected
    monkeypatch.setattr(op, "MOST_HOSTS", 0)
    assert rows(op.filter_urls(pages, rules)) == expected


def test_hot_url_is_split(spark):
    pages = spark.range(4000).selectExpr("id AS row", "'k' AS key").withColumn("salt", op.F.pmod(op.F.xxhash64("row"), op.F.lit(1 << 31)))
    splits = op.splits_of(pages.withColumn("key", op.F.encode("key", "UTF-8")), 8, 4000)
    assert len(splits) == 7 and {k for k, _ in splits} == {b"k"}


def test_query(spark, table):
    got = QUERIES["op11_url_filter"](spark, "/root/testdata/sf0.001")
    assert rows(got) == sorted(((r.page_id, *judge(r.url, op.RULES)) for r in table("pages").collect()), key=repr)
