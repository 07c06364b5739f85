"""Block and allow rules on hosts and path prefixes, judged by a sort-merge range join.

A rule is a host, which stands for itself and all its subdomains, and a path prefix. Hosts are written
backwards, each label closed by a point ("net.example.blog."), and the path follows; the rules are then
prefixes of these canonical keys, and a prefix is an interval of the sorted keys. Intervals of prefixes
nest or are apart, so one sweep over rules and keys in order, with a stack of the rules that are open,
finds for every key all rules around it; the innermost is the longest.

A rule with a longer path holds below every subdomain, which is not one interval of full keys. Such a
rule is the interval of its own host with its path, and a URL asks once more with each of its parent
hosts that carries such a rule; the longest answer of a URL counts.

Keys are cut into parts of the sorted order at splits taken from a sample of all keys, as a range
partitioning does. A key that many rows share is split by a number of the row. A rule goes to every
part its interval touches, which adds at most the depth of the nesting to each part, so no part needs
another one, no rule is broadcast, and no group is gathered.

Defined results: a null URL, or one without "://", has an empty host and path; only a rule with an
empty host fits it. Rules with a null host or verdict, or with a path that does not begin with "/",
never fit; a null path is empty. Rule hosts are read in lower case (A-Z). A rule whose path is "/" does
not fit a URL without a path. Of rules of equal length the one with the longer host counts, of equal
rules the verdict greatest by code points ("block" before "allow"). Repeated rows are judged one by
one; an empty table gives none; columns that are not asked for are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.shared import ascii_lower, map_arrow, materialize

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: What a URL gets that no rule fits.
DEFAULT = "allow"
#: Rows a part should hold at least, and at most on average.
LEAST_PART, MOST_PART = 1000, 200_000
#: Keys sampled for each part, and bytes of a key that a split keeps; both decide balance, never results.
SAMPLED, SPLIT_BYTES = 20, 256
#: Hosts of rules that are broadcast to leave out needless questions: number, and characters of all.
MOST_HOSTS, MOST_HOST_CHARS = 100_000, 4_000_000


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def labels_of(host: Column) -> Column:
    """Labels of a host from the top level down; the empty host has one empty label."""
    return F.reverse(F.split(host, r"\."))


def key_of(labels: Column) -> Column:
    return F.concat_ws("", F.transform(labels, lambda x: F.concat(x, F.lit("."))))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """(key, rule) of every rule that can fit; an empty host is the root, above every label."""
    own = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    own = own.where(F.col("host").isNotNull() & F.col("verdict").isNotNull() & ((F.col("path") == "") | F.col("path").startswith("/")))
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    deep = ~F.col("path").isin("", "/")
    root = F.col("host") == ""
    labels = F.when(root, F.array().cast("array<string>")).otherwise(labels_of(F.col("host")))
    key = F.concat(key_of(labels), F.when(deep, F.col("path")).otherwise(F.lit("")))
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), F.concat("host", "path").alias("name"), "verdict",
        (F.col("path") == "/").alias("needs_path"),
    )
    return own.select(key.alias("key"), rule.alias("rule"), deep.alias("deep"), key_of(labels).alias("host_key"), F.size(labels).alias("depth"))


def questions(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, row, page, has_path): one row per URL with its own key, and one per parent host that carries a rule on paths."""
    own = pages.select(F.concat(key_of(F.col("labels")), "path").alias("key"), "row", F.struct("kept", "host", "path").alias("page"), (F.col("path") != "").alias("has_path"))
    deepest = rules.where("deep").agg(F.max("depth")).first()[0]
    if deepest is None:
        return own
    depths = F.sequence(F.lit(0), F.least(F.lit(deepest), F.size("labels") - 1))
    above = pages.where("path <> ''").select("row", "path", F.explode(F.transform(depths, lambda d: key_of(F.slice(F.col("labels"), F.lit(1), d)))).alias("host_key"))
    hosts = rules.where("deep").select("host_key").distinct()
    count, chars = hosts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("host_key")), F.lit(0))).first()
    if count <= MOST_HOSTS and chars <= MOST_HOST_CHARS:  # otherwise they are asked in vain, with the same result
        above = above.join(F.broadcast(hosts), "host_key", "left_semi")
    nothing = F.lit(None).cast(own.schema["page"].dataType)
    return own.unionByName(above.select(F.concat("host_key", "path").alias("key"), "row", nothing.alias("page"), F.lit(True).alias("has_path")))


def splits_of(asked: DataFrame, parts: int, count: int) -> list[tuple[bytes, int]]:
    """Where the sorted order of (key, salt) is cut, from at most about SAMPLED keys a part, sampled over all rows by a hash."""
    if parts < 2:
        return []
    share = min(1.0, parts * SAMPLED / count)
    drawn = asked.where(F.pmod(F.xxhash64("row", "key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    found = sorted((bytes(r.key), r.salt) for r in drawn.select(F.substring("key", 1, SPLIT_BYTES).alias("key"), "salt").collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def part_numbers(splits: list[tuple[bytes, int]]):
    """Adds the part to each row; a rule is repeated for every part that its interval touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = [], []
            for i, (key, salt, is_rule) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "is_rule")))):
                first = last = bisect_right(splits, (key, -1 if is_rule else salt))
                if is_rule:
                    last = bisect_left(splits, (key[:-1] + bytes([key[-1] + 1]), -1)) if key else len(splits)
                at += [i] * (last - first + 1)
                parts += range(first, last + 1)
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *out.columns], names=["part", *out.schema.names])

    return run


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (part, key, rules first, length): each question gets the innermost open rule that fits it."""
    current, stack = None, []
    for batch in batches:
        rows, best = [], []
        rules = batch.column("rule")
        columns = (batch.column(c).to_pylist() for c in ("part", "key", "is_rule", "has_path"))
        for i, (part, key, is_rule, has_path) in enumerate(zip(*columns)):
            if part != current:
                current, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if is_rule:
                stack.append((key, rules[i].as_py()))
            else:
                rows.append(i)
                best.append(next((rule for _, rule in reversed(stack) if has_path or not rule["needs_path"]), None))
        kept = batch.take(pa.array(rows, pa.int64()))
        found = pa.array(best, rules.type)
        yield pa.RecordBatch.from_arrays([kept.column("row"), kept.column("page"), found], names=["row", "page", "rule"])


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = DEFAULT) -> DataFrame:
    """The columns ``keep`` of every row, and host, path, rule and verdict; kept columns of these names give way to them."""
    spark = pages.sparkSession
    keep = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)] or [F.lit(True).alias("none")]
    host, path = host_and_path(F.col(f"`{url}`"))
    # numbered once and written, so that a lost task finds the same numbers again
    own = pages.select(F.struct(*kept).alias("kept"), host.alias("host"), path.alias("path"))
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "urls").withColumn("labels", labels_of(F.col("host")))
    known = materialize(prepared_rules(rules), "url-rules")
    asked = questions(own, known)
    asked = asked.withColumns({"key": F.encode("key", "UTF-8"), "salt": F.pmod(F.xxhash64("row"), F.lit(1 << 31))})
    asked = materialize(asked, "url-questions")
    count = asked.count()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // MOST_PART))
    parts = max(1, min(wanted, count // LEAST_PART))
    splits = splits_of(asked, parts, count)

    types = {f.name: f.dataType for f in asked.schema} | {"rule": known.schema["rule"].dataType}
    empty = lambda c: F.lit(None).cast(types[c]).alias(c)
    both = asked.select("key", "salt", F.lit(False).alias("is_rule"), "has_path", "row", "page", empty("rule")).unionByName(
        known.select(F.encode("key", "UTF-8").alias("key"), F.lit(-1).cast("long").alias("salt"), F.lit(True).alias("is_rule"), F.lit(True).alias("has_path"), empty("row"), empty("page"), "rule"))
    page, rule = types["page"].simpleString(), types["rule"].simpleString()
    dealt = map_arrow(both, part_numbers(splits), f"part int, key binary, salt bigint, is_rule boolean, has_path boolean, row bigint, page {page}, rule {rule}")
    dealt = dealt.repartitionById(len(splits) + 1, F.col("part"))
    dealt = dealt.sortWithinPartitions("part", "key", F.col("is_rule").desc(), "rule.length")
    answers = map_arrow(dealt, sweep, f"row bigint, page {page}, rule {rule}")
    longest = answers.groupBy("row").agg(F.first("page", ignorenulls=True).alias("page"), F.max("rule").alias("rule"))
    return longest.select(
        *[F.col(f"page.kept.k{i}").alias(c) for i, c in enumerate(keep)], F.col("page.host").alias("host"), F.col("page.path").alias("path"),
        F.col("rule.name").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict"),
    )
