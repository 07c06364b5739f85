"""Personal data by base rules and by bootstrapped contexts.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern. The bootstrap then
learns where such data stand: the word before and the word after a base match are lexical patterns. A
pattern's confidence is the (weighted) share of all its occurrences in the corpus that stand beside a
known instance; an unseen identifier-shaped token gets the combined confidence of the patterns it stands
beside, joins the instances with that weight, and the graph of patterns and instances is scored again. After
a fixed number of rounds, tokens beside a pattern of high confidence and support become spans of the
pattern's kind. Everything is DataFrame operations; texts stay in their task.

Positions are code points; a match is located from the lengths of the gaps between matches. The patterns
are written without backtracking, so long runs of digits or letters cost linear time.

Defined results: a null text is the empty text; overlapping spans of different kinds all count; repeated
rows each get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import materialize, small, text_of, words_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive repeats and a check of the character before the match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_BYTES = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}))(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: An identifier-shaped token: a word with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Characters at a token's edges that are not part of an identifier, and characters of a context read.
EDGE = r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$"
CONTEXT_CHARS = 80
#: Lengths of matches are summed by chunks of so many.
CHUNK = 128
ROUNDS = 3
#: A pattern needs this confidence and so many distinct instances, a token this combined confidence.
PATTERN_CONFIDENCE, PATTERN_SUPPORT, TOKEN_CONFIDENCE = 0.5, 3, 0.5
#: Pattern tables up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 200_000
SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def total(numbers: Column, first: Column, count: Column | int) -> Column:
    """Sum of ``count`` numbers from place ``first`` (0 on)."""
    return F.aggregate(F.slice(numbers, first + 1, F.lit(count) if isinstance(count, int) else count), F.lit(0), lambda a, x: a + x)


def located(matches: Column, gaps: Column, more: Callable[[Column, Column, Column], dict[str, Column]] | None = None) -> Column:
    """Start, end and text of each match, from the texts between matches, and ``more`` of (matches, gaps, place).

    Lengths are summed by chunks and inside a chunk, so a text of very many matches stays cheap.
    """
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    length = lambda a: F.transform(a["m"], lambda m, i: F.length(m) + F.length(F.get(a["g"], i)))
    chunks = lambda a: F.transform(upto(F.ceil(F.size(a["l"]) / CHUNK).cast("int")), lambda c: total(a["l"], c * CHUNK, CHUNK))
    before = lambda a: F.transform(a["s"], lambda _, c: total(a["s"], F.lit(0), c))

    def spans(a: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.get(a["b"], F.floor(i / CHUNK).cast("int")) + total(a["l"], i - i % CHUNK, i % CHUNK) + F.length(F.get(a["g"], i))
            rest = more(a["m"], a["g"], i) if more else {}
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), *[c.alias(n) for n, c in rest.items()])

        return F.transform(a["m"], span)

    with_before = lambda a: let(F.struct(a["m"], a["g"], a["l"], before(a).alias("b")), spans)
    with_chunks = lambda a: let(F.struct(a["m"], a["g"], a["l"], chunks(a).alias("s")), with_before)
    with_lengths = lambda a: let(F.struct(a["m"], a["g"], length(a).alias("l")), with_chunks)
    found = let(F.struct(matches.alias("m"), gaps.alias("g")), with_lengths)
    return F.when(F.size(matches) > 0, found)


def matches_of(text: str, pattern: str) -> tuple[Column, Column]:
    """All matches, and the texts before, between and after them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(IP_BYTES)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a span array per kind, failing matches dropped."""
    checked = lambda kind: F.filter(located(*matches_of(text, BASE[kind])), lambda s: valid(kind, s["value"]))
    return df.withColumns({k: F.coalesce(checked(k), F.array().cast(SPAN)) for k in KINDS})


def numbered(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], F.lit(kind).alias("kind"), s["end"]))


def in_order(spans: list[tuple[int, Column]]) -> Column:
    """Spans of numbered kinds as (start, kind number, end), by start, then kind."""
    return F.sort_array(F.concat(*[numbered(c, i) for i, c in spans]))


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def normal_word(word: Column) -> Column:
    """A context word: lower case, without the marks at its edges, digits as 0."""
    return F.regexp_replace(F.lower(F.regexp_replace(word, EDGE, "")), "[0-9]", "0")


def neighbour_words(matches: Column, gaps: Column, i: Column) -> dict[str, Column]:
    """The words before and after a token: of the gap beside it, or else the next token."""
    before = words_of(F.substring(F.get(gaps, i), -CONTEXT_CHARS, CONTEXT_CHARS))
    after = words_of(F.substring(F.get(gaps, i + 1), 1, CONTEXT_CHARS))
    return {
        "before": F.coalesce(F.try_element_at(before, F.lit(-1)), F.get(matches, i - 1)),
        "after": F.coalesce(F.try_element_at(after, F.lit(1)), F.get(matches, i + 1)),
    }


def contexts(df: DataFrame) -> DataFrame:
    """One row per identifier-shaped token and side: place, pattern word, token, kind number (null: unseen).

    A token inside a base span stands for the span: the word before the span's first token and the one
    after its last count, inner sides don't.
    """
    tokens = located(*matches_of("__text", TOKEN), neighbour_words)
    rows = df.select("key", "tag", *KINDS, F.explode(tokens).alias("t"))
    touching = lambda k: F.filter(k, lambda s: (s["start"] < F.col("t.end")) & (F.col("t.start") < s["end"]))
    touched = F.concat(*[numbered(touching(k), i) for i, k in enumerate(KINDS)])
    rows = rows.select("key", "tag", "t.*", F.get(touched, 0).alias("span"))
    sides = F.array(
        F.struct(F.lit("L").alias("side"), F.when(F.coalesce(F.col("start") <= F.col("span.start"), F.lit(True)), normal_word(F.col("before"))).alias("word")),
        F.struct(F.lit("R").alias("side"), F.when(F.coalesce(F.col("end") >= F.col("span.end"), F.lit(True)), normal_word(F.col("after"))).alias("word")),
    )
    rows = rows.select("key", "tag", "start", "value", F.col("span.kind").alias("kind"), F.explode(sides).alias("s")).where("s.word <> ''")
    trimmed = F.regexp_replace("value", EDGE, "")
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}+]*", 0))
    rows = rows.withColumns({"token": F.lower(trimmed), "start": F.col("start") + lead, "length": F.length(trimmed)})
    return rows.where("token <> ''").select(
        "key", "tag", "start", (F.col("start") + F.col("length")).alias("end"), "token", "kind", F.concat("s.side", F.lit(" "), "s.word").alias("pattern")
    )


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern's word occurs in all texts (a word is before and after something each time)."""
    wanted = small(patterns.select(F.substring("pattern", 3, 1 << 20).alias("word")).distinct(), BROADCAST_ROWS)
    words = texts.select(F.explode(words_of(F.col("__text"))).alias("raw")).groupBy("raw").count()
    words = words.select(normal_word(F.col("raw")).alias("word"), "count").join(wanted, "word", "left_semi")
    return words.groupBy("word").agg(F.sum("count").alias("occurrences"))


def bootstrap(found: DataFrame, texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns accepted after the last round."""
    edges = found.groupBy("pattern", "token", "kind").agg(F.count(F.lit(1)).alias("n"))
    per_pattern = edges.groupBy("pattern").agg(
        F.sum("n").alias("beside"), F.count_distinct("token").alias("tokens"), F.count_distinct(F.when(F.col("kind").isNotNull(), F.col("token"))).alias("seeds")
    )
    # a pattern without a seed, or with too few instances, can never be accepted, nor lend weight
    per_pattern = materialize(per_pattern.where((F.col("seeds") > 0) & (F.col("tokens") >= PATTERN_SUPPORT)), "patterns")
    totals = occurrences(texts, per_pattern)
    per_pattern = per_pattern.join(totals, F.substring("pattern", 3, 1 << 20) == F.col("word"))
    per_pattern = materialize(per_pattern.where(F.col("beside") >= PATTERN_CONFIDENCE * F.col("occurrences")).select("pattern", "occurrences"), "possible")
    edges = materialize(edges.join(small(per_pattern, BROADCAST_ROWS), "pattern"), "graph")
    seeds = edges.where(F.col("kind").isNotNull()).select("token", "kind").distinct().withColumn("weight", F.lit(1.0))
    known, scores = seeds, None
    for _ in range(rounds):
        sums = edges.select("pattern", "token", "n", "occurrences").join(known, "token").groupBy("pattern", "kind", "occurrences")
        scores = sums.agg(F.sum(F.col("n") * F.col("weight")).alias("mass"), F.count_distinct("token").alias("support"))
        scores = scores.select("pattern", "kind", F.least(F.lit(1.0), F.col("mass") / F.col("occurrences")).alias("confidence"), "support")
        scores = materialize(scores.where(F.col("confidence") >= PATTERN_CONFIDENCE / 2), "scores")
        lent = edges.where(F.col("kind").isNull()).select("pattern", "token").distinct().join(scores, "pattern")
        doubt = F.exp(F.sum(F.ln(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        unseen = lent.groupBy("token", "kind").agg((1 - doubt).alias("weight")).where(F.col("weight") >= TOKEN_CONFIDENCE)
        known = materialize(seeds.unionByName(unseen.join(seeds, ["token", "kind"], "left_anti")), "instances")
    return scores.where((F.col("confidence") >= PATTERN_CONFIDENCE) & (F.col("support") >= PATTERN_SUPPORT)).select("pattern", "kind", "confidence")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, tag (hash of the text), counts of base spans, ``base`` and ``spans``.

    ``base`` and ``spans`` are arrays of (start, kind number, end) by start, then kind; ``spans`` also has
    what the bootstrap adds.
    """
    own = docs.select(F.col(key).alias("key"), text_of(text).alias("__text"))
    own = own.withColumn("tag", F.xxhash64("__text"))
    rows = materialize(base_spans(own, "__text").drop("__text"), "base-spans")
    # contexts are read where a base match or an unseen token is; the text is read again rather than kept
    found = materialize(contexts(base_spans(own, "__text")), "contexts")
    accepted = materialize(bootstrap(found, own), "accepted")
    added = found.where(F.col("kind").isNull()).drop("kind").join(small(accepted, BROADCAST_ROWS), "pattern")
    best = added.groupBy("key", "tag", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
    best = best.select("key", "tag", F.struct("start", (-F.col("best.k")).alias("kind"), "end").alias("span"))
    best = best.groupBy("key", "tag").agg(F.collect_set("span").alias("added")).withColumnsRenamed({"key": "__key", "tag": "__tag"})
    rows = rows.withColumn("base", in_order([(i, F.col(k)) for i, k in enumerate(KINDS)]))
    rows = rows.join(best, F.col("key").eqNullSafe(F.col("__key")) & (F.col("tag") == F.col("__tag")), "left")
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.select(F.col("key").alias(key), "tag", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "base", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Spans as text: ``spans``, and the SHA-256 of the base ones."""
    return found.withColumns({"base_sha256": F.sha2(as_text(F.col("base")), 256), "spans": as_text(F.col("spans"))}).drop("base", "tag")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of their text replaced by its kind in angle brackets."""
    found = find_personal_data(docs, key, text).where(F.size("spans") > 0)
    found = materialize(found.select(F.col(key).alias("__key"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans")).distinct(), "spans")
    tag = F.xxhash64(text_of(text))
    joined = docs.join(small(found, BROADCAST_ROWS), F.col(key).eqNullSafe(F.col("__key")) & (tag == F.col("__tag")), "left")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    body = F.col(text)
    # spans overlapping the one before only prolong it
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])).alias("out"),
        )
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("__spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return joined.withColumn(text, F.when(F.col("__spans").isNotNull(), masked).otherwise(body)).select(*docs.columns)
