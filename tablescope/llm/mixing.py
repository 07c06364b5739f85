"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule takes the point frac(i * golden ratio), as an exact 32-bit fraction, through the
cumulative target shares: the source whose interval holds the point gets the slot. So every prefix of
the schedule is close to the target mix. Slots are ranked within their source, each source's documents
are shuffled by a digest of their key and cut into blocks of (nearly) equal words, and the slot of rank
r takes block r modulo the source's number of blocks, so a source is used up before it repeats.

A source that would get fewer than SLOTS_OF_SMALLEST of these slots has no interval but slots of its own:
about SLOTS_OF_SMALLEST (one a word, if its target has fewer words), each worth that part of its target, at
golden-ratio points spread over the whole schedule. So its words never depend on the size of the corpus.

Ranks and running sums are made in two levels (totals per bucket, then inside a bucket), so a source that
holds a third of all rows is never gathered in one task.

Defined results: a null text has size 0; a null source is a source of its own and sorts last; documents
of size 0 are taken 0 times; an empty table gives an empty result; repeated rows count each for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.shared import WORD, materialize, small, text_of

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used at most this many times over.
MAX_EPOCHS = 3
#: Words of a block at most, and the least number of slots; up to MOST_SLOTS are made for the smallest source to get SLOTS_OF_SMALLEST.
BLOCK_WORDS = 65_536
LEAST_SLOTS = 32_768
SLOTS_OF_SMALLEST = 64
MOST_SLOTS = 1 << 20
#: Rows of a bucket of the two-level ranks, about.
BUCKET_ROWS = 2_500
#: Source tables up to this many rows are broadcast.
BROADCAST_SOURCES = 20_000
#: Key tables of documents up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_DOCUMENTS = 500_000
#: 2^32 divided by the golden ratio, odd: i * STEP mod 2^32 are the golden-ratio points.
STEP, POINTS = 2_654_435_769, 1 << 32
#: Equal parts of the points by which slots find their source.
CELLS = 4096


def size_of(text: str | Column = "text") -> Column:
    """Number of words of the whole text."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size), one row each, with ``weight`` and ``target``.

    Targets share the total by weight; those above max_epochs times their size stop there and the rest
    is shared again. The fixed point is min(cap, level * weight); with sources sorted by cap / weight
    the level is found from running sums, without repetition.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    cases = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sources.withColumn("weight", cases.cast("double")).withColumn("__cap", F.col("source_size").cast("double") * max_epochs)
    order = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    df = df.withColumn("__level", left / F.sum("weight").over(after))
    df = df.withColumn("__open", F.col("__cap") > F.col("__level") * F.col("weight"))
    # the first source that is not capped fixes the level of all later ones
    df = df.withColumn("__level", F.min(F.when(F.col("__open"), F.struct(F.col("__cap") / F.col("weight"), "__level"))).over(whole)["__level"])
    return df.withColumn("target", F.least("__cap", F.coalesce(F.col("__level") * F.col("weight"), F.col("__cap")))).drop("__cap", "__level", "__open")


def running_total(df: DataFrame, group: list[str], order: list[str], amount: Column, name: str, buckets: Column) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows before it in its group, and the group's total as ``<name>_all``.

    ``buckets`` cuts a group along ``order`` (every row of a lower bucket comes first). Only one row
    per group and bucket meets in the window over buckets.
    """
    df = df.withColumn("__bucket", buckets).withColumn("__amount", amount)
    sums = df.groupBy(*group, "__bucket").agg(F.sum("__amount").alias("__sum"))
    over = Window.partitionBy(*group).orderBy("__bucket")
    sums = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__bucket").alias("__b"),
        (F.sum("__sum").over(over) - F.col("__sum")).alias("__offset"),
        F.sum("__sum").over(Window.partitionBy(*group)).alias(f"{name}_all"),
    )
    match = F.col("__bucket") == F.col("__b")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    df = df.join(sums, match)
    return df.withColumn(name, F.col("__offset") + F.col("__inside")).drop(
        "__bucket", "__b", "__amount", "__inside", "__offset", *[f"__g{i}" for i in range(len(group))]
    )


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """Slots 0..slots-1 with their source's number and their rank in it.

    ``shares`` has per source its number ``source_no`` and its interval [low, high) of 32-bit points.
    Points meet intervals by an equi-join on CELLS equal cells of the points; an interval has a row for
    every cell it touches, so the largest source is spread over the most cells.
    """
    width = POINTS // CELLS
    cells = shares.where("high > low").select(
        "source_no", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell")
    )
    points = shares.sparkSession.range(slots).select(
        F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(POINTS)) * F.lit(STEP), F.lit(POINTS)).alias("point")
    )
    placed = points.withColumn("cell", F.expr(f"point div {width}")).join(cells, "cell").where("point >= low and point < high")
    placed = placed.select("slot", "source_no")
    ranked = running_total(placed, ["source_no"], ["slot"], F.lit(1).cast("long"), "rank", F.expr(f"slot div {BUCKET_ROWS}"))
    return ranked.select("slot", "source_no", "rank")


def own_slots(goals: DataFrame, slots: int) -> DataFrame:
    """Slots of the sources with ``own_slots``, each at a place of a schedule of ``slots`` slots, with their source's number and rank.

    A slot stands before the schedule's slot of the same number. The points are moved by a hash of the source's number.
    """
    point = lambda i: F.pmod(i * F.lit(STEP) + F.pmod(F.xxhash64("source_no"), F.lit(POINTS)), F.lit(POINTS))
    points = F.sort_array(F.transform(F.sequence(F.lit(1).cast("long"), F.col("own_slots")), point))
    placed = goals.where("own_slots > 0").select("source_no", F.posexplode(points).alias("rank", "point"))
    return placed.select(F.floor(F.col("point") / POINTS * slots).cast("long").alias("slot"), "source_no", F.col("rank").cast("long"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "0",
) -> DataFrame:
    """One row per document: key, size, source_size, target, taken.

    ``taken`` counts the words that the blocks of the schedule take from the document, repeats included.
    """
    own = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(text).alias("size"))
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col("key").cast("string"), F.col("size").cast("string")))
    own = materialize(own.withColumn("order", F.conv(F.substring(order, 1, 15), 16, 10).cast("long")), "sizes")

    totals = materialize(own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    goals = targets(totals, weights, max_epochs)
    running = Window.orderBy(F.col("source").asc_nulls_last())
    whole = running.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goals = materialize(goals.withColumn("source_no", F.row_number().over(running)), "targets")
    total, least = goals.agg(F.sum("source_size"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    slots = max(LEAST_SLOTS, math.ceil((total or 0) / BLOCK_WORDS))
    if least:
        slots = max(slots, min(MOST_SLOTS, math.ceil(SLOTS_OF_SMALLEST * total / least)))
    slots = min(slots, max(1, total or 0))  # a slot is worth one word at least

    # sources with enough slots share the schedule, each other one has slots of its own
    goals = goals.withColumn("shares", F.col("target") * slots >= F.lit(float(SLOTS_OF_SMALLEST * (total or 0))))
    goals = goals.withColumn("shares", F.col("shares") & (F.col("target") > 0))
    shared_words = goals.agg(F.sum(F.when(F.col("shares"), F.col("target")))).first()[0] or 0.0
    slots = round(slots * shared_words / total) if shared_words else 0
    part = F.when(F.col("shares"), F.col("target")).otherwise(0.0)
    until = lambda frame: F.coalesce(F.floor(F.try_divide(F.sum(part).over(frame), F.sum(part).over(whole)) * POINTS), F.lit(0)).cast("long")
    last = F.max(F.when(F.col("shares"), F.col("source_no"))).over(whole) == F.col("source_no")
    goals = goals.withColumns(
        {
            "low": until(running.rowsBetween(Window.unboundedPreceding, -1)),
            "high": F.when(last, F.lit(POINTS)).otherwise(until(running.rowsBetween(Window.unboundedPreceding, 0))),
        }
    )
    # where rounding of the shares would leave a sliver of points to a source without one
    goals = goals.withColumn("high", F.when(F.col("shares"), F.col("high")).otherwise(F.col("low")))

    # blocks of a source: as many as its words fill at the words a slot is worth
    one = F.lit(1).cast("long")
    worth = F.when(F.col("shares"), F.lit(shared_words / max(1, slots))).otherwise(F.col("target") / SLOTS_OF_SMALLEST)
    blocks = F.greatest(one, F.round(F.try_divide(F.col("source_size"), worth)).cast("long"))
    goals = goals.withColumn("blocks", F.least(blocks, F.greatest(one, F.col("source_size"))))
    own_count = F.coalesce(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))), F.lit(0)).cast("long")
    goals = goals.withColumn("own_slots", F.when(~F.col("shares"), own_count))
    # only the blocks before the last one that any slot takes are looked at
    goals = goals.withColumn("open", F.least("blocks", F.coalesce("own_slots", "blocks")))
    goals = materialize(goals, "blocks")
    shared = small(goals.select(F.col("source").alias("__source"), "source_no", "source_size", "target", "blocks", "open", "rows"), BROADCAST_SOURCES)
    own = own.join(shared, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")

    # shuffled order of each source's documents, cut into buckets of the order
    count = F.ceil(F.col("rows") / BUCKET_ROWS)
    bucket = F.floor(F.col("order") / (F.lit(float(1 << 60)) / count)).cast("long")
    placed = running_total(own, ["source_no"], ["order", "key", "size"], F.col("size"), "start", bucket).drop("start_all")

    # slots take blocks; a block's repeats are its slots
    ranked = schedule(goals.select("source_no", "low", "high"), slots).unionByName(own_slots(goals, slots))
    block_of = small(goals.select(F.col("source_no").alias("__no"), F.col("blocks").alias("__blocks")), BROADCAST_SOURCES)
    used = (
        ranked.join(block_of, F.col("source_no") == F.col("__no"))
        .where(F.col("rank") < F.col("__blocks") * max_epochs)
        .groupBy("source_no", F.pmod("rank", "__blocks").alias("block"))
        .agg(F.count(F.lit(1)).alias("times"))
        .select(F.col("source_no").alias("__no"), F.col("block").alias("__block"), "times")
    )
    # block b of a source starts at word floor(b * source_size / blocks), written without overflow
    start_of = lambda b: F.expr(f"({b}) * (source_size div blocks) + (({b}) * (source_size % blocks)) div blocks")
    near = lambda word: F.floor(word * F.col("blocks").cast("double") / F.col("source_size")).cast("long")
    first, last_word = near(F.col("start")), near(F.col("start") + F.col("size") - 1)
    zero = F.lit(0).cast("long")
    touched = F.sequence(F.greatest(zero, first - 1), F.least(F.col("open") - 1, last_word + 1))
    reached = (F.col("size") > 0) & (F.col("start") < start_of("open"))
    pieces = placed.where(reached).withColumn("block", F.explode(touched))
    part = F.least(F.col("start") + F.col("size"), start_of("block + 1")) - F.greatest(F.col("start"), start_of("block"))
    pieces = pieces.withColumn("part", part).where("part > 0")
    pieces = pieces.join(used, (F.col("source_no") == F.col("__no")) & (F.col("block") == F.col("__block")), "left")
    taken = F.coalesce(F.sum(F.col("part") * F.col("times")), zero).alias("taken")
    whole_docs = pieces.groupBy("source_no", "start", "key", "size", "source_size", "target").agg(taken)
    rows = whole_docs.drop("source_no", "start").unionByName(placed.where(~reached).select("key", "size", "source_size", "target", zero.alias("taken")))
    return rows.withColumnRenamed("key", key)


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: taken words over own words, rounded.

    Documents of size 0 take no part in a mix of words and stay once. Rows that repeat a key share its count.
    """
    times = mix(docs, key, text, source, **how).groupBy(F.col(key).alias("__key")).agg(F.sum("size").alias("__size"), F.sum("taken").alias("__taken"))
    times = materialize(times.select("__key", F.when(F.col("__size") == 0, 1).otherwise(F.round(F.col("__taken") / F.col("__size"))).cast("int").alias("__times")), "times")
    joined = docs.join(small(times.where("__times <> 1"), BROADCAST_DOCUMENTS), F.col(key).eqNullSafe(F.col("__key")), "left")
    copies = F.explode(F.array_repeat(F.lit(1), F.coalesce("__times", F.lit(1))))
    return joined.withColumn("__copy", copies).select(*docs.columns)
