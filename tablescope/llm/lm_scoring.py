"""Language-model scores: unigram words as the base, and a lattice of subwords and whole words as the model.

The model is a unigram over units: the pieces of an existing subword vocabulary, every word of the training
texts as a whole, and the end of a text. A word's probability is the sum over all its segmentations into
units, found by the forward recursion; a text's is the product over its words and one end. A training word
seen c times has the weight c - D as a whole, D the absolute discount n1 / (n1 + 2 n2) of words seen once
and twice; what is taken off pays for spelling, so each distinct word counts D times in the estimate of the
pieces. No unigram vocabulary is installed; the file used is a BPE vocabulary whose scores are merge ranks,
so they only start the estimate, and expectation maximisation over all segmentations of all distinct
training words replaces them. Characters without a piece go through the vocabulary's byte pieces.

Everything is computed once per distinct word. The arcs of a word's lattice are built once, as numbers of
its pieces, and written with it; passes and scores then work on the arcs of many words at a time. Words
longer than LONGEST, or with characters of several bytes that have no piece, go through the same recursion
in log space one by one. The most frequent words, a bounded number, are sent to all tasks; the others meet
their documents in a shuffled join, where no key is hot.

Defined results: a null or blank text has the end as its only token; a null key counts as the empty text
for the split; repeated rows each get their own result; without training documents every count is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import map_arrow, materialize
from tablescope.llm.tokenizer_files import vocabulary

VOCABULARY = "piece_bpe_32k.model"
PASSES = 4
SMOOTHING = 0.1
HOLDOUT, PARTS = 0, 10
#: Words sent to all tasks, at most.
FREQUENT_WORDS = 262_144
#: Longest word, its start included, whose arcs are numbers; no product of so many pieces leaves the doubles.
LONGEST = 20
#: A task's word counts are passed on when it holds this many.
COUNTER_WORDS = 1_000_000
#: Expected counts are summed as whole numbers of this fraction, so the order of tasks doesn't matter.
GRAIN = 1 << 16
WORD_START = "▁"
LN10 = math.log(10)


def words_in(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes know ASCII only, which is the word definition's alphabet."""
    return (text or "").encode().lower().split()


def piece_scores(name: str = VOCABULARY) -> tuple[dict[str, float], list[float]]:
    """Starting log probabilities of pieces (without an inner word start) and of the 256 bytes, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
    pieces, single = {}, [0.0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            single[int(piece[3:5], 16)] = 1.0 / model.get_piece_size()
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and WORD_START not in piece[1:]:
            pieces[piece] = 1.0 / (1.0 - model.get_score(i))
    total = sum(pieces.values()) + sum(single)
    return {p: math.log(v / total) for p, v in pieces.items()}, [math.log(max(v, 1e-12) / total) for v in single]


class Lattice:
    """All segmentations of a word, weighted by log probabilities of pieces and bytes."""

    def __init__(self, pieces: dict[str, float], single: list[float]):
        self.pieces, self.single = pieces, single
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p) + 1)}

    def arcs(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, log probability), by start; a character without a piece is its bytes."""
        found, n = [], len(text)
        for i in range(n):
            alone = True
            for j in range(i + 1, n + 1):
                part = text[i:j]
                if part not in self.prefixes:
                    break
                score = self.pieces.get(part)
                if score is not None:
                    found.append((i, j, score))
                    alone = alone and j > i + 1
            if alone:
                found.append((i, i + 1, sum(self.single[b] for b in text[i].encode())))
        return found

    @staticmethod
    def forward(arcs: list[tuple[int, int, float]], n: int) -> list[float]:
        exp, log1p, low = math.exp, math.log1p, -math.inf
        total = [low] * (n + 1)
        total[0] = 0.0
        for i, j, score in arcs:
            a, b = total[i] + score, total[j]
            if a < b:
                a, b = b, a
            total[j] = a if b == low else a + log1p(exp(b - a))
        return total

    def log_probability(self, word: bytes) -> float:
        """Marginal natural-log probability of the word over all segmentations."""
        text = WORD_START + word.decode(errors="surrogateescape")
        return self.forward(self.arcs(text), len(text))[-1]

    def expected(self, word: bytes) -> Iterator[tuple[str | int, float]]:
        """(piece or byte, expected occurrences) over all segmentations."""
        text = WORD_START + word.decode(errors="surrogateescape")
        n, arcs = len(text), self.arcs(text)
        ahead = self.forward(arcs, n)
        back = self.forward([(n - j, n - i, score) for i, j, score in reversed(sorted(arcs, key=lambda a: a[1]))], n)
        for i, j, score in arcs:
            share = math.exp(ahead[i] + score + back[n - j] - ahead[n])
            if text[i:j] in self.pieces:
                yield text[i:j], share
            else:
                for b in text[i:j].encode():
                    yield b, share


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(train, text) -> (word, times in training texts); words of other texts come with 0."""
    counts: Counter = Counter()
    seen: set[bytes] = set()

    def packed() -> pa.RecordBatch:
        seen.difference_update(counts)
        words, times = [*counts, *seen], [*counts.values(), *[0] * len(seen)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"])

    for batch in batches:
        for train, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            (counts.update if train else seen.update)(words_in(text.as_py()))
            if len(counts) + len(seen) > COUNTER_WORDS:
                yield packed()
                counts.clear(), seen.clear()
    yield packed()


def number_arcs(parameters):
    """(word, times) -> (word, times, n, arcs): characters and arcs of the word's lattice, null where it goes one by one.

    An arc is the number of its piece (bytes follow the pieces) * 32 + its start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, single = parameters.value
        lattice = Lattice(pieces, single)
        number = {p: k << 5 for k, p in enumerate(pieces)}
        prefixes, first_byte = lattice.prefixes, len(pieces)
        for batch in batches:
            sizes, found = [], []
            for word in batch.column(0).to_pylist():
                text = WORD_START + word.decode(errors="surrogateescape")
                n = len(text)
                arcs: list[int] | None = [] if n <= LONGEST else None
                for i in range(n) if arcs is not None else ():
                    alone = True
                    for j in range(i + 1, n + 1):
                        part = text[i:j]
                        if part not in prefixes:
                            break
                        own = number.get(part)
                        if own is not None:
                            arcs.append(own + i)
                            alone = alone and j > i + 1
                    if alone:
                        spelled = text[i].encode(errors="surrogateescape")
                        if len(spelled) > 1:
                            arcs = None
                            break
                        arcs.append((first_byte + spelled[0] << 5) + i)
                sizes.append(n)
                found.append(arcs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["word", "times", "n", "arcs"])

    return run


class Arcs:
    """The arcs of many words: for each its word, start, end and unit."""

    def __init__(self, batch: pa.RecordBatch, lengths: np.ndarray):
        column = batch.column(batch.schema.get_field_index("arcs"))
        n = batch.column(batch.schema.get_field_index("n")).to_numpy()
        counts = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
        codes = column.flatten().to_numpy().astype(np.int64)
        self.words, self.n = len(batch), n
        self.word = np.repeat(np.arange(self.words), counts)
        self.unit, self.start = codes >> 5, codes & 31
        self.end = self.start + lengths[self.unit]
        self.single = np.flatnonzero(counts == 0)  # go one by one
        self.by_end = np.argsort(self.end, kind="stable")
        self.ends = np.searchsorted(self.end[self.by_end], np.arange(LONGEST + 2))
        self.by_start = np.argsort(self.start, kind="stable")
        self.starts = np.searchsorted(self.start[self.by_start], np.arange(LONGEST + 2))

    def ahead(self, weight: np.ndarray) -> np.ndarray:
        """(words, places): probability of all ways from the start to each place; ``weight`` per arc."""
        out = np.zeros((self.words, LONGEST + 2))
        out[:, 0] = 1
        for place in range(1, LONGEST + 1):
            at = self.by_end[self.ends[place] : self.ends[place + 1]]
            out[:, place] = np.bincount(self.word[at], out[self.word[at], self.start[at]] * weight[at], minlength=self.words)
        return out

    def behind(self, weight: np.ndarray) -> np.ndarray:
        """(words, places): probability of all ways from each place to the end of the word."""
        out = np.zeros((self.words, LONGEST + 2))
        short = self.n <= LONGEST
        out[np.flatnonzero(short), self.n[short]] = 1
        for place in range(LONGEST - 1, -1, -1):
            at = self.by_start[self.starts[place] : self.starts[place + 1]]
            out[:, place] += np.bincount(self.word[at], out[self.word[at], self.end[at]] * weight[at], minlength=self.words)
        return out


def unit_table(pieces: dict[str, float], single: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Probability and length of every unit: pieces in their order, then bytes."""
    weights = np.exp(np.array([*pieces.values(), *single]))
    return weights, np.array([*map(len, pieces), *[1] * len(single)])


def expected_counts(parameters):
    """Distinct words with arcs -> (unit, expected occurrences in GRAINs), each word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, single = parameters.value
        weights, lengths = unit_table(pieces, single)
        lattice = None
        total, number = np.zeros(len(weights), np.int64), None
        for batch in batches:
            arcs = Arcs(batch, lengths)
            weight = weights[arcs.unit]
            ahead, behind = arcs.ahead(weight), arcs.behind(weight)
            whole = ahead[np.arange(arcs.words), np.minimum(arcs.n, LONGEST)]
            share = ahead[arcs.word, arcs.start] * weight * behind[arcs.word, arcs.end] / whole[arcs.word]
            np.add.at(total, arcs.unit, np.floor(share * GRAIN + 0.5).astype(np.int64))
            if len(arcs.single):
                lattice = lattice or Lattice(pieces, single)
                number = number or {p: k for k, p in enumerate(pieces)}
                for word in batch.column(0).take(pa.array(arcs.single)).to_pylist():
                    for piece, share in lattice.expected(word):
                        total[number[piece] if isinstance(piece, str) else len(number) + piece] += int(share * GRAIN + 0.5)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["unit", "grains"])

    return run


def estimate(words: DataFrame, ends: int, whole: float, discount: float, passes: int = PASSES) -> tuple[dict[str, float], list[float], float, float]:
    """Log probabilities of pieces, bytes and the end after ``passes`` passes, and the sum that counts are shares of.

    ``whole`` is the count that whole words keep, ``discount`` what each distinct word counts in the pieces.
    """
    pieces, single = piece_scores()
    end, total = 0.0, 1.0
    context = words.sparkSession.sparkContext
    for _ in range(passes):
        parameters = context.broadcast((pieces, single))
        rows = map_arrow(words.where("times > 0").select("word", "n", "arcs"), expected_counts(parameters), "unit int, grains bigint")
        counts = np.zeros(len(pieces) + len(single))
        for r in rows.groupBy("unit").agg(F.sum(F.col("grains").cast("decimal(38,0)")).alias("grains")).collect():
            counts[r.unit] = int(r.grains) / GRAIN * discount
        parameters.unpersist()
        total = float(counts.sum()) + whole + ends + SMOOTHING * (len(counts) + 1)
        logs = np.log((counts + SMOOTHING) / total).tolist()
        pieces, single = dict(zip(pieces, logs)), logs[len(pieces) :]
        end = math.log((ends + SMOOTHING) / total)
    return pieces, single, end, total


def score_words(parameters, discount: float, total: float):
    """Distinct words with arcs -> (word, times, log10 of the word's probability over all segmentations)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, single = parameters.value
        weights, lengths = unit_table(pieces, single)
        lattice = None
        for batch in batches:
            arcs = Arcs(batch, lengths)
            whole = arcs.ahead(weights[arcs.unit])[np.arange(arcs.words), np.minimum(arcs.n, LONGEST)]
            with np.errstate(divide="ignore"):
                spelled = np.log(whole)
            if len(arcs.single):
                lattice = lattice or Lattice(pieces, single)
                spelled[arcs.single] = [lattice.log_probability(w) for w in batch.column(0).take(pa.array(arcs.single)).to_pylist()]
            times = batch.column(1).to_numpy()
            with np.errstate(divide="ignore"):
                own = np.log(np.where(times > 0, times - discount, 0) / total)
            scores = np.logaddexp(own, spelled) / LN10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["word", "times", "lattice"])

    return run


def look_up(frequent):
    """Documents -> one row with the sums over frequent words, and a row for each other distinct word.

    The first row carries a word with a space, which no real word has, so that the join deals it out evenly.
    """
    names = ["key", "tag", "held_out", "word", "rows", "n", "base", "known", "lattice"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            out: list[tuple] = []
            for key, tag, held_out, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                words = words_in(text.as_py())
                base, hits, lattice, rest = 0.0, 0, 0.0, []
                for word, n in Counter(words).items():
                    entry = known.get(word)
                    if entry is None:
                        rest.append((key, tag, held_out, word, 0, n, 0.0, 0, 0.0))
                    else:
                        base += n * entry[0]
                        hits += n
                        lattice += n * entry[1]
                own = len(words) - sum(r[5] for r in rest)
                out.append((key, tag, held_out, f" {key} {tag}".encode(), 1, own, base, hits, lattice))
                out += rest
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def frequent_from(words: DataFrame, most: int) -> int:
    """Least power of two that at most ``most`` words are counted at."""
    sizes = words.where("times > 0").groupBy(F.floor(F.log2("times")).cast("int").alias("power")).count().collect()
    held, power = 0, max([r.power for r in sizes], default=0) + 1
    for row in sorted(sizes, key=lambda r: -r.power):
        held += row["count"]
        if held > most:
            break
        power = row.power
    return 1 << power


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", passes: int = PASSES, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    part = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(PARTS))
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"), (part == HOLDOUT).alias("held_out"), F.col(text).alias("text"))

    counted = map_arrow(own.select((~F.col("held_out")).alias("train"), "text"), count_words, "word binary, times bigint")
    words = counted.groupBy("word").agg(F.sum("times").alias("times"))
    start = spark.sparkContext.broadcast(piece_scores())
    words = materialize(map_arrow(words, number_arcs(start), "word binary, times bigint, n int, arcs array<int>"), "words")
    ends = own.where(~F.col("held_out")).count()
    said, seen, once, twice = words.agg(F.coalesce(F.sum("times"), F.lit(0)), *[F.count_if(c) for c in (F.col("times") > 0, F.col("times") == 1, F.col("times") == 2)]).first()
    tokens, distinct = said + ends, seen + (ends > 0)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
    below = math.log10(tokens + SMOOTHING * (distinct + 1))

    pieces, single, end, total = estimate(words, ends, said - discount * seen, discount, passes)
    parameters = spark.sparkContext.broadcast((pieces, single))
    scored = materialize(map_arrow(words, score_words(parameters, discount, total), "word binary, times bigint, lattice double"), "scored-words")
    scored = scored.withColumn("base", F.log10(F.col("times") + SMOOTHING) - below)
    least = frequent_from(scored, frequent_words)
    table = {bytes(r.word): (r.base, r.lattice) for r in scored.where(F.col("times") >= least).select("word", "base", "lattice").toLocalIterator()}
    frequent = spark.sparkContext.broadcast(table)

    fields = "key bigint, tag bigint, held_out boolean, word binary, rows bigint, n bigint, base double, known bigint, lattice double"
    rows = map_arrow(own, look_up(frequent), fields)
    rare = scored.where(F.col("times") < least).select(F.col("word").alias("w"), (F.col("times") > 0).alias("is_known"), F.col("base").alias("b"), F.col("lattice").alias("l"))
    rows = rows.join(rare, F.col("word") == F.col("w"), "left")
    found = lambda value: F.coalesce(F.col("n") * value, F.lit(0.0))
    sums = rows.groupBy("key", "tag", "held_out").agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.sum(F.col("known") + F.when(F.col("is_known"), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + found(F.col("b"))).alias("base"),
        F.sum(F.col("lattice") + found(F.col("l"))).alias("lattice"),
    )
    # repeated rows were summed together; each gets its share back
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    end_base = math.log10(ends + SMOOTHING) - below
    return sums.select(
        F.col("key").alias(key),
        "held_out",
        (F.expr("n div rows") + 1).alias("n_tokens"),
        (F.expr("known div rows") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") + end_base).alias("base_score"),
        (F.col("lattice") / F.col("rows") + end / LN10).alias("score"),
    )
