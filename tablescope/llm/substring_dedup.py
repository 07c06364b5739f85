"""Removal of word sequences that repeat anywhere in the corpus, found by fixed-block anchors.

A window of ``window`` words always holds one whole block of its own document's grid of non-overlapping
blocks of (window + 1) // 2 words. Blocks are the index; every rolling window of block length of every
document probes it. A block found at two places or more is a hit; around hits the full windows are
compared by their own hashes, so hits grow to maximal exact repeats and chance hits drop out.

The index and the probes meet by hash ranges, as packed arrays: probes carry neither document nor
position, since only the owner of a block needs the answer. A task holds the distinct block hashes of
its range and streams the probes; no group of equal rows is ever gathered, however hot a passage is.
Words and windows are compared by 64-bit hashes.

Defined results: null or blank texts have no words; documents under the window length lose nothing;
repeated documents remove each other whole where they are long enough; null keys are kept as null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import map_arrow, text_of, words_of

WINDOW = 35
#: Words handled at once in a task.
SLICE_WORDS = 2_000_000
#: Hash ranges per shuffle partition, and at least.
LEAST_RANGES = 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Stands for a null key inside the joins.
NULL_KEY = -(1 << 63)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` word hashes, one per start; run lengths double or grow by one."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    runs, size, factor = words, 1, MULTIPLIER
    with np.errstate(over="ignore"):
        for bit in bin(length)[3:]:
            runs, size, factor = runs[:-size] * factor + runs[size:], 2 * size, factor * factor
            if bit == "1":
                runs, size, factor = runs[:-1] * MULTIPLIER + words[size:], size + 1, factor * MULTIPLIER
        return mix(runs)


def inside(starts: np.ndarray, ends: np.ndarray, count: int, length: int) -> np.ndarray:
    """Start positions of windows that do not cross the end of their document."""
    ok = np.zeros(count + 1, np.int64)
    last = np.maximum(ends - length + 1, starts)
    np.add.at(ok, starts, 1)
    np.add.at(ok, last, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_WORDS words."""
    ends = np.asarray(batch.column("words").offsets)
    low = 0
    while low < len(batch):
        high = int(np.searchsorted(ends, ends[low] + SLICE_WORDS, side="right")) - 1
        high = min(max(high, low + 1), len(batch))
        yield low, high
        low = high


def flat_words(batch: pa.RecordBatch, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the rows, and where each row starts and ends."""
    column = batch.column("words")
    ends = np.asarray(column.offsets)[low : high + 1].astype(np.int64)
    words = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].view(np.uint64)
    return words, ends[:-1] - ends[0], ends[1:] - ends[0]


def by_range(hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the hashes of each hash range."""
    which = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    which = which.astype(np.uint32 if ranges > 1 << 16 else np.uint16)
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.diff(which[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(which[places[0]]), places


def pack(low_bits: np.ndarray) -> bytes:
    """Sorted differences, byte by byte: the upper bytes of all come together and compress away."""
    ordered = np.sort(low_bits)
    return np.diff(ordered, prepend=ordered[:1] * 0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    differences = np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(differences, dtype=np.uint32)


def low_half(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


INDEX, PROBE, OWNER = 0, 1, 2
PACKED = "range int, kind int, hashes binary, keys binary"


def anchors(ranges: int, block: int):
    """Documents -> per hash range the distinct blocks, all rolling probes, and the owners of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch):
                words, starts, ends = flat_words(batch, low, high)
                keys = batch.column("key").to_numpy()[low:high]
                hashes = rolling(words, block)
                if not len(hashes):
                    continue
                at = inside(starts, ends, len(words), block)
                document = np.searchsorted(starts, at, side="right") - 1
                while len(document) and (ends[document] <= at).any():  # empty documents share a start
                    document = np.where(ends[document] <= at, document + 1, document)
                grid = (at - starts[document]) % block == 0
                hashes = hashes[at]
                rows = []
                for which, places in by_range(hashes, ranges):
                    rows.append((which, PROBE, pack(low_half(hashes[places])), b""))
                own, owner = hashes[grid], keys[document[grid]]
                for which, places in by_range(own, ranges):
                    half = low_half(own[places])
                    rows.append((which, INDEX, pack(np.unique(half)), b""))
                    rows.append((which, OWNER, half.tobytes(), owner[places].tobytes()))
                yield table(rows)

    return run


def table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["range", "kind", "hashes", "keys"])


def found_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and kind -> (key, block hash) for blocks that occur at two places or more."""
    current, index, counts, pending = None, None, None, []
    for batch in batches:
        keys, hashes = [], []
        for which, kind, packed, owners in zip(*(c.to_pylist() for c in batch.columns)):
            if which != current:
                current, index, counts, pending = which, np.empty(0, np.uint32), None, []
            if kind == INDEX:
                pending.append(unpack(packed))
                if sum(map(len, pending)) > len(index) + 1_000_000:
                    index, pending = np.unique(np.concatenate([index, *pending])), []
                continue
            if counts is None:
                index, pending = np.unique(np.concatenate([index, *pending])), []
                counts = np.zeros(len(index), np.uint8)
            if not len(index):
                continue
            values = unpack(packed) if kind == PROBE else np.frombuffer(packed, np.uint32)
            place = np.minimum(np.searchsorted(index, values), len(index) - 1)
            match = index[place] == values
            if kind == PROBE:
                hit, times = np.unique(place[match], return_counts=True)
                counts[hit] = np.minimum(counts[hit].astype(np.int64) + times, 2)
            else:
                take = match & (counts[place] >= 2)
                keys.append(np.frombuffer(owners, np.int64)[take])
                hashes.append((np.uint64(which) << np.uint64(32)) + values[take].astype(np.uint64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(hashes).view(np.int64))], names=["key", "hash"])


def candidate_windows(words: np.ndarray, hits: np.ndarray, ranges: int, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of a document's windows whose first own block is a hit."""
    if len(words) < window or not len(hits):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    blocks = np.arange(0, len(words) - block + 1, block)
    grid = rolling(words, block)[blocks]
    code = ((((grid >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)) << np.uint64(32)) + (grid & np.uint64(0xFFFFFFFF))
    hit = np.isin(code.view(np.int64), hits)
    starts = np.arange(len(words) - window + 1)
    starts = starts[hit[-(-starts // block)]]
    return starts, rolling(words, window)[starts] if len(starts) else np.empty(0, np.uint64)


def windows_to_compare(ranges: int, window: int, block: int):
    """Documents with hits -> per hash range the hashes of their candidate windows with their owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            for low, high in slices(batch):
                found, owners = [], []
                for i in range(low, high):
                    words = batch.column("words")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    hashes = candidate_windows(words, hits[i].values.to_numpy(zero_copy_only=False), ranges, window, block)[1]
                    found.append(hashes)
                    owners.append(np.full(len(hashes), batch.column("key")[i].as_py(), np.int64))
                found, owners = np.concatenate(found), np.concatenate(owners)
                rows = [(which, 0, found[p].tobytes(), owners[p].tobytes()) for which, p in by_range(found, ranges)]
                yield table(rows)

    return run


def found_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range -> (key, window hash) for windows that occur a single time.

    The state of a range is its distinct hashes; a hot window is one entry.
    """
    current, hashes, owners, counts = None, None, None, None
    buffered: list[tuple[bytes, bytes]] = []

    def merge() -> None:
        nonlocal hashes, owners, counts, buffered
        new = np.concatenate([hashes, *[np.frombuffer(h, np.uint64) for h, _ in buffered]])
        own = np.concatenate([owners, *[np.frombuffer(k, np.int64) for _, k in buffered]])
        times = np.concatenate([counts, np.ones(len(new) - len(hashes), np.uint8)])
        hashes, first, back = np.unique(new, return_index=True, return_inverse=True)
        owners = own[first]
        counts = np.minimum(np.bincount(back, weights=times, minlength=len(hashes)), 2).astype(np.uint8)
        buffered = []

    def single() -> pa.RecordBatch:
        merge()
        once = counts == 1
        return pa.RecordBatch.from_arrays([pa.array(owners[once]), pa.array(hashes[once].view(np.int64))], names=["key", "hash"])

    for batch in batches:
        for which, _, packed, keys in zip(*(c.to_pylist() for c in batch.columns)):
            if which != current:
                if current is not None:
                    yield single()
                current = which
                hashes, owners, counts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
            buffered.append((packed, keys))
            if sum(len(k) for _, k in buffered) > 8 * (len(hashes) + 1_000_000):
                merge()
    if current is not None:
        yield single()


def remove_repeats(ranges: int, window: int, block: int, with_text: bool):
    """Documents with their hits and single windows -> counts and the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                text = (batch.column("text")[i].as_py() or "").encode()
                words = text.split()  # bytes.split() cuts at exactly the ASCII white space of the word definition
                kept, hits = words, batch.column("hits")[i]
                if hits.is_valid and len(words) >= window:
                    numbers = batch.column("words")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    starts, hashes = candidate_windows(numbers, hits.values.to_numpy(zero_copy_only=False), ranges, window, block)
                    single = batch.column("single")[i]
                    if single.is_valid:
                        starts = starts[~np.isin(hashes.view(np.int64), single.values.to_numpy(zero_copy_only=False))]
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[starts] += 1
                    edge[starts + window] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    if gone.any():
                        kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                out.append((batch.column("key")[i].as_py(), len(words), len(words) - len(kept), joined.decode() if with_text else hashlib.sha256(joined).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "n_words", "n_removed", "kept"])

    return run


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def remove_repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per document: key, n_words, n_removed, and ``kept`` (the kept words joined by single
    spaces) or, without ``with_text``, ``kept_sha256``."""
    spark = docs.sparkSession
    block = (window + 1) // 2
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(LEAST_RANGES, partitions)
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), text_of(text).alias("text"))
    hashed = own.select("key", word_hashes(F.col("text")).alias("words"))

    met = map_arrow(hashed, anchors(ranges, block), PACKED).repartition(partitions, "range").sortWithinPartitions("range", "kind")
    hits = map_arrow(met, found_twice, "key bigint, hash bigint").groupBy("key").agg(F.collect_set("hash").alias("hits"))

    touched = own.join(hits, "key").select("key", word_hashes(F.col("text")).alias("words"), "hits")
    compared = map_arrow(touched, windows_to_compare(ranges, window, block), PACKED)
    compared = compared.repartition(partitions, "range").sortWithinPartitions("range")
    single = map_arrow(compared, found_once, "key bigint, hash bigint").groupBy("key").agg(F.collect_list("hash").alias("single"))

    rows = own.join(hits, "key", "left").join(single, "key", "left")
    rows = rows.select("key", "text", F.when(F.col("hits").isNotNull(), word_hashes(F.col("text"))).alias("words"), "hits", "single")
    result = map_arrow(rows, remove_repeats(ranges, window, block, with_text), "key bigint, n_words bigint, n_removed bigint, kept string")
    return result.select(F.nullif("key", F.lit(NULL_KEY)).alias(key), "n_words", "n_removed", F.col("kept").alias("kept" if with_text else "kept_sha256"))
