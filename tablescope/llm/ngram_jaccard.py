"""N-gram Jaccard join by parity sketches.

A document is its set of distinct ``shingle``-word sequences. Two sets of sizes a and b with Jaccard
similarity t or more differ in at most D = (a + b) * (1 - t) / (1 + t) elements. Each element flips one
bit of a parity sketch (a bit chosen by its 64-bit hash), so sketches differ in at most D bits. Cut into
k > D blocks, at least k - D blocks of two linked documents are equal (pigeonhole), hence equal block
keys are searched for. k is fixed per size band; a document sends the keys of its own band and of the
next lower bands in which it may be the larger partner. The sketch is kept sparse: a block's key is the
XOR of the codes of its odd bits, which is equal exactly when the bits are.

Blocks with few odd bits would meet by chance or by one hot shingle. As at least k - D blocks are equal, the
k - D - 1 last ones of a document in any order that holds for all documents can be left out, and the first equal
block stays in both. The order is: strong blocks, weak blocks, empty blocks; among strong and among weak ones those
of few documents first. So a document leaves out its empty blocks, or all weak ones, before it sends its keys, and
those of most documents after the documents of a key are known. Documents of one key are joined where the Hamming distance of their whole sketches, folded to
about one bit per element, is at most D: folding cannot raise the distance either. Keys that the same
documents share are looked at once. A key with very many
documents is not gathered: its documents are joined in a chain, which only makes a family larger. A
family of joined documents is then compared as a whole, in groups of bounded size, by exact intersection
counts, so that links are complete and verified.

Defined results: a null or blank text has an empty set and links with nothing; texts with fewer words
than a shingle are one shingle; equal sets are one class of copies; rows that repeat a key are compared
each for itself, and the key stands for all of them; a null key is a key like any other, below all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.components import connected_components
from tablescope.llm.shared import ascii_lower, map_arrow, materialize, small, text_of, words_of
from tablescope.llm.substring_dedup import NULL_KEY, mix, rolling

SHINGLE, PERCENT = 4, 85
#: Upper sizes of neighbouring bands grow by this factor, about.
BAND_GROWTH = Fraction(3, 2)
#: Blocks with fewer odd bits are weak, and this share of blocks (and two more) is added to allow for them.
STRONG_BITS, SPARE_BLOCKS = 2, Fraction(1, 5)
#: Documents of one key whose sketches are compared; a larger group is linked in a chain, unseen.
KEY_DOCUMENTS = 4096
#: Rows of one key that are held to see which documents share it.
BUCKET_ROWS = 65_536
#: Stands for the power of two of a larger key's documents.
LARGE = 31
#: A group that is compared at once has at most about so many documents and shingles.
GROUP_DOCUMENTS, GROUP_SHINGLES = 512, 1_000_000
#: Key tables up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Columns of the incidence matrix handled at once.
MATRIX_COLUMNS = 4096


def bands(most: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(smallest, largest size of the smaller partner, most differing elements, blocks) per band."""
    found, low = [], 1
    while low <= most:
        high = max(low, int(low * BAND_GROWTH) - 1)
        partner = high * 100 // percent
        differ = (high + partner) * (100 - percent) // (100 + percent)
        found.append((low, high, differ, differ + 1 + 2 * (differ > 0) + int(differ * SPARE_BLOCKS)))
        low = high + 1
    return found


def band_of(size: int, percent: int) -> int:
    return next(i for i, b in enumerate(bands(size, percent)) if b[0] <= size <= b[1])


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one document's word hashes."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(rolling(words, min(shingle, len(words))))


def block_keys(elements: np.ndarray, band: int, differ: int, blocks: int) -> tuple[np.ndarray, int]:
    """Keys of the parity sketch's blocks of one set in one band, the last bit telling weak blocks, and how many of
    the strong keys (as a negative number: of the weak keys) can still be left out."""
    if not differ:  # equal sets only, which are copies
        return np.empty(0, np.uint64), 0
    seed = np.uint64(band + 1)
    with np.errstate(over="ignore"):
        codes = mix(elements + seed * np.uint64(0x9E3779B97F4A7C15))
    which = ((codes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    order = np.argsort(which, kind="stable")
    which, codes = which[order], codes[order]
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    value = np.bitwise_xor.reduceat(codes, first)
    strong = np.diff(np.append(first, len(codes))) >= STRONG_BITS
    block = which[first]
    spare = blocks - differ - 1
    weak = blocks - int(strong.sum())
    if weak > spare:  # too many weak blocks: they count as well; empty ones go first, those of the highest numbers
        empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block)
        gone = min(len(empty), spare)
        empty, spare = empty[: len(empty) - gone], gone - spare
        block, value = np.concatenate([block, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
        strong = np.concatenate([strong, np.zeros(len(empty), bool)])
    else:
        block, value, strong, spare = block[strong], value[strong], strong[strong], spare - weak
    with np.errstate(over="ignore"):
        keys = mix(value ^ mix(block * np.uint64(0xD6E8FEB86659FD93) + seed))
    return keys >> np.uint64(1) << np.uint64(1) | (~strong).astype(np.uint64), spare


def folded_sketch(elements: np.ndarray, high: int) -> bytes:
    """The parity sketch of a set folded to the bits of its band."""
    bits = 64 * -(-high // 64)
    odd = np.bincount((mix(elements) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def in_bands(elements: np.ndarray, percent: int, known: list[tuple[int, int, int, int]]) -> list[tuple[int, int, bytes, np.ndarray, int]]:
    """(band, most differing elements, folded sketch, keys, spare keys) in all bands in which a document can have a
    partner; its own band comes last."""
    size, found = len(elements), []
    for i, (low, high, differ, blocks) in enumerate(known):
        if low > size:
            break
        if size * percent <= high * 100:  # own band, or a lower one whose largest sets it can join
            found.append((i, differ, folded_sketch(elements, high), *block_keys(elements, i, differ, blocks)))
    return found or [(-1, 0, b"", np.empty(0, np.uint64), 0)]


SKETCH = "key bigint, size bigint, digest binary, own boolean, band int, differ int, sketch binary, spare int, keys array<bigint>"


def sketches(shingle: int, percent: int):
    """Documents -> a row per band; ``own`` marks one row of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[int, int, int, int]] = []
        for batch in (whole.slice(low, 1000) for whole in batches for low in range(0, len(whole), 1000)):
            rows = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                words = batch.column("words")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                elements = shingle_set(words, shingle)
                if len(elements) and (not known or known[-1][1] < len(elements)):
                    known = bands(2 * len(elements), percent)
                found, digest = in_bands(elements, percent, known), elements_digest(elements)
                for n, (band, differ, sketch, keys, spare) in enumerate(found):
                    rows.append((key, len(elements), digest, n == len(found) - 1, band, differ, sketch, spare, keys.view(np.int64)))
            if rows:
                *plain, keys = zip(*rows)
                lengths = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                types = [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
                columns = [*(pa.array(c, t) for c, t in zip(plain, types)), pa.ListArray.from_arrays(lengths, np.concatenate(keys))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "digest", "own", "band", "differ", "sketch", "spare", "keys"])

    return run


def elements_digest(elements: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def buckets(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (hash, key, band) sorted by hash, no hash cut -> (bucket, key, band) of the hashes of several rows.

    The bucket is a hash of all documents that share the key, so hashes shared by the same documents are one bucket.
    Buckets are ordered by their number of documents, in powers of two; the last bit still tells weak blocks.
    """
    hashes, keys, band = (c.to_numpy(zero_copy_only=False) for c in rows.columns)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    count = np.diff(np.append(first, len(hashes)))
    bucket = mix(np.add.reduceat(mix(keys.view(np.uint64)), first) ^ mix(band[first].astype(np.uint64) + np.uint64(1)))
    bucket = ordered(bucket, np.log2(count).astype(np.uint64), hashes[first])
    made = pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, count).view(np.int64)), *rows.columns[1:]], names=["bucket", "key", "band"])
    return made.filter(pa.array(np.repeat(count > 1, count)))


def ordered(bucket: np.ndarray, power: np.ndarray | int, hashes: np.ndarray) -> np.ndarray:
    """Non-negative numbers that sort by ``power``, ending in the last bit of the hashes."""
    return np.uint64(power) << np.uint64(58) | bucket >> np.uint64(7) << np.uint64(1) | hashes.view(np.uint64) & np.uint64(1)


def bucket_of_its_own(rows: pa.RecordBatch) -> pa.RecordBatch:
    hashes = rows.column(0).to_numpy(zero_copy_only=False)
    bucket = ordered(mix(hashes.view(np.uint64)), LARGE, hashes)
    return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), *rows.columns[1:]], names=["bucket", "key", "band"])


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash -> the buckets of hashes that several rows have; a hash of very many rows is a bucket of its own."""
    held, large = None, None  # the rows of the last hash wait for the next batch, unless they are too many
    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(rows):
            continue
        hashes = rows.column(0).to_numpy(zero_copy_only=False)
        begin = int(np.count_nonzero(hashes == large)) if large is not None else 0
        end = max(begin, len(hashes) - int(np.count_nonzero(hashes == hashes[-1])))
        if begin:
            yield bucket_of_its_own(rows.slice(0, begin))
        if end > begin:
            yield buckets(rows.slice(begin, end - begin))
        held = rows.slice(end) if end < len(rows) else None
        if held is not None and len(held) > BUCKET_ROWS:
            yield bucket_of_its_own(held)
            held, large = None, hashes[-1]
    if held is not None:
        yield buckets(held)


def joined(sketches: np.ndarray, differ: int) -> np.ndarray:
    """The first document of each document's group, groups being joined by sketches of at most ``differ`` bits apart.

    All documents near the first one hang on it; only the others are compared with everybody.
    """
    distance = lambda i: np.bitwise_count(sketches ^ sketches[i]).sum(axis=1)
    near = distance(0) <= differ
    label = np.where(near, 0, np.arange(len(sketches)))
    for i in np.flatnonzero(~near):
        met = np.unique(label[distance(i) <= differ])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return label


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, key, differ, sketch) sorted by bucket -> links of documents that may be similar."""
    current, keys, rows, chained = None, [], [], None

    def links(differ: int) -> np.ndarray:
        own = np.array(keys)
        if len(own) < 2:
            return np.empty((0, 2), np.int64)
        bits = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)
        first = joined(bits, differ)
        far = first != np.arange(len(own))
        return np.stack([own[far], own[first[far]]], 1)

    def packed(out: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    differ_before = 0
    for batch in batches:
        out = []
        for bucket, key, differ, sketch in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != current:
                out.append(links(differ_before))
                current, keys, rows, chained, differ_before = bucket, [], [], None, differ
            if chained is not None:
                out.append(np.array([[chained, key]]))
                chained = key
                continue
            keys.append(key)
            rows.append(sketch)
            if len(keys) > KEY_DOCUMENTS:
                out.append(np.stack([keys[:-1], keys[1:]], 1))
                chained, keys, rows = key, [], []
        yield packed(out)
    yield packed([links(differ_before)])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all sets of ``left`` with all of ``right``."""
    total = np.zeros((len(left), len(right)), np.int64)
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1  # elements of one set only cannot be in an intersection
    number, owner = number[shared], owner[shared]
    if not len(number):
        return total
    number = np.unique(number, return_inverse=True)[1]
    for low in range(0, int(number[-1]) + 1, MATRIX_COLUMNS):
        a, b = np.searchsorted(number, [low, low + MATRIX_COLUMNS])
        matrix = np.zeros((len(left) + len(right), MATRIX_COLUMNS), np.float32)
        matrix[owner[a:b], number[a:b] - low] = 1
        total += (matrix[: len(left)] @ matrix[len(left) :].T).astype(np.int64)
    return total


def roots(count: int, links: np.ndarray) -> np.ndarray:
    """Smallest index reachable by links, per index."""
    label = np.arange(count)
    while True:
        before = label.copy()
        np.minimum.at(label, links[:, 0], label[links[:, 1]])
        np.minimum.at(label, links[:, 1], label[links[:, 0]])
        label = label[label]
        if (label == before).all():
            return label


def compare_groups(percent: int):
    """Rows sorted by group -> per document its linked documents and one link to its local root."""

    def compare(rows: list[tuple], pair: bool) -> list[tuple[int, int, int]]:
        rows.sort(key=lambda r: r[0])
        across = len({r[3] for r in rows}) > 1
        if pair and not across:  # two parts, one of them empty
            return []
        sides = [[r for r in rows if r[3] == side] for side in sorted({r[3] for r in rows})]
        left, right = (sides[0], sides[1]) if across else (rows, rows)
        meet = intersections([r[1] for r in left], [r[1] for r in right])
        sizes = [np.array([len(r[1]) for r in side]) for side in (left, right)]
        union = sizes[0][:, None] + sizes[1][None, :] - meet
        linked = (100 * meet >= percent * union) & (meet > 0)
        keys = np.array([r[0] for r in left] + ([r[0] for r in right] if across else []))
        copies = [np.array([r[2] for r in side]) for side in (left, right)]
        if across:
            counts = np.concatenate([linked @ copies[1], linked.T @ copies[0]])
            pairs = np.argwhere(linked) + [0, len(left)]
        else:
            np.fill_diagonal(linked, False)
            counts = linked @ copies[1]
            pairs = np.argwhere(np.triu(linked))
        order = np.argsort(keys, kind="stable")  # roots are then the smallest keys
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        root = keys[order][roots(len(keys), place[pairs])] if len(pairs) else keys[order]
        return [(int(k), int(r), int(n)) for k, r, n in zip(keys[order], root, counts[order])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, out = None, [], []
        names = ["key", "root", "links"]

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names=names)

        for batch in batches:
            groups, sides = batch.column("group").to_pylist(), batch.column("side").to_pylist()
            for i, (group, side) in enumerate(zip(groups, sides)):
                if group != current:
                    if len(rows) > 1:
                        out += compare(rows, current["i"] != current["j"])
                    current, rows = group, []
                words = batch.column("words")[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                rows.append((batch.column("key")[i].as_py(), shingle_set(words, batch.column("shingle")[i].as_py()), batch.column("copies")[i].as_py(), side))
            if len(out) > 10_000:
                yield packed()
                out = []
        if len(rows) > 1:
            out += compare(rows, current["i"] != current["j"])
        yield packed()

    return run


def without_spare(met: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (bucket, key, band, hashes) without the buckets of most documents that a document in a band can leave out."""
    weak = F.col("bucket").bitwiseAND(F.lit(1).cast("bigint"))
    known = met.join(rows.select("key", "band", "spare").hint("merge"), ["key", "band"])
    # the hashes of this bucket and of those that come after it; those left out already come after all
    behind = F.sum("hashes").over(Window.partitionBy("key", "band").orderBy(weak.desc(), F.col("bucket").desc()))
    most = F.greatest(F.when(weak == 1, -F.col("spare")).otherwise(F.col("spare")), F.lit(0))
    return known.withColumn("behind", behind).where(F.col("behind") > most).select("bucket", "key", "band")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links), n_links."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashes = F.transform(words_of(ascii_lower(F.col("text"))), lambda w: F.xxhash64(w))
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), text_of(text).alias("text"))

    found = materialize(map_arrow(own.select("key", hashes.alias("words")), sketches(shingle, percent), SKETCH), "sketches")
    each = found.where("own").select("key", "size", "digest")
    classes = materialize(
        each.groupBy("size", "digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    firsts = classes.where("size > 0").select(F.col("first").alias("key"))

    # one document of each class sends its keys; the others are few, as a rule
    same_class = (F.col("size") == F.col("__size")) & (F.col("digest") == F.col("__digest"))
    first_of = classes.select(F.col("size").alias("__size"), F.col("digest").alias("__digest"), "first")
    copies = each.join(first_of, same_class).where("key <> first").select("key").distinct()
    copies = materialize(copies.join(firsts, "key", "left_anti"), "copies")
    rows = found.where("size > 0").join(small(copies, BROADCAST_ROWS), "key", "left_anti")
    sent = rows.select(F.explode("keys").alias("hash"), "key", "band").repartition(partitions, "hash").sortWithinPartitions("hash")
    met = map_arrow(sent, shared, "bucket bigint, key bigint, band int").groupBy("bucket", "key", "band").agg(F.count(F.lit(1)).alias("hashes"))
    met = materialize(without_spare(met, rows), "shared-keys")
    # shuffled at every size: the sketches grow with the documents
    met = met.join(rows.select("key", "band", "differ", "sketch").hint("merge"), ["key", "band"]).select("bucket", "key", "differ", "sketch")
    met = met.repartition(partitions, "bucket").sortWithinPartitions("bucket", "key")
    candidates = map_arrow(met, meet, "a bigint, b bigint")
    families = materialize(connected_components(candidates), "families")

    # groups of a family that are compared: one, or pairs of parts where it is large
    members = families.join(classes.where("size > 0").withColumnRenamed("first", "node"), "node")
    members = members.select(F.col("node").alias("key"), F.col("component").alias("family"), "size", "copies")
    parts = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_DOCUMENTS), F.ceil(F.sum("size") / GROUP_SHINGLES)).cast("int").alias("parts")
    )
    placed = members.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.withColumn("other", other).withColumn("group", F.struct("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")))
    placed = placed.select("key", F.col("part").alias("side"), "copies", "group")

    placed = small(materialize(placed, "groups"), BROADCAST_ROWS)
    grouped = own.join(placed, "key").select("group", "side", "key", "copies", hashes.alias("words"), F.lit(shingle).alias("shingle"))
    grouped = grouped.repartition(partitions, "group").sortWithinPartitions("group")
    compared = materialize(map_arrow(grouped, compare_groups(percent), "key bigint, root bigint, links bigint"), "links")

    linked = connected_components(compared.select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = linked.select(F.col("node").alias("first"), "component")
    links = compared.groupBy(F.col("key").alias("first")).agg(F.sum("links").alias("links"))
    known = classes.join(linked, "first", "left").join(links, "first", "left")
    known = known.select(F.col("size").alias("__size"), F.col("digest").alias("__digest"), "copies", "component", "links", "first")
    joined = each.join(known, (F.col("size") == F.col("__size")) & (F.col("digest") == F.col("__digest")))
    empty = F.col("size") == 0
    null = F.nullif(F.when(empty, F.col("key")).otherwise(F.coalesce("component", "first")), F.lit(NULL_KEY))
    n_links = F.when(empty, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return joined.select(
        F.nullif("key", F.lit(NULL_KEY)).alias(key), F.col("size").alias("n_shingles"), null.alias("component_id"), n_links.cast("long").alias("n_links")
    )


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group of linked documents, the one of smallest key.

    Of rows that repeat a key one stays, the one of the smallest text.
    """
    groups = materialize(jaccard_join(docs, key, text, shingle, percent).select(F.col(key).alias("__key"), "component_id"), "near-groups")
    gone = groups.where(~F.col("__key").eqNullSafe(F.col("component_id"))).select("__key").distinct()
    match = F.col(key).eqNullSafe(F.col("__key"))
    kept = docs.join(small(gone, BROADCAST_ROWS), match, "left_anti")
    repeated = materialize(groups.groupBy("__key").count().where("count > 1").select("__key"), "repeated-keys")
    if repeated.isEmpty():
        return kept
    many = kept.join(small(repeated, BROADCAST_ROWS), match, "left_semi")
    order = F.struct(text_of(text), *[c for c in docs.columns if c not in (key, text)])
    row = F.struct(*map(F.col, docs.columns))
    one = many.groupBy(F.col(key).alias("__group")).agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return kept.join(small(repeated, BROADCAST_ROWS), match, "left_anti").unionByName(one)
