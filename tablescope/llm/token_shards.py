"""Token ids as binary shards with one shared zstandard dictionary.

A dictionary is trained on the serialized id arrays of a bounded sample of short documents. Documents
are written in ascending key order; each is one zstandard frame of its ids (little-endian unsigned 16 or
32 bit), so any document can be read alone. A shard file is

    magic, SHA-256 of the dictionary, bytes of an id | frames | index | place of the index, magic

and its index holds, per document, key, number of ids and end of its frame. The dictionary is a file of
its own, named by its digest. A shard gets a new name in every attempt of its task, and the manifest, a
Parquet table, names the files that count: a lost or repeated task leaves at most a file nobody reads.

Defined results: a null text is the empty text, whose only id is the end id; null keys sort first;
repeated keys are written one after the other, ordered by their text; an empty table gives an empty
manifest; the special token's string in a text becomes its id, as the vocabulary file asks.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.llm.bpe_codec import LETTER, NUMBER, SIMPLE, byte_letters
from tablescope.llm.shared import map_arrow, materialize, text_of
from tablescope.llm.tokenizer_files import Cache, vocabulary

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: The dictionary is trained on at most this many documents of at most so many characters.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 2_000, 4_096
DICTIONARY_BYTES = 65_536
LEVEL = 3
MAGIC = b"TOKSHRD1"
HEADER, FOOTER = "<8s32sB", "<Q8s"
HEADER_BYTES, FOOTER_BYTES = struct.calcsize(HEADER), struct.calcsize(FOOTER)
INDEX = np.dtype([("null", "u1"), ("key", "<i8"), ("ids", "<u8"), ("end", "<u8")])

#: Texts with other white space than single spaces and line breaks between words, which are encoded whole.
IRREGULAR = r"^[ \n]|[ \n][ \n]| $|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text handled at once in a task.
SLICE_BYTES = 6_000_000
#: The vocabulary's own pattern for chunks of simple characters, whose classes are stated.
PIECE = re.compile(f"\\n|'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each chunk or piece once per cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.irregular = "|".join([IRREGULAR, *map(re.escape, self.specials)])
        self.letters = byte_letters()
        size = self.tokenizer.get_vocab_size()
        self.serial = [i.to_bytes(self.type.itemsize, "little") for i in range(size)]
        self.pieces = Cache(self._encode_pieces)
        self.chunks = Cache(self._encode_chunks)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """A chunk is a line break and what follows it, or what follows a space (left out)."""
        texts = [c if c[0] == "\n" else f" {c}" for c in chunks]
        split = [self.split_chunk(c, t) for c, t in zip(chunks, texts)]
        ids = iter(self.pieces.of([piece for pieces in split if pieces for piece in pieces]))
        return [self._encode(t) if pieces is None else b"".join([next(ids) for _ in pieces]) for t, pieces in zip(texts, split)]

    @staticmethod
    def split_chunk(chunk: str, text: str) -> list[str] | None:
        """What the pre-tokenizer makes of it, or None where the classes of its characters aren't stated here."""
        if not chunk.isascii() and not SIMPLE.fullmatch(chunk):
            return None
        return [text] if chunk.isalpha() else PIECE.findall(text)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces that the pre-tokenizer leaves whole, straight through the library's model."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        words = [p.replace(" ", letters[32]) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters) for p in pieces]
        serial = self.serial
        return [b"".join([serial[t.id] for t in tokenize(w)]) for w in words]

    def encode(self, text: str | None) -> bytes:
        """Serialized ids of the text, without the end id."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Serialized ids of each text. Equal chunks of all texts are looked up once.

        Every space and line break of a regular text starts a token, so what follows each is a chunk of
        its own; a line break is put before the text and its id taken off again.
        """
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, self.irregular)).to_numpy(zero_copy_only=False)
        chunks = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n"), " ")
        coded = chunks.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = iter(self.chunks.of([c for c in known if c]))
        found = [next(found) if c else b"" for c in known]
        ends = np.cumsum([0, *map(len, found)]) // self.type.itemsize
        per_chunk = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.frombuffer(b"".join(found), self.type))
        taken = per_chunk.take(coded.indices)
        ids = taken.values.to_numpy()
        cuts = np.asarray(taken.offsets)[np.asarray(chunks.offsets) - chunks.offsets[0].as_py()]
        out = []
        for i, (start, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if whole[i]:
                text = texts[i].as_py()
                out.append(self._encode(text) if text else b"")
            else:
                out.append(ids[start + 1 : end].tobytes())
        return out


def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a URI or an absolute path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def read_bytes(path: str, name: str) -> bytes:
    system, folder = open_folder(path)
    with system.open_input_stream(f"{folder}/{name}") as file:
        return file.read()


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES bytes of text, so that very long texts stay apart."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(batch):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(low, high - low)
        low = high


def train_dictionary(docs: DataFrame, text: str, name: str = VOCABULARY) -> bytes:
    """Dictionary bytes from a bounded sample, the first short documents; it decides sizes, never contents."""
    import zstandard

    short = docs.select(F.col(text).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    rows = short.limit(SAMPLE_DOCUMENTS).collect()
    own = encoder(vocabulary(name))
    samples = [own.encode(r.text) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their ids themselves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write all documents below ``path``; returns the manifest, one row per shard in key order.

    Columns: shard, file, documents, ids, start (ids of all shards before it).
    """
    import zstandard

    spark = docs.sparkSession
    dictionary = train_dictionary(docs, text, name)
    digest = hashlib.sha256(dictionary).digest()
    system, folder = open_folder(path)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/{digest.hex()}.dict") as file:
        file.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary(name))
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
        last = np.array([end_id], own.type).tobytes()
        system, folder = open_folder(path)
        file_name = f"shard-{uuid.uuid4().hex}.bin"
        file, place, index, ids = None, HEADER_BYTES, [], 0
        parts = (part for batch in batches for part in parts_of(batch))
        for key, raw in (pair for part in parts for pair in zip(part.column(0).to_pylist(), own.encode_all(part.column(1)))):
            if file is None:
                file = system.open_output_stream(f"{folder}/{file_name}")
                file.write(struct.pack(HEADER, MAGIC, digest, own.type.itemsize))
            frame = compress(raw + last)
            file.write(frame)
            place += len(frame)
            ids += len(raw) // own.type.itemsize + 1
            index.append((key is None, key or 0, len(raw) // own.type.itemsize + 1, place))
        if file is not None:
            file.write(np.array(index, INDEX).tobytes())
            file.write(struct.pack(FOOTER, place, MAGIC))
            file.close()
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [file_name], "documents": [len(index)], "ids": [ids]})

    ordered = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    ordered = ordered.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    written = map_arrow(ordered, run, "shard bigint, file string, documents bigint, ids bigint")
    written.write.parquet(f"{path}/manifest")
    return manifest_of(spark, path)


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema("shard bigint, file string, documents bigint, ids bigint").parquet(f"{path}/manifest")
    return rows.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, path: str, name: str):
        import zstandard

        system, folder = open_folder(path)
        self.file = system.open_input_file(f"{folder}/{name}")
        magic, digest, width = struct.unpack(HEADER, self.file.read_at(HEADER_BYTES, 0))
        size = self.file.size()
        place, closing = struct.unpack(FOOTER, self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        dictionary = read_bytes(path, f"{digest.hex()}.dict")
        if magic != MAGIC or closing != MAGIC or hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{name}: not a shard, or not of this dictionary")
        self.type = np.dtype(f"<u{width}")
        self.index = np.frombuffer(self.file.read_at(size - FOOTER_BYTES - place, place), INDEX)
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    def __len__(self) -> int:
        return len(self.index)

    def frame(self, i: int) -> bytes:
        begin = int(self.index["end"][i - 1]) if i else HEADER_BYTES
        return self.file.read_at(int(self.index["end"][i]) - begin, begin)

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.decompress(self.frame(i)), self.type)


def read_documents(manifest: DataFrame, path: str, tasks: int, with_ids: bool = True) -> DataFrame:
    """One row per document read from the files: key, start, n_tokens, ids (if asked for), ids_crc32."""
    fields = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path, name)
                for low in range(0, len(shard), 1000):
                    rows = []
                    for i in range(low, min(low + 1000, len(shard))):
                        ids = shard.ids(i)
                        own = None if shard.index["null"][i] else int(shard.index["key"][i])
                        rows.append((own, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
                        start += len(ids)
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 4 + with_ids]
                    names = ["key", "start", "n_tokens", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[: 4 + with_ids])

    return map_arrow(manifest.select("file", "start").repartition(tasks), run, fields)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents as shards and give back what the files hold, without the ids themselves."""
    manifest = materialize(write_shards(docs, path, key, text), "manifest")
    return read_documents(manifest, path, max(1, manifest.count()), with_ids=False).withColumnRenamed("key", key)
