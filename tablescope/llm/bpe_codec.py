"""BPE encoding by forced boundaries, and decoding.

Every merge yields a vocabulary token, so two neighbouring symbols that never stand side by side inside
any token can never end up in one token: between them lies a certain cut. Words are cut there, the
fragments are encoded independently and their ids concatenated; the order of merges in one fragment
cannot depend on the others, so the result equals the encoding of the whole word. The fragment that ends
a word is encoded with the vocabulary's end-of-word symbols, the others without.

The text itself is prepared by the vocabulary's own normalizer and pre-tokenizer. White space never
enters a token here, so every chunk between spaces is encoded once per worker and cache.

Defined results: a null or empty text has no ids and decodes to the empty text; strings of special tokens
in a text become their ids; repeated rows are encoded row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import map_arrow
from tablescope.llm.tokenizer_files import Cache, vocabulary

VOCABULARY = "word_bpe_49k.json"
#: Characters of the texts whose ids and decoded texts are held at a time.
SLICE_CHARACTERS = 1 << 20
_coders: dict[str, ForcedBoundaryCoder] = {}

#: Texts of these characters only are in normal form and have simple lower case; their classes are stated
#: here, so they need not go through the general normalizer and pre-tokenizer.
SIMPLE = re.compile("[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
LETTER, NUMBER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
SIMPLE_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")
#: The normalizer and pre-tokenizer (by kind) for which the shortcut above holds.
SHORTCUT_FOR = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level vocabularies: visible Latin-1 characters stand for themselves."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def inner_pairs(tokens: list[str], end: str) -> set[tuple[str, str]]:
    """Neighbouring symbols found inside any token; the last symbol of a word carries ``end``."""
    pairs = set()
    for token in tokens:
        ended = bool(end) and token.endswith(end) and token != end
        symbols = list(token[: -len(end)] if ended else token)
        if ended:
            symbols[-1] += end
        pairs.update(zip(symbols, symbols[1:]))
    return pairs


class ForcedBoundaryCoder:
    """Encodes and decodes as the vocabulary file's own tokenizer without added special tokens."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        self.end = model.get("end_of_word_suffix") or ""
        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        self.tokenizer, self.normalizer, self.pre_tokenizer = whole, whole.normalizer, whole.pre_tokenizer
        self.specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.token_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.end) if self.end else self.inner
        self.pairs = inner_pairs(list(model["vocab"]), self.end)
        self.letters = byte_letters()
        steps = [n["type"] for n in (described["normalizer"] or {}).get("normalizers", [])]
        splits = (described["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.shortcut = (steps, splits[0].get("pattern", {}).get("Regex")) == SHORTCUT_FOR
        self.words = Cache(lambda words: map(self.encode_word, words))
        self.chunks = Cache(self._encode_chunks)

    def fragments(self, word: str) -> list[str]:
        """``word`` (in the vocabulary's byte letters) cut at every pair that is inside no token."""
        cuts = [0]
        for i in range(1, len(word)):
            right = word[i] + self.end if i == len(word) - 1 else word[i]
            if (word[i - 1], right) not in self.pairs:
                cuts.append(i)
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]

    def encode_word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, tokens as text) of a word in byte letters."""
        *front, last = self.fragments(word)
        ids = [t.id for f in front for t in self.inner.tokenize(f)] + [t.id for t in self.last.tokenize(last)]
        return len(ids), " ".join(map(str, ids)), " ".join([self.token_of[i] for i in ids])

    def split_chunk(self, chunk: str) -> list[str]:
        """The words of a chunk without white space, in byte letters."""
        if self.shortcut and SIMPLE.fullmatch(chunk):
            words = SIMPLE_WORD.findall(chunk)
            return words if chunk.isascii() else [w.encode().decode("latin-1").translate(self.letters) for w in words]
        return [word for word, _ in self.pre_tokenizer.pre_tokenize_str(chunk)]

    def _encode_chunks(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        split = [self.split_chunk(chunk) for chunk in chunks]
        parts = iter(self.words.of([word for words in split for word in words]))
        found = []
        for words in split:
            own = [next(parts) for _ in words]
            found.append(own[0] if len(own) == 1 else (sum(p[0] for p in own), " ".join([p[1] for p in own]), " ".join([p[2] for p in own])))
        return found

    def encode_parts(self, text: str | None) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, tokens as text) of each chunk of the text, in order."""
        if not text:
            return []
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._plain(text)
        parts = []
        for piece in self.special_pattern.split(text):
            if piece in self.specials:
                parts.append((1, str(self.specials[piece]), piece))
            elif piece:
                parts += self._plain(piece)
        return parts

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        if self.shortcut and SIMPLE.fullmatch(text):
            chunks = text.lower().split()
        else:
            normal = self.normalizer.normalize_str(text) if self.normalizer else text
            chunks = [c for c in normal.split(" ") if c]
        return [part for part in self.chunks.of(chunks) if part[0]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in self.encode_parts(text) for i in part[1].split(" ")]

    def clear(self) -> None:
        """Let the caches go. A worker that stays idle would hold them while other stages run."""
        self.words.clear()
        self.chunks.clear()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder of its own: tokens joined by single spaces, special ones included."""
        return " ".join(self.token_of[i] for i in ids)


def coder(path: str) -> ForcedBoundaryCoder:
    """One coder per Python worker."""
    if path not in _coders:
        _coders[path] = ForcedBoundaryCoder(path)
    return _coders[path]


def slices_by_characters(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` characters of a text column; one longer text is a slice of its own."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    low = held = 0
    for i, length in enumerate(lengths):
        if i > low and held + length > most:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += int(length)
    if low < len(lengths):
        yield batch.slice(low)


def encode_documents(docs: DataFrame, text: str = "text", name: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep``, n_tokens, ids (array), decoded."""
    kept = [f"__keep{i}" for i in range(len(keep))]
    own = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary(name))
        for batch in batches:
            for rows in slices_by_characters(batch, batch.num_columns - 1, SLICE_CHARACTERS):
                counts, ids, decoded = [], [], []
                for value in rows.column(rows.num_columns - 1):
                    parts = own.encode_parts(value.as_py())
                    ids.append(np.fromstring(" ".join([p[1] for p in parts]), np.int32, sep=" "))
                    decoded.append(" ".join([p[2] for p in parts]))
                    counts.append(len(ids[-1]))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                made = [pa.array(counts, pa.int64()), lists, pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *made], names=[*kept, "n_tokens", "ids", "decoded"])
        own.clear()

    fields = "".join(f"{k} {own.schema[k].dataType.simpleString()}, " for k in kept)
    rows = map_arrow(own, run, f"{fields}n_tokens bigint, ids array<int>, decoded string")
    return rows.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "n_tokens", "ids", "decoded")


def digest_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY) -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of the ids (decimal, joined by spaces) and the decoded text."""

    def digest(fields: list[str]) -> str:
        return hashlib.sha256(" ".join(fields).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary(name))
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch.column(1):
                parts = own.encode_parts(value.as_py())
                counts.append(sum(p[0] for p in parts))
                ids.append(digest([p[1] for p in parts]))
                decoded.append(digest([p[2] for p in parts]))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("__text"))
    rows = map_arrow(own, run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return rows.withColumnRenamed("key", key)
