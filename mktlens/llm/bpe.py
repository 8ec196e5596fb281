"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list. A priority queue holds the merges that are possible
now, lowest rank first, then leftmost; entries whose symbols have been merged meanwhile are stale
and skipped. Decoding concatenates the vocabulary's strings.

Spark deals the texts out; a worker keeps the results of the words that it has seen, up to
`CACHED_WORDS`, since words repeat. Words end at white space, so they are encoded one by one.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, steps

#: Words whose results a Python worker keeps, over all of its tasks; when full, the half seen last goes.
CACHED_WORDS = 600_000
#: Longer words are not kept.
CACHED_LENGTH = 64
#: Rows that are decoded at once.
DECODED_ROWS = 200

# The split pattern of the word-end vocabulary and its end-of-word mark.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


class Bpe:
    """Merge ranks, ids and strings of a vocabulary file; encodes words, decodes ids."""

    def __init__(self, vocabulary: str) -> None:
        """vocabulary: the JSON text of the file."""
        spec = json.loads(vocabulary)
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = dict.fromkeys(range(max([*ids.values(), *self.special.values()]) + 1), "")
        self.strings |= {i: s for s, i in [*ids.items(), *self.special.items()]}
        # by the ids of the two symbols: the rank of their merge and the id that it makes
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(spec["model"]["merges"])}
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + WORD_END] for s in symbols]
        self.find = regex.compile(SPLIT).findall
        self.cut_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the split pattern."""
        data = text.encode()
        inner = self.inner
        symbols = [inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        merges = self.merges.get
        queue = []
        for i in range(n - 1):
            if found := merges((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        if not queue:
            return symbols
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            _, i, made, left, right = heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges((made, symbols[k])):
                    heappush(queue, (found[0], i, found[1], made, symbols[k]))
            if (h := before[i]) >= 0 and (found := merges((symbols[h], made))):
                heappush(queue, (found[0], h, found[1], symbols[h], made))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> list[int]:
        """Ids of a text without white space."""
        word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()  # one character at a time: no final sigma
        return [i for piece in self.find(word) for i in self.piece(piece)]

    def decode(self, ids) -> str:
        """The vocabulary's strings, one space between, as the vocabulary file names no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


def words_of(text: str) -> list[str]:
    """Split at Unicode white space; \\x1c-\\x1f are none here, though str.split() takes them so."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [w for w in regex.split(r"\s+", text) if w]
    return text.split()


class Encoder(dict):
    """Ids of whole texts as int32 bytes; keeps the words that it has seen."""

    def __init__(self, vocabulary: str, word=None) -> None:
        self.bpe = Bpe(vocabulary)
        self.encode_word = word or self.bpe.word
        self.special_start = os.path.commonprefix(list(self.bpe.special))  # may be empty: then each text is searched

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            for late in list(self)[CACHED_WORDS // 2 :]:  # frequent words are seen early
                del self[late]
        ids = array("i", self.encode_word(word)).tobytes()
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, words_of(text)))

    def __call__(self, text: str) -> bytes:
        if not self.bpe.special or self.special_start not in text:
            return self.plain(text)
        out, at = [], 0
        for m in self.bpe.cut_special.finditer(text):
            out += [self.plain(text[at : m.start()]), array("i", [self.bpe.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


#: The encoders of this Python process, by kind and vocabulary.
_KEPT: dict[tuple, Encoder] = {}


def kept(make, vocabulary: str) -> Encoder:
    """The encoder that make(vocabulary) gives, made once for each Python worker, which runs many tasks."""
    key = (make.__name__, hash(vocabulary))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(vocabulary)
    return _KEPT[key]


def int_lists(parts: list[bytes]) -> pa.ListArray:
    """list<int32> from the bytes of each row's numbers."""
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>) of every row's whole text.

    vocabulary: JSON text of the vocabulary file; it goes to the tasks with the function (1.7 MB).
    Null and empty texts give no ids; strings of special tokens in a text give their ids. Rows are
    independent of each other: repeated rows stay, other columns are ignored. No rows: no rows. A task
    holds a batch of texts, or one text however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = kept(Encoder, vocabulary)
        for batch in steps(batches):
            ids = int_lists([one(t or "") for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, vocabulary: str) -> DataFrame:
    """ids (doc_id, ids array<int>) and a column `decoded`: what the ids' strings join to; none: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = kept(Encoder, vocabulary).bpe
        for batch in batches:
            for first in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(first, DECODED_ROWS)
                texts = [one.decode(x.values.to_pylist() if x.is_valid else []) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def op5_bpe_encoding(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, of every row of documents."""
    import public_tokenizers

    vocabulary = vocabulary_text(vocabulary_path or public_tokenizers.path("word_bpe_49k.json"))
    both = decode(encode(documents(spark, sf_dir), vocabulary), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
