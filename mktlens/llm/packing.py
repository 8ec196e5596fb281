"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths, at most `capacity` rows at any size of the corpus, reaches
the driver. There each bin is filled by a bitset subset-sum dynamic programme over the lengths
that are left: it starts with the longest and adds the combination that comes closest to the
capacity. A filling is used for as many bins as the histogram allows, so the work doesn't grow
with the number of documents. The fillings go back as a table of slots, bounded by the capacity
too; the n-th piece of a length takes the n-th place of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import Encoder, byte_symbols, kept, vocabulary_text
from .common import Scratch, documents, steps

CAPACITY, END_ID = 4096, 1

#: Pieces of one length are numbered in so many shares, so that a common length is no single task.
SHARES = 512


def library_encoder(vocabulary: str) -> Encoder:
    """Ids by the tokenizers library: its model for each new piece of a word, kept with the word."""
    model, symbols = Tokenizer.from_str(vocabulary).model, byte_symbols()
    out = Encoder(vocabulary)
    # Encoder splits and normalises as the file says; the library's model merges
    out.bpe.piece = lambda piece: [t.id for t in model.tokenize("".join([symbols[b] for b in piece.encode()]))]
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids and end_id, cut to at most `capacity`.

    Null and empty texts have the end id alone. Only documents that are longer are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = kept(library_encoder, vocabulary), np.array([end_id], dtype="<i4").tobytes()
        for batch in steps(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder(text or "") + end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    out.append((doc_id, k, at, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Of each length how many fill `room` best; lengths fall. Bit s of a set: a sum of s is reachable."""
    reach, history = 1, []
    full = 1 << room
    mask = 2 * full - 1
    for length in lengths:
        if length > room:
            continue
        left = min(counts[length], room // length)
        if left <= 0:
            continue
        history.append((length, left, reach))
        step = 1  # 1, 2, 4 ... copies at once reach every number up to `left`
        while left > 0:
            step = min(step, left)
            reach |= (reach << (step * length)) & mask
            left -= step
            step *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, left, before in reversed(history):
        n = 0
        while not before >> at & 1:
            at, n = at - length, n + 1
        assert n <= left
        if n:
            used[length] = n
    return used


def fillings(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, how many pieces of each length are in each of them), for all pieces."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        used = fullest(lengths, counts | {longest: counts[longest] - 1}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
        out.append((times, used))
    return out


def slots(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """For each filling and length: the range of places [first, past) of that length, each bin's share
    of it, the first bin, and where in a bin the pieces start."""
    rows, bin_, given = [], 0, dict.fromkeys(histogram, 0)
    for times, used in fillings(histogram, capacity):
        at = 0
        for length, n in used.items():
            rows.append((length, given[length], given[length] + times * n, n, bin_, at))
            given[length] += times * n
            at += n * length
        bin_ += times
    return pd.DataFrame(rows, columns=["length", "first", "past", "each", "bin", "at"], dtype="int64")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All columns of pieces(), sequence_id and offset (place in the sequence; gapless from 0).

    Each row of docs is packed, repeated ones too; no rows give no sequences. Other columns are
    ignored. Sequences hold at most `capacity` ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = scratch.cut(pieces(docs, vocabulary, capacity, end_id))
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SHARES)).cast("int")
    by_share = parts.groupBy("length", share.alias("share")).agg(F.count(F.lit(1)).alias("n"))
    by_share = scratch.cut(by_share)  # at most capacity * SHARES rows
    histogram = {r["length"]: r["n"] for r in by_share.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = by_share.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    in_share = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        parts.withColumn("share", share)
        .withColumn("place", F.row_number().over(in_share).cast("long"))
        .join(before, ["length", "share"])
        .withColumn("place", F.col("place") + F.col("before") - 1)
    )
    places = F.broadcast(spark.createDataFrame(slots(histogram, capacity), "length long, first long, past long, each long, bin long, at long"))
    return numbered.join(places, "length").where("place >= first and place < past").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("bin") + F.expr("(place - first) div each")).alias("sequence_id"),
        (F.col("at") + F.expr("(place - first) % each * length")).alias("offset"),
    )


def op4_best_fit_packing(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """Pieces of all documents and their places, with the ids of the vocabulary file."""
    import public_tokenizers

    return best_fit_packing(documents(spark, sf_dir), vocabulary_text(vocabulary_path or public_tokenizers.path("word_bpe_49k.json")))
