"""Substring dedup: Rabin-Karp hashes of token windows, counted in Spark, merged into intervals.

A window is `WINDOW` consecutive words. A word is removed if a window over it also starts earlier
(in a smaller doc_id, or earlier in the same document).

Most windows occur once, so hashes of all windows are not shuffled. Each window has an anchor: the
smallest hash of the short word runs inside it. Equal windows have equal anchors, so a window can
only repeat if its anchor occurs more than once. Anchors change every few words; they are counted
first, and the windows of repeated anchors, all of them, are hashed and counted after that. The
filter loses nothing.

Tasks merge equal hashes of their own texts before a shuffle, and remember what they have sent, so
that a passage that most documents share is a row or two of each task. What a task knows to be
repeated by then goes on under a key of its own, which spreads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, gram_hashes, mix, steps, text_bytes, word_hashes, word_spans

WINDOW, RUN = 20, 6
#: Hashes that a task remembers; beyond these it starts anew, and sends some rows again.
REMEMBERED = 1 << 22


class Words:
    """Words of the rows of one step, their anchors and windows."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.window, self.data_ends = window, text_bytes(texts)
        self.starts, self.stops, self.first = word_spans(*self.data_ends)
        self.words = word_hashes(self.data_ends[0], self.starts, self.stops)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all short runs; each window's anchor; the index of each window's first word."""
        runs, at = gram_hashes(self.words, self.first, min(RUN, self.window))
        whole = np.full(len(self.words) + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
        whole[at] = runs
        span = self.window - min(RUN, self.window) + 1  # runs in a window
        least, width = whole, 1
        while width < span:
            more = min(width, span - width)
            least = np.minimum(least[: len(least) - more], least[more:])
            width += more
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        windows = np.flatnonzero(np.arange(len(self.words)) + self.window <= row_end)
        return runs, least[windows], windows

    def row_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, side="right") - 1


def _rows(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _spread(value: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mix(value ^ (doc_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _by_id(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return batch.take(pa.array(order)), ids[order]


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """doc_id and anchors (array<long>) of the documents that hold anchors which occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = often = np.empty(0, np.uint64)  # anchors sent once, and those sent as repeated
        for batch in steps(batches):
            if len(once) + len(often) > REMEMBERED:
                once = often = np.empty(0, np.uint64)
            ids, words = batch.column("doc_id").to_numpy(zero_copy_only=False), Words(batch.column("text"), window)
            runs, anchors, windows = words.anchors()
            if not len(anchors):
                continue
            rows = words.row_of(windows)
            new = np.ones(len(anchors), dtype=bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
            anchors, rows = anchors[new], rows[new]
            by = np.argsort(anchors, kind="stable")
            anchors, doc_id = anchors[by], ids[rows[by]]
            change = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
            runs = np.sort(runs)
            twice = np.searchsorted(runs, anchors[change], side="right") - np.searchsorted(runs, anchors[change]) > 1
            each = anchors[change]
            met, done = _within(each, once), _within(each, often)
            again = np.repeat(twice | met | done, np.diff(np.append(change, len(anchors))))
            # one row for each anchor, until it is known to repeat, and one under a spread key for each document of an anchor that repeats
            send = change[~done]
            yield _rows(key=anchors[send].view(np.int64), doc_id=doc_id[send], n=np.where(twice, 2, 1).astype(np.int32)[~done], known=pa.nulls(len(send), pa.int64()))
            once = _merged(once, each[~met & ~done & ~twice])
            often = _merged(often, each[(met | twice) & ~done])
            anchors, doc_id = anchors[again], doc_id[again]
            yield _rows(key=_spread(anchors, doc_id).view(np.int64), doc_id=doc_id, n=np.full(len(anchors), 2, np.int32), known=anchors.view(np.int64))

    seen = docs.mapInArrow(run, "key long, doc_id long, n int, known long")
    total = F.sum("n").over(Window.partitionBy("key"))
    often = seen.withColumn("total", total).where(F.col("known").isNotNull() | (F.col("total") > 1))
    return Scratch(docs.sparkSession).cut(often.groupBy("doc_id").agg(F.collect_set(F.coalesce("known", "key")).alias("anchors")))


def later_windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, starts (array<int>: indices of first words) of windows that also start earlier; docs: doc_id, text, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, sent_id, sent_at = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)  # windows and their earliest places
        for batch in steps(batches):
            batch, ids = _by_id(batch)
            words = Words(batch.column("text"), window)
            _, anchors, windows = words.anchors()
            rows = words.row_of(windows)
            lists = batch.column("anchors")
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            wanted = np.sort(_pair(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)))
            hit = _within(_pair(anchors, rows), wanted)
            windows, rows = windows[hit], rows[hit]
            if not len(windows):
                continue
            hashes, at = gram_hashes(words.words, words.first, window)
            hashes = hashes[np.searchsorted(at, windows)]
            by = np.argsort(hashes, kind="stable")  # rows are in order of doc_id, so the first of equal ones is the earliest
            hashes, doc_id, start = hashes[by], ids[rows[by]], (windows - words.first[rows])[by]
            first = np.append(True, hashes[1:] != hashes[:-1])
            # a document repeated with its id is no earlier one
            group = np.flatnonzero(first)[np.cumsum(first) - 1]
            late = (doc_id != doc_id[group]) | (start != start[group])
            if len(sent) > REMEMBERED:
                sent, sent_id, sent_at = sent[:0], sent_id[:0], sent_at[:0]
            one = np.flatnonzero(first)
            there = np.searchsorted(sent, hashes[one])
            known = _within(hashes[one], sent)
            there = np.where(known, there, 0)
            before_id, before_at = (np.where(known, c[there], 0) if len(sent) else np.zeros(len(one), np.int64) for c in (sent_id, sent_at))
            later = known & ((before_id < doc_id[one]) | ((before_id == doc_id[one]) & (before_at < start[one])))
            same = known & (before_id == doc_id[one]) & (before_at == start[one])
            late[one[later]] = True
            send = one[~later & ~same]
            yield _rows(key=hashes[send].view(np.int64), doc_id=doc_id[send], at=start[send].astype(np.int32))
            earlier = known & ~later & ~same
            sent_id[there[earlier]], sent_at[there[earlier]] = doc_id[one[earlier]], start[one[earlier]]
            new = one[~known]
            at = np.searchsorted(sent, hashes[new])
            sent, sent_id, sent_at = np.insert(sent, at, hashes[new]), np.insert(sent_id, at, doc_id[new]), np.insert(sent_at, at, start[new])
            hashes, doc_id, start = hashes[late], doc_id[late], start[late]
            # below 0: known to start earlier elsewhere
            yield _rows(key=_spread(hashes, doc_id + start).view(np.int64), doc_id=doc_id, at=(-1 - start).astype(np.int32))

    seen = docs.mapInArrow(run, "key long, doc_id long, at int")
    earliest = F.min(F.struct("doc_id", "at")).over(Window.partitionBy("key"))
    later = seen.withColumn("earliest", earliest).where((F.col("at") < 0) | (F.struct("doc_id", "at") != F.col("earliest")))
    return later.groupBy("doc_id").agg(F.collect_set(F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))).alias("starts"))


def _pair(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(value ^ mix(row.astype(np.uint64) + np.uint64(1)))


def _merged(ordered: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Both as one ordered array; more is in order, too."""
    return np.insert(ordered, np.searchsorted(ordered, more), more)


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, starts of the documents from which words go; others are left out.

    docs: doc_id, text. Null and short texts have no window. Equal windows of one document count
    from their second start. A row repeated with its doc_id must repeat its text, too; it is not
    an earlier copy of itself. Hashes have 64 bits: two different windows are mistaken for equal
    with a probability of n / 2**64 each, n being the number of windows of repeated anchors.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # both joins are on doc_id, so the texts are dealt out once and the second join meets them in place
    held = docs.join(repeated_anchors(docs, window), "doc_id")
    return held.join(later_windows(held, window), "doc_id").select("doc_id", "text", "starts")


def without(text: str, starts: np.ndarray, window: int) -> tuple[str, int]:
    """The kept words joined by one space, and how many went: maximal intervals of the windows' union."""
    words = text.encode().split()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, len(words)), -1)
    gone = np.cumsum(edge)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode(), int(gone.sum())


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kept (text), n_removed of the documents from which words go (see removals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [without(t, s.values.to_numpy(), window) for t, s in zip(batch.column("text").to_pylist(), batch.column("starts"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["doc_id", "kept", "n_removed"])

    return removals(docs, window).mapInArrow(run, "doc_id long, kept string, n_removed long")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of documents; null texts have no words."""
    docs = documents(spark, sf_dir)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t-\r]+", " "))
    whole = docs.select("doc_id", words.alias("words")).select(
        "doc_id",
        F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.sha2("words", 256).alias("whole_sha256"),
    )
    less = substring_dedup(docs).select("doc_id", "n_removed", F.sha2("kept", 256).alias("less_sha256")).dropDuplicates(["doc_id"])
    return whole.join(less, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("less_sha256", "whole_sha256").alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
),
windows AS (
  SELECT doc_id, i, word, count(*) OVER ahead AS size, string_agg(word, ' ') OVER ahead AS passage
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
repeats AS (
  SELECT doc_id, i, word, size = 20 AND row_number() OVER (PARTITION BY passage, size ORDER BY doc_id, i) > 1 AS again FROM windows
),
judged AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM repeats
)
SELECT d.doc_id,
       count(i) AS n_words,
       count(i) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id
GROUP BY d.doc_id
"""
