"""Periodic runs of words: the branching-tandem test over an enhanced suffix array, with no tree nodes.

A document's suffix array, its inverse and its LCP array stand for the suffix tree: each LCP
interval is a node, its splits are where the LCP equals the interval's depth. Two equal stretches
of d words in a row, after which their continuations differ, are a branching square: suffixes i
and i + d then lie in different children of the interval of depth d. So for each interval, the
suffixes of all children but the largest look up where suffixes i + d and i - d stand. Each square
that is found ends its run; rotating it to the left, word by word, leads to the run's start.

A run of n words and period q repeats n - q words at a distance of q, which are 16 or more for the
runs that are asked for. Documents without two equal windows of 16 words (compared by hash, so
that none is missed) have no such run and need no suffix array. Documents are independent: there is
no shuffle, and a task holds a batch of texts, or one text however long.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CRC_TABLE_SQL, crc_sql, documents, gram_hashes, steps, text_bytes, word_hashes, word_spans

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Suffixes of small children that are looked up at once.
CHUNK = 1 << 20

Run = tuple[int, int, int]  # start, length, period


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes and each one's place in it, by prefix doubling among those still equal."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.append(True, ids[order][1:] != ids[order][:-1])
    place = np.empty(n, dtype=np.int64)
    place[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = 1
    while len(at := np.flatnonzero(~(new & np.append(new[1:], True)))):
        part = order[at]
        after = np.where(part + width < n, place[np.minimum(part + width, n - 1)], -1)
        by = np.argsort(place[part] * (n + 1) + after + 1, kind="stable")
        part, after = part[by], after[by]
        group = place[part]
        order[at] = part
        new[at] = np.append(True, (after[1:] != after[:-1]) | (group[1:] != group[:-1]))
        place[part] = at[np.maximum.accumulate(np.where(new[at], np.arange(len(at)), 0))]
        width *= 2
    return order, place


def lcp_array(ids: list[int], order: list[int], place: list[int]) -> list[int]:
    """How many words each suffix has in common with the one before it in order (0 for the first)."""
    n, same, out = len(ids), 0, [0] * len(ids)
    for i, at in enumerate(place):
        if at == 0:
            same = 0
            continue
        j = order[at - 1]
        most = n - max(i, j)
        while same < most and ids[i + same] == ids[j + same]:
            same += 1
        out[at] = same
        same = max(0, same - 1)
    return out


def interval_bounds(lcp: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the interval of depth lcp[k] that each k splits."""
    n = len(lcp)
    first, last, open_ = [0] * n, [n - 1] * n, []
    for k in range(1, n):
        while open_ and lcp[open_[-1]] > lcp[k]:
            last[open_.pop()] = k - 1
        # an equal one before it splits the same interval
        first[k] = (first[open_[-1]] if lcp[open_[-1]] == lcp[k] else open_[-1]) if open_ else 0
        open_.append(k)
    return np.array(first), np.array(last)


def branching_squares(ids: np.ndarray) -> np.ndarray:
    """Distinct (end, period) of all squares whose period breaks at their end, by ascending end and period."""
    order, place = suffix_array(ids)
    lcp = lcp_array(ids.tolist(), order.tolist(), place.tolist())
    first, last = interval_bounds(lcp)
    lcp, n = np.array(lcp), len(ids)
    # splits of one interval stand together, in order of place; longer periods than these have no run
    splits = np.flatnonzero((lcp >= 1) & (lcp <= n // TIMES))
    splits = splits[np.lexsort((splits, lcp[splits], first[splits]))]
    low, high, depth = first[splits], last[splits], lcp[splits]
    head = np.append(True, (low[1:] != low[:-1]) | (depth[1:] != depth[:-1]))[: len(splits)]
    tail = np.append(head[1:], True)[: len(splits)]
    # children: from the interval's start to the first split, then from each split to the next or the interval's end
    start = np.concatenate([low[head], splits])
    stop = np.concatenate([splits[head], np.where(tail, high + 1, np.append(splits[1:], 0))])
    low, high, depth = (np.concatenate([c[head], c]) for c in (low, high, depth))
    by = np.lexsort((start - stop, depth, low))  # the largest child comes first
    start, stop, low, high, depth = (c[by] for c in (start, stop, low, high, depth))
    small = ~np.append(True, (low[1:] != low[:-1]) | (depth[1:] != depth[:-1]))[: len(low)]
    start, stop, low, high, depth = (c[small] for c in (start, stop, low, high, depth))

    found, sizes = [np.empty((2, 0), np.int64)], np.cumsum(stop - start)
    cuts = [0, *np.unique(np.searchsorted(sizes, np.arange(CHUNK, (sizes[-1] if len(sizes) else 0) + CHUNK, CHUNK), side="left") + 1).tolist()]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = (stop - start)[a:b]
        child = np.repeat(np.arange(a, min(b, len(start))), size)
        at = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + start[child]
        suffix, d = order[at], depth[child]
        for other in (suffix + d, suffix - d):
            inside = (other >= 0) & (other < n)
            there = place[np.where(inside, other, 0)]
            hit = inside & (there >= low[child]) & (there <= high[child]) & ((there < start[child]) | (there >= stop[child]))
            found.append(np.unique(np.stack([np.minimum(suffix, other)[hit] + 2 * d[hit], d[hit]]), axis=1))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """start, length and smallest period of all maximal runs of at least `least` numbers and `times` periods, by start and period."""
    out: list[Run] = []
    if len(ids) < least:
        return out
    here, known = -1, []
    for end, d in branching_squares(ids).T.tolist():
        if end != here:
            here, known = end, []
        if any(d % q == 0 and start <= end - 2 * d for q, start in known):
            continue  # several periods of a run that is known
        start, step = end - 2 * d, 64
        while start > 0:  # rotate the square to the left as long as it stays one
            back = max(0, start - step)
            differ = np.flatnonzero(ids[back:start] != ids[back + d : start + d])
            if len(differ):
                start = back + int(differ[-1]) + 1
                break
            start, step = back, 2 * step
        known.append((d, start))
        if end - start >= max(least, times * d):
            out.append((start, end - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def marked_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words that are judged: in a tenth of the documents, by a hash of the id, the tail repeats with a period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + period]
    return words[:a] + (tail * (-(-(n - a) // period)))[: n - a]


def may_repeat(texts: pa.Array, window: int) -> np.ndarray:
    """Of each text, whether two of its windows of so many words have equal hashes."""
    data, ends = text_bytes(texts)
    starts, stops, first = word_spans(data, ends)
    hashes, at = gram_hashes(word_hashes(data, starts, stops), first, window)
    row = np.searchsorted(first, at, side="right") - 1
    by = np.argsort(hashes, kind="stable")  # equal hashes keep the order of rows
    hashes, row = hashes[by], row[by]
    out = np.zeros(len(ends) - 1, dtype=bool)
    out[row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]] = True
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that stay, joined by one space: those in a run go unless they are in its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed (text) of every row of docs (doc_id, text).

    Words are the stretches between white space. change(words, doc_id) may replace them before they
    are judged. Null, empty and short texts have no run and keep their words; repeated rows are each
    returned; a null doc_id stays null. Ties: runs are in order of start, then period. No rows: no
    rows. Other columns are ignored. A task holds one text, however long, and some 300 bytes a word.
    """
    window = max(1, -(-LEAST * (TIMES - 1) // TIMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out: dict[str, list] = {"n_words": [], "runs": [], "collapsed": []}
            again = may_repeat(batch.column("text"), window).tolist()
            for doc_id, text, maybe in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), again, strict=True):
                plain = (text or "").encode().split()
                words = change(plain, doc_id) if change else plain
                runs: list[Run] = []
                if maybe or words is not plain:
                    number: dict[bytes, int] = {}
                    runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64))
                out["n_words"].append(len(words))
                out["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                out["collapsed"].append(collapsed(words, runs).decode())
            kinds = (pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def greatest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact exponent; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def digests(found: DataFrame) -> DataFrame:
    """What the query tells of periodic_runs' rows: the number of runs, the greatest one, and digests of the runs and of the text."""
    kinds = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "collapsed"):
            rows = []
            for doc_id, runs, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "runs", "collapsed")), strict=True):
                runs = [(r["start"], r["length"], r["period"]) for r in runs]
                best = greatest(runs)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((doc_id, len(runs), *told, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, text))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    return found.mapInArrow(run, ", ".join(f"{c} {'string' if k == pa.string() else 'long'}" for c, k in kinds.items()))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row of documents.

    A document without runs, null ones among them, has four nulls; its digests are those of no runs
    and of its words.
    """
    return digests(periodic_runs(documents(spark, sf_dir), marked_words))


ORACLE_SQL = rf"""
WITH {CRC_TABLE_SQL},
hashed AS (
  SELECT doc_id, w, len(w) AS n,
         {crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} AS h
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), crc_table
),
marked AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 1 + (n - CASE WHEN n > 0 THEN (h // 10) % n END) // (3 + (h // 10) % 8) AS p FROM hashed),
original AS (SELECT doc_id, n, a, p, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM marked),
words AS MATERIALIZED (
  SELECT o.doc_id, o.n, o.i, s.word
  FROM original o JOIN original s ON s.doc_id = o.doc_id AND s.i = CASE WHEN o.i >= o.a THEN o.a + (o.i - o.a) % o.p ELSE o.i END
),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS stretch, x.i
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM equal GROUP BY doc_id, q, stretch),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first({{'start': start, 'length': length, 'period': period}} ORDER BY length / period DESC, start, period) AS best
  FROM runs GROUP BY doc_id
),
dropped AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
