"""Toxicity by compression distance.

zstandard's trainer makes two dictionaries: one of passages of ordinary text, one of toxic text.
Toxic documents are mostly ordinary prose, which would fill a dictionary of all their text (held-out
AUC 0.6), so the toxic passages are made of those windows that are many times as frequent in toxic
documents as in ordinary ones. A window's distance is the number of bytes by which the toxic
dictionary compresses it shorter than the ordinary one does. Windows are words: in a longer window
the prose around a short word hides the few bytes that it saves. A word is compressed with a fixed
carrier after it, as zstandard looks for no match in a frame's last bytes. Thresholds of distance
are calibrated on the ordinary documents of the sample, and what the number of windows beyond each
of them means on all of it.

The model comes from a bounded sample of labelled rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, steps

#: At most so many labelled documents of each class are fitted on.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 2000, 4000
#: A toxic passage's windows are in at least this share of the toxic documents (and this many), and so many times as often as in ordinary ones.
LEAST_SHARE, LEAST_DOCS, LEAST_RATIO = 0.01, 4, 8
#: Distinct words of a passage, sizes of the dictionaries, and the trainer's segments and what it counts in them (bytes).
PASSAGE_WORDS, TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, COUNTED = 4, 4096, 65536, 16, 6
#: Shares of the ordinary documents' distinct windows that may lie beyond each threshold of distance.
BEYOND = (0.01, 0.002, 0.0004)
CACHED_WORDS = 400_000
#: Follows each window; no text holds it.
CARRIER = bytes(range(0x80, 0xC0)) + bytes(range(0xC0, 0x80, -1))

_letters = re.compile(r"[^\W\d_]+").findall


def words(text: str) -> list[str]:
    return _letters(text.lower())


def balanced_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bounds: dict[int, int]) -> tuple[list[tuple[str, int]], float]:
    """Whole texts and labels of at most bounds[label] rows of each label, those whose ids hash lowest; and their shift.

    The shift is what the log odds of label 1 lack in the sample: 0 unless a bound cuts the labels unequally.

    The ids are few by their bound, so they are broadcast to the documents.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(learn & F.col("label").isNotNull())
    totals = {r["label"]: r["count"] for r in rows.where(F.col("label").isin(list(bounds))).groupBy("label").count().collect()}
    fewer = {value: np.log(max(totals.get(value, 0) / most, 1.0)) for value, most in bounds.items()}
    parts = [rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for value, most in bounds.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id")
    return [(r["text"], r["label"]) for r in found.orderBy("doc_id").select("text", "label").collect()], float(fewer[1] - fewer[0])


@dataclass
class Model:
    """Dictionaries, and weights of a document's features."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    base: float
    steps: tuple[int, ...] = ()


class Distances(dict):
    """Distance of each word seen; a word of several runs of letters has that of the farthest."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.compressors = [_compressor(x) for x in (ordinary, toxic)]

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ordinary, toxic = self.compressors
        far = 0
        for run in words(word):
            window = b" " + run.encode() + b" " + CARRIER
            far = max(far, len(ordinary.compress(window)) - len(toxic.compress(window)))
        self[word] = far
        return far

    def of(self, text: str) -> tuple[list[int], int]:
        """The distances over 0 of a text's windows, and its number of windows."""
        found = text.split()
        return [d for w in found if (d := self[w])], len(found)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    level = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, strategy=zstandard.STRATEGY_LAZY2,
        min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=8,
    )
    return zstandard.ZstdCompressor(compression_params=level, dict_data=zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def train_dictionaries(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, each trained on passages of its documents' distinct words."""
    counts, n = (Counter(), Counter()), [0, 0]
    for text, label in rows:
        n[label] += 1
        counts[label].update(set(words(text)))
    ordinary, toxic = counts
    telling = {w for w, k in toxic.items() if k >= max(LEAST_DOCS, LEAST_SHARE * n[1]) and (k + 0.5) / (n[1] + 1) > LEAST_RATIO * (ordinary[w] + 0.5) / (n[0] + 1)}
    passages: tuple[list[bytes], list[bytes]] = ([], [])
    for text, label in rows:
        distinct = sorted(telling & set(words(text)) if label else set(words(text)), key=lambda w: (zlib.crc32(w.encode()), w))
        passages[label].extend(f" {' '.join(distinct[k : k + PASSAGE_WORDS])} ".encode() for k in range(0, len(distinct), PASSAGE_WORDS))
    return _trained(passages[1], TOXIC_BYTES), _trained(passages[0], ORDINARY_BYTES)


def _trained(passages: list[bytes], size: int) -> bytes:
    """The trainer's dictionary; of passages that are too few for it, the passages themselves."""
    passages = [p for p in passages if len(p) >= 8]  # the trainer's least sample
    try:
        return zstandard.train_dictionary(size, passages, k=SEGMENT, d=COUNTED, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(passages)[-size:]


def calibrated(ordinary: list[str], lookup: Distances) -> tuple[int, ...]:
    """For each share of BEYOND the least distance that no more of the windows of ordinary texts reach."""
    far = np.sort(np.concatenate([[0], *([lookup[w] for w in set(text.split())] for text in ordinary)]))
    return tuple(int(far[min(len(far) - 1, int(len(far) * (1 - share)))]) + 1 for share in BEYOND)


def features(distances: list[int], n_words: int, steps: tuple[int, ...]) -> list[float]:
    counts = [np.log1p(sum(d >= least for d in distances)) for least in steps]
    return [1.0, float(min(max(distances, default=0), 8)), *counts, *(c / np.log(2.0 + n_words) for c in counts)]


def fit(rows: list[tuple[str, int]], shift: float = 0.0) -> Model:
    """shift: added to the constant, so that scores are those at the labels' shares before sampling.

    Without rows of both labels the score is the share of toxic rows (0 without rows)."""
    base = float(np.mean([label for _, label in rows])) if rows else 0.0
    if base in (0.0, 1.0):
        return Model(b"", b"", np.zeros(0), base)
    toxic, ordinary = train_dictionaries(rows)
    lookup = Distances(toxic, ordinary)
    steps = calibrated([text for text, label in rows if not label], lookup)
    x = np.array([features(*lookup.of(text), steps) for text, _ in rows])
    weights = logistic(x, np.array([label for _, label in rows], dtype=float))
    weights[0] += shift
    return Model(toxic, ordinary, weights, base, steps)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), farthest (bytes) and n_far (windows beyond the second threshold) of each row.

    Null and empty texts have no window and get the score of a text without a far one. Rows are
    independent: repeated rows stay, other columns are ignored. No rows: no rows. A task holds a
    batch of texts, or one text however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Distances(model.toxic, model.ordinary)
        for batch in steps(batches):
            rows = [lookup.of(text or "") if len(model.weights) else ([], 0) for text in batch.column("text").to_pylist()]
            if len(model.weights):
                z = np.array([features(*row, model.steps) for row in rows]).reshape(-1, len(model.weights)) @ model.weights
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                scores = np.full(len(rows), model.base)
            farthest = pa.array([max(far, default=0) for far, _ in rows], pa.int32())
            n_far = pa.array([sum(d >= model.steps[1] for d in far) if model.steps else 0 for far, _ in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), farthest, n_far], names=["doc_id", "score", "farthest", "n_far"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, farthest int, n_far int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), farthest and n_far of every row of documents."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, shift = balanced_sample(docs, labels, "toxic", fold(3) != 1, {1: SAMPLE_TOXIC, 0: SAMPLE_ORDINARY})
    return score(docs, fit(rows, shift)).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "farthest", "n_far"
    )
