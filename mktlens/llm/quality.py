"""Quality classifier: supervised subword embeddings.

Each document is the average of learned vectors of its hashed features: words, pairs of words, and
character n-grams. A softmax over two classes follows, trained by numpy stochastic gradient descent
on a bounded sample of labelled documents. As the output is linear in the average, each feature's
share of the logit is known before scoring, which is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, documents, fold, gram_hashes, rabin_karp, steps, text_bytes, word_hashes, word_spans
from .toxicity import balanced_sample

#: At most so many labelled documents of each class are fitted on.
SAMPLE = 3000
BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 17, 8, 6, 0.5
NGRAMS = (2, 3, 4)


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all rows, and each one's row; words, word pairs, character n-grams."""
    starts, stops, first = word_spans(data, ends)
    words = word_hashes(data, starts, stops)
    pairs, at = gram_hashes(words, first, 2)
    of_word = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    hashes, rows = [words, pairs], [of_word, of_word[at]]
    chars = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start
    edge = np.append(chars, len(data))
    of_char = np.searchsorted(ends, chars, side="right") - 1
    for n in NGRAMS:
        if len(chars) >= n:
            inside = np.flatnonzero(of_char[: len(chars) - n + 1] == of_char[n - 1 :])
            hashes.append(rabin_karp(_BYTE[data], edge[inside], edge[inside + n]))
            rows.append(of_char[inside])
    salted = [(h + np.uint64(k)) % np.uint64(BUCKETS) for k, h in enumerate(hashes)]
    return np.concatenate(salted).astype(np.int32), np.concatenate(rows)


@dataclass
class Model:
    logits: np.ndarray  # each bucket's share of the logit
    constant: float


def fit(rows: list[tuple[str, int]], seed: int = 0, shift: float = 0.0) -> Model:
    """shift: added to the constant, so that scores are those at the labels' shares before sampling.

    Without rows of both labels the score is the share of label 1 (0.5 without rows)."""
    share = float(np.mean([label for _, label in rows])) if rows else 0.5
    if not 0 < share < 1 or not rows:
        return Model(np.zeros(0, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    rng = np.random.default_rng(seed)
    docs = []
    for text, label in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        found, counts = np.unique(features(data, np.array([0, len(data)]))[0], return_counts=True)
        docs.append((found, (counts / max(counts.sum(), 1)).astype(np.float32), label))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((DIMENSIONS, 2), np.float32), np.array([np.log(1 - share), np.log(share)], np.float32)
    steps_, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            found, weight, label = docs[k]
            rate = RATE * (1 - done / steps_)
            done += 1
            hidden = weight @ vectors[found]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            # a vector's step is its share of the average; the scale evens out the lengths of texts
            vectors[found] -= np.outer(rate * np.minimum(weight * 1000, 20), back)
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]) + shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1: probability of label 1) of every row's whole text.

    Null and empty texts have no features and get the score of the constant alone. Rows are
    independent: repeated rows stay, other columns are ignored. No rows: no rows. A long text takes
    about 60 bytes of memory a byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 19):
            z = np.full(batch.num_rows, model.constant)
            if len(model.logits):
                found, rows = features(*text_bytes(batch.column("text")))
                n = np.bincount(rows, minlength=batch.num_rows)
                z += np.bincount(rows, weights=model.logits[found], minlength=batch.num_rows) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row of documents."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, shift = balanced_sample(docs, labels, "quality", fold(3) != 1, {1: SAMPLE, 0: SAMPLE})
    return score(docs, fit(rows, shift=shift)).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
