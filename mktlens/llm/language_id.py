"""Language identification with error-correcting output codes.

Each language has a codeword. One binary classifier for each bit says from a text's character
trigrams whether the bit is 1; the language whose codeword loses least is chosen, each bit's loss
weighted by how surely that classifier tells that language. The classifiers are linear: log ratios
of trigram shares, for which Spark counts the trigrams of all learning texts, with partial sums in
each task; at most SIZE counts for each language reach the driver, whatever the corpus holds.

Letters of ASCII count without case, other bytes fall into the remaining classes, and all of ASCII
that is no letter into one; three classes of 6 bits make a trigram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, steps, text_bytes

UNDETERMINED = "und"
CLASSES = 64
SIZE = CLASSES**3
#: Below this difference between the two smallest losses the choice is flagged as ambiguous.
LEAST_MARGIN = 0.01
#: Steepness of the loss, and of the scores made of losses.
STEEP, SHARP = 4.0, 5.0

_CLASS = np.zeros(256, dtype=np.uint32)
_CLASS[0x80:] = 27 + np.arange(128) % (CLASSES - 27)
for _i in range(26):
    _CLASS[[0x41 + _i, 0x61 + _i]] = 1 + _i

_is_letter = re.compile(r"[^\W\d_]").finditer


def trigrams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index of the trigram at each byte; 0, which has no weight, where it would leave its row."""
    out = np.zeros(len(data), dtype=np.uint32)
    if len(data) > 2:
        c = _CLASS[data]
        out[:-2] = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    for back in (1, 2):
        at = ends[1:] - back
        out[at[at >= ends[:-1]]] = 0
    return out


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _is_letter(text or ""))


def count_trigrams(rows: DataFrame) -> dict[str, np.ndarray]:
    """Trigram counts of each language over all rows (text, lang); SIZE numbers for each language."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in steps(batches):
            data, ends = text_bytes(batch.column("text"))
            grams = trigrams(data, ends)
            langs = batch.column("lang").to_pylist()
            of_row = np.repeat(np.arange(len(langs)), np.diff(ends))
            for lang in set(langs):
                chosen = np.array([x == lang for x in langs])
                sums.setdefault(lang, np.zeros(SIZE, np.int64))
                sums[lang] += np.bincount(grams[chosen[of_row]], minlength=SIZE)
        for lang, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["lang", "gram", "n"])

    total = rows.mapInArrow(partial, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for lang, part in total.groupby("lang"):
        out[lang] = np.zeros(SIZE, np.int64)
        out[lang][part["gram"].to_numpy()] = part["n"].to_numpy()
    return out


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n rows of -1 and 1: all different splits for up to 5 languages, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 5:
        bits = np.arange(1, 2 ** (n - 1))
        return np.array([[1] * len(bits)] + [[-1 if b >> k & 1 else 1 for b in bits] for k in range(n - 1)], dtype=np.int8)
    rng, width, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = (code[:, None, :] != code[None]).sum(2)
        apart[np.arange(n), np.arange(n)] = width
        if apart.min() > most:
            best, most = code, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # (bits, SIZE)
    trust: np.ndarray  # (langs, bits), rows sum to 1


def fit(rows: DataFrame) -> Model:
    """From rows (text, lang), both without nulls."""
    counts = count_trigrams(rows)
    langs = sorted(counts)
    share = np.array([counts[lang] for lang in langs], dtype=np.float64).reshape(len(langs), SIZE)
    share[:, 0] = 0
    share = (share + 0.05) / (share + 0.05).sum(1, keepdims=True) if langs else share
    code = codewords(len(langs))
    weights = np.array([np.log(share[bit > 0].mean(0) / share[bit < 0].mean(0)) for bit in code.T]).reshape(code.shape[1], SIZE)
    weights[:, 0] = 0
    sure = 1 / (1 + np.exp(-STEEP * code * (share @ weights.T)))
    return Model(langs, code, weights.astype(np.float32), sure / np.maximum(sure.sum(1, keepdims=True), 1e-9))


def predict(batch: pa.RecordBatch, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, of each row of a batch with a column text."""
    code, n = model.code.astype(np.float64), len(model.langs)
    data, ends = text_bytes(batch.column("text"))
    grams, size = trigrams(data, ends), np.diff(ends)
    known = np.array([n > 0 and has_letter(text) for text in batch.column("text").to_pylist()], dtype=bool)
    if not n:
        return [UNDETERMINED] * len(size), np.zeros(len(size)), known
    margin = np.zeros((len(size), code.shape[1]))
    full = np.flatnonzero(size)
    for k, w in enumerate(model.weights):
        if len(full):
            margin[full, k] = np.add.reduceat(w[grams], ends[:-1][full]) / np.maximum(size[full] - 2, 1)
    loss = (np.log1p(np.exp(-STEEP * margin[:, None, :] * code[None])) * model.trust[None]).sum(2)
    order = np.sort(loss, axis=1)
    score = np.exp(-SHARP * order[:, 0]) / np.exp(-SHARP * loss).sum(1)
    apart = order[:, 1] - order[:, 0] if n > 1 else np.full(len(size), np.inf)
    langs = [model.langs[best] if k else UNDETERMINED for best, k in zip(loss.argmin(1).tolist(), known.tolist(), strict=True)]
    return langs, np.where(known, score, 0.0), known & (apart < LEAST_MARGIN)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous of every row's whole text.

    Null texts and those without a letter are `und` with score 0, not ambiguous; so is every row
    if the model knows no language. Ties go to the language that sorts first, flagged as ambiguous.
    Rows are independent: repeated rows stay, other columns are ignored. No rows: no rows. A task
    holds a batch of texts, or one text however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            langs, score, ambiguous = predict(batch, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(ambiguous)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def only_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, whose language can be told (lang_pred is not `und`); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            langs, _, _ = predict(batch, model)
            yield batch.filter(pa.array([lang != UNDETERMINED for lang in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned(docs: DataFrame) -> Model:
    """The model of the rows of documents that may be learned from: 3 of 4 ids, with text and lang."""
    return fit(docs.where((fold(4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, learned(docs)).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
