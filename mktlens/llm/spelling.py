"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Each frequent word is a vector of letter counts. An edit changes a count by one, a replacement two,
so near words have a squared distance of at most 2, and the products of two blocks of vectors give
all their squared distances at once. Pairs that are close enough are verified letter by letter.

Blocks are made of words of one length, and adjacent lengths are compared. A length's words are
further dealt by how many of their letters fall into each of GROUPS classes of letters: an edit moves
these numbers by one as well, so that only neighbouring cells need to meet. A cell is cut into
blocks of a fixed size, so no task holds a cell; each pair of blocks that may hold near words is one
row of work.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, Scratch, crc_sql, documents, steps

#: Words have at least LETTERS code points and COUNT occurrences; a form occurs TIMES as often as its variant.
LETTERS, COUNT, TIMES = 6, 5, 5
#: Classes of letters that split the words of a length, and words in a block.
GROUPS, BLOCK = 5, 512
#: Of every so many hashes of document and word one loses a letter.
EVERY = 199

_RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Letters are a to z and U+00C0 to U+00FF.
_LETTERS = 26 + 64


def letter_of(codes: np.ndarray) -> np.ndarray:
    """0 to 89 for the letters of lower-cased words."""
    return np.where(codes < 0xC0, codes - 0x61, codes - 0xC0 + 26)


def without_letter(doc_id: int | None, word: str) -> str:
    """The word, less one letter if the hash of document and word says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
    if h % EVERY:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, change=None) -> DataFrame:
    """word, n: how often each word of at least LETTERS code points occurs; only those with COUNT occurrences.

    change(doc_id, word) may replace a lower-cased run before its length is judged. A task sums what a
    batch of texts holds before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            total: Counter[str] = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in Counter(_RUN.findall((text or "").translate(_LOWER))).items():
                    word = change(doc_id, word) if change else word
                    if len(word) >= LETTERS:
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)


def cell() -> Column:
    """How many letters of the word fall into each class, as an array of GROUPS numbers; they add up to the length."""
    classes = F.transform(F.split("word", ""), lambda c: F.pmod(F.ascii(c), F.lit(GROUPS)))
    return F.array(*(F.size(F.filter(classes, lambda c: c == g)) for g in range(GROUPS)))


def steps_between_cells() -> list[tuple[int, ...]]:
    """What one edit can add to a cell: nothing, a letter more, or a letter of one class for one of another (each pair of cells once)."""
    unit = [tuple(int(g == k) for g in range(GROUPS)) for k in range(GROUPS)]
    moved = [tuple(a - b for a, b in zip(unit[i], unit[j], strict=True)) for i, j in permutations(range(GROUPS), 2) if i < j]
    return [(0,) * GROUPS, *unit, *moved]


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b of all words (word) that differ by exactly one inserted, deleted or replaced code point, each pair once."""
    held = words.select("word", cell().alias("cell"))
    sizes = scratch.cut(held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    dealt = held.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), "word")
    blocks = scratch.cut(dealt.groupBy("cell", "block").agg(F.collect_list("word").alias("words")))
    there = sizes.select(F.col("cell").alias("cell_b"), F.col("blocks").alias("blocks_b"))
    add = F.explode(F.array(*(F.array(*map(F.lit, step)) for step in steps_between_cells())))
    moves = sizes.withColumn("step", add).withColumn("cell_b", F.zip_with("cell", "step", lambda x, y: x + y)).join(there, "cell_b")
    pairs = moves.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cell_b", "blocks_b")
    pairs = pairs.select("cell", "block", "cell_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)).alias("block_b"))
    pairs = pairs.where((F.col("cell") != F.col("cell_b")) | (F.col("block") <= F.col("block_b")))
    other = blocks.select(F.col("cell").alias("cell_b"), F.col("block").alias("block_b"), F.col("words").alias("words_b"))
    met = pairs.join(blocks, ["cell", "block"]).select("words", "cell_b", "block_b", F.struct("cell", "block").alias("one")).join(other, ["cell_b", "block_b"])
    met = met.select("words", "words_b", (F.col("one") == F.struct(F.col("cell_b").alias("cell"), F.col("block_b").alias("block"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, same in zip(*(batch.column(c).to_pylist() for c in ("words", "words_b", "same")), strict=True):
                a, b = close_words(one, two, same)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return met.mapInArrow(run, "a string, b string")


def code_matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.int64)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), _LETTERS), dtype=np.float32)
    np.add.at(out, (np.arange(len(codes))[:, None], letter_of(codes)), 1)
    return out


def close_words(one: list[str], two: list[str], same: bool) -> tuple[list[str], list[str]]:
    """The near pairs of two blocks, which hold words of one length each, the second's as long or a letter longer."""
    x, y = code_matrix(one), code_matrix(two)
    u, v = letter_counts(x), letter_counts(y)
    # counts are small whole numbers, so that single precision is exact
    squared = (u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * (u @ v.T)
    i, j = np.nonzero(squared <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    p, q = x[i], y[j]
    if x.shape[1] == y.shape[1]:
        near = (p != q).sum(1) == 1
    else:
        # what both begin with and what both end with make up the shorter one
        begin = np.cumprod(p == q[:, :-1], axis=1).sum(1)
        finish = np.cumprod((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
        near = begin + finish >= p.shape[1]
    return [one[k] for k in i[near].tolist()], [two[k] for k in j[near].tolist()]


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of words (word, form): forms followed to the last by doubling; a form is always more frequent, so none leads back."""
    here = scratch.cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not here.where("moved").isEmpty():
        up = here.select(F.col("word").alias("root"), F.col("root").alias("above"))
        higher = scratch.cut(here.drop("moved").join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        scratch.drop(here)
        here = higher
    return here.drop("moved")


def spelling_variants(docs: DataFrame, change=None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every frequent word of docs (doc_id, text).

    Null and empty texts have no words; repeated rows count each; a null doc_id changes no word. Of
    near words with equal counts the smallest in code-point order is the form. No rows: no rows.
    Other columns are ignored. A text is one value however long; its words are counted at once.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.cut(word_counts(docs, change))
    pairs = scratch.cut(near_pairs(counts, scratch))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = counts.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("top"))
    found = counts.join(near, "word", "left").withColumn("form_n", -F.col("top.less"))
    often = F.col("form_n") >= TIMES * F.col("n")
    found = scratch.cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("top.b")).alias("form"), F.when(often, F.col("form_n")).alias("form_n")))
    scratch.drop(pairs, counts)
    last = roots(found.where("form IS NOT NULL"), scratch)
    return found.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """word, n, n_near, form, form_n and root of every frequent word of documents."""
    return spelling_variants(documents(spark, sf_dir), without_letter)


ORACLE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
),
spread AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
coded AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes
  FROM spread
),
hashed AS (
  SELECT run, n, {crc_sql('bytes')} AS h FROM coded, crc_table
),
counted AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
),
less AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, left(word, i - 1) || substr(word, i + 1) AS rest FROM counted),
pairs AS (
  SELECT x.word AS one, y.word AS two FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word != y.word
  UNION SELECT x.word, c.word FROM less x JOIN counted c ON c.word = x.rest
  UNION SELECT c.word, x.word FROM less x JOIN counted c ON c.word = x.rest
),
near AS (
  SELECT one AS word, count(*) AS n_near, first({{'word': two, 'n': c.n}} ORDER BY c.n DESC, encode(two)) AS top
  FROM pairs JOIN counted c ON c.word = two GROUP BY one
),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 5 * n THEN top.word END AS form, CASE WHEN top.n >= 5 * n THEN top.n END AS form_n
  FROM counted LEFT JOIN near USING (word)
),
followed AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT f.word, f.next, g.form FROM followed f JOIN formed g ON g.word = f.next
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN followed r ON r.word = f.word AND r.next IS NULL
"""
