"""Exact dedup by distributed MSD radix partitioning.

Texts are split by their length and first bytes, then groups that are still shared are split
again and again by the next, longer, run of bytes, until each group is a singleton or its texts
have ended. Group keys are the bytes themselves; no digest decides equality. A group is named by
its smallest doc_id.

Each split is one aggregate with map-side combine (a group with a third of all rows arrives as
one row for each task), written as a table, and one equi-join with that table: both sides are plain
exchanges, so AQE splits a hot group's partition. The number of copies grows with the corpus, so no
side is broadcast, however few there are. Only texts whose group is shared travel on; all
other rows leave after the first split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Bytes of the first digit, and the growth of each later digit.
FIRST_BYTES, GROWTH = 64, 16


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " ")


def equal_groups(texts: DataFrame, first: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """Groups of two or more equal texts: keep_id (smallest doc_id), group_size, and all columns of texts but text.

    texts: doc_id, text and what else tells rows apart. Each row counts, repeated ones too. A row
    with a null doc_id counts, and names its group only if no other does. No rows: no rows.
    """
    scratch = Scratch(texts.sparkSession)
    own = [c for c in texts.columns if c != "text"]
    rows = texts.select(*own, F.col("text").cast("binary").alias("_rest")).withColumn("_n", F.length("_rest"))
    keys, ends, width, done, read = ["_n"], first, first, [], []
    while True:
        rows = rows.withColumn("_digit", F.substring("_rest", 1, width)).withColumn("_rest", F.expr(f"substring(_rest, {width + 1})"))
        shared = scratch.cut(rows.groupBy(*keys, "_digit").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").withColumn("_next", F.monotonically_increasing_id()))
        split = scratch.cut(rows.join(shared.hint("merge"), [*keys, "_digit"]).select(*own, "_n", "keep_id", "group_size", "_next", "_rest"))
        scratch.drop(shared, *read)
        done.append(scratch.cut(split.where(F.col("_n") <= ends).select(*own, "keep_id", "group_size")))
        rows, read = split.where(F.col("_n") > ends).select(*own, "_n", F.col("_next").alias("_group"), "_rest"), [split]
        if rows.isEmpty():
            scratch.drop(split)
            return reduce(DataFrame.unionByName, done)
        keys, width = ["_group"], width * growth
        ends += width


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    Null and empty texts are equal to each other; of equal texts the row with the smallest doc_id
    is kept. Rows repeated with id and text share their fate and are all returned; two rows of one
    id with different texts belong each to the group of its text. No rows: no rows. Other columns
    are ignored. A text is one value of a row however long; no task holds a group.
    """
    docs = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    docs = docs.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    # the digest only says which row of a repeated doc_id is meant
    groups = equal_groups(docs.withColumn("text_sha256", F.unhex("text_sha256"))).dropDuplicates(["doc_id", "text_sha256"]).withColumn("text_sha256", F.lower(F.hex("text_sha256")))
    same = docs["doc_id"].eqNullSafe(groups["doc_id"]) & (docs["text_sha256"] == groups["text_sha256"])
    keep = F.coalesce(groups["keep_id"], docs["doc_id"])
    return docs.join(groups.hint("merge"), same, "left").select(
        docs["doc_id"],
        keep.alias("keep_id"),
        F.coalesce(groups["group_size"], F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(docs["doc_id"]).alias("kept"),
        docs["text_sha256"],
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns: of equal texts one row with the smallest doc_id.

    Null and empty texts are equal. Of rows repeated with id and text one stays, whichever; two
    rows of one id with different texts are two documents. Rows with a null doc_id stay if all rows
    of their text have one. No rows: no rows. Other columns may have any name but `_text_sha256`.
    """
    scratch = Scratch(docs.sparkSession)
    marked = docs.withColumn("_text_sha256", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)))
    key = ["doc_id", "_text_sha256"]
    groups = equal_groups(marked.select(*key, normalised(F.col("text")).alias("text")))
    dropped = groups.where("doc_id IS NULL AND keep_id IS NOT NULL OR doc_id != keep_id").select(*key)
    twice = scratch.cut(groups.where("doc_id = keep_id").groupBy(*key).count().where("count > 1").select(*key))
    if not twice.isEmpty():
        one = marked.join(twice, key, "left_semi").dropDuplicates(key)
        marked = marked.join(twice, key, "left_anti").unionByName(one)
    equal = marked["doc_id"].eqNullSafe(dropped["doc_id"]) & (marked["_text_sha256"] == dropped["_text_sha256"])
    return marked.join(dropped.hint("merge"), equal, "left_anti").select(docs.columns)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of documents."""
    return exact_dedup(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
