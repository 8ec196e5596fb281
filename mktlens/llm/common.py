"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders

#: Bytes of text that one vectorised step handles at once; a longer text is handled alone.
STEP_BYTES = 2 << 20

#: The white space of all the operators here: \x20 and \x09-\x0D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns of `documents` that operators read; the scan prunes the rest."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


#: Settings of a statement that writes a table: shuffles go with it, and rows, which may hold long texts, go to Python in small batches.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """SETTINGS hold for the statements that run within."""
    before = {name: spark.conf.get(name) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Scratch:
    """Tables of one run in the shared folder.

    A table cuts the lineage: a lost executor costs none of what led to it, and Spark plans what
    follows by its real size. The shuffles that made it go with its statement, and the table goes
    when it is dropped, so that disk holds only what is still to be read. What a result still reads
    goes with folders.clear(), or with the session.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, folders.new(spark, "tables")
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        with small_batches(self.spark):
            df.select("*").write.parquet(f"{self.folder}/{len(self.tables)}")
        self.tables.append(self.spark.read.schema(df.schema).parquet(f"{self.folder}/{len(self.tables)}"))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        for table in tables:
            at = next(k for k, known in enumerate(self.tables) if known is table)
            folders.delete(self.spark, f"{self.folder}/{at}")


def fold(every: int):
    """crc32(doc_id as text) mod `every`, by which the contracts split learning from held-out rows."""
    return F.crc32(F.col("doc_id").cast("string")) % every


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes in `column` (or one row)."""
    for batch in batches:
        ends = text_bytes(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and the offsets of its rows in it (n + 1)."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return data, ends - ends[0]


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1)."""
    solid = np.empty(len(data) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(_IS_SPACE[data], out=solid[1:-1])
    new_row = np.zeros(len(data) + 1, dtype=bool)
    new_row[ends] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | new_row))
    stops = np.flatnonzero(solid[:-1] & (~solid[1:] | new_row))
    return starts, stops, np.searchsorted(starts, ends)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, in place: spreads every bit over the whole word."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C55
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        _POWERS[:] = [_progression(_BASE, size), _progression(pow(_BASE, -1, 1 << 64), size)]
        if n > 8 * STEP_BYTES:  # a huge text; don't keep its tables
            return _POWERS.pop(0), _POWERS.pop()
    return _POWERS[0], _POWERS[1]


def _progression(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rabin_karp(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of values[start:stop], mixed; equal slices get equal hashes.

    Prefix sums of value * base**i give every slice in two reads; the inverse power takes the
    place of the slice out again.
    """
    power, back = _powers(len(values) + 1)
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * back[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return rabin_karp(_BYTE[data], starts, stops)


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that lie in one row, and the index of each one's first word."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(words)) + n <= row_end)
    return rabin_karp(words, at, at + n), at


#: For SQL that checks operators: a CTE with the table of CRC-32, and the CRC-32 of a list of bytes by it.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
)"""


def crc_sql(data: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])))"
