"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions, embedded checksums.

One pass over the texts, without a shuffle. An automaton over all kinds' keywords runs over the
bytes of many texts at once; only where a keyword ends is the kind's expression tried, anchored
there. Runs of hexadecimal digits have no keyword; for them a window of the least length, all of
whose bytes are such digits, takes the keyword's place. Kinds whose tokens carry a checksum are
reported only if it is right.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc_sql, documents, steps, text_bytes

HEX_LEAST = 24

# The kinds in their order, keywords in lower case, and expressions.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{%d,}" % HEX_LEAST)
GITHUB = re.compile(rb"gh[oprsu]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
KINDS = ["assign", "access", "hex", "github", "npm"]
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "gho_": "github", "ghp_": "github", "ghr_": "github", "ghs_": "github", "ghu_": "github",
    "npm_": "npm",
}

BASE62 = (string.digits + string.ascii_uppercase + string.ascii_lowercase).encode()


def checksum62(body: bytes) -> bytes:
    """CRC-32 of a token's random part as its six last characters, in base 62."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit : digit + 1] + out
    return out


def _sealed(match: re.Match) -> bool:
    return checksum62(match[1][:30]) == match[1][30:]


#: For each kind its expression and what its matches have to pass.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "hex": (HEX, lambda m: True),
    "github": (GITHUB, _sealed),
    "npm": (NPM, _sealed),
}

_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def hex_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where runs of HEX_LEAST or more hexadecimal digits start; a row's first byte starts a run anew."""
    run = _IS_HEX[data]
    length = 1
    while length < HEX_LEAST:  # run[i]: the `length` bytes from i on are all such digits
        more = min(length, HEX_LEAST - length)
        if len(run) <= more:
            return np.empty(0, np.int64)
        run = run[:-more] & run[more:]
        length += more
    at = np.flatnonzero(run)
    first = np.ones(len(at), dtype=bool)
    first[1:] = np.diff(at) > 1
    return at[first | np.isin(at, ends)]


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points of the UTF-8 bytes `data` start before each place of `at` (less than their number), in one pass."""
    places, back = np.unique(np.append(at, 0), return_inverse=True)
    between = np.add.reduceat((data & 0xC0) != 0x80, places, dtype=np.int64)
    return (np.cumsum(between) - between)[back[:-1]]


def spans_of(data: np.ndarray, ends: np.ndarray, words: ahocorasick.Automaton) -> dict[int, list[tuple[int, int, str]]]:
    """By row: (start, end, kind) in code points, by start, then kind as listed. Rows without any are left out."""
    whole = data.tobytes()
    hits = [(end + 1 - length, kind) for end, (length, kind) in words.iter(whole.lower().decode("latin-1"))]
    hits += [(int(at), "hex") for at in hex_starts(data, ends)]
    hits.sort()
    rows = np.searchsorted(ends, [at for at, _ in hits], side="right") - 1
    matches: list[tuple[int, int, int, str]] = []  # row, first byte, bytes, kind
    past: dict[str, int] = {}  # matches of one kind don't overlap
    text, now = b"", -1
    for row, (at, kind) in zip(rows.tolist(), hits, strict=True):
        if row != now:
            base, now, past = int(ends[row]), row, {}
            text = whole[base : int(ends[row + 1])]
        expression, passes = RULES[kind]
        if at - base < past.get(kind, 0) or not (m := expression.match(text, at - base)):
            continue
        past[kind] = m.end()
        if passes(m):
            matches.append((row, base + m.start(), len(m[0]), kind))
    found: dict[int, list[tuple[int, int, str]]] = {}
    if not matches:
        return found
    at = np.array([m[1] for m in matches])
    points = code_points(data, np.concatenate([at, ends[[m[0] for m in matches]]]))
    starts = points[: len(at)] - points[len(at) :]
    for (row, _, length, kind), start in zip(matches, starts.tolist(), strict=True):
        found.setdefault(row, []).append((start, start + length, kind))
    for spans in found.values():
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    words = automaton()
    for batch in steps(batches):
        yield batch, spans_of(*text_bytes(batch.column("text")), words)


SPANS = "spans array<struct<kind:string,start:int,stop:int>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row's whole text: kind, start, stop (code points, stop exclusive).

    Null and empty texts have none. Rows are independent: repeated rows stay, other columns are
    ignored. No rows: no rows. Time grows with the text, however long. Spans of one kind don't overlap; those of different kinds may.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches):
            lists = [found.get(row, []) for row in range(batch.num_rows)]
            offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = [span for spans in lists for span in spans]
            fields = [pa.array([s[2] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32())]
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["kind", "start", "stop"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {SPANS}")


def redact_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with `mark` in place of each span of `text` (overlapping spans become one); other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches):
            if found:
                at = batch.schema.get_field_index("text")
                texts = batch.column(at).to_pylist()
                for row, spans in found.items():
                    texts[row] = _without(texts[row], spans, mark)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _without(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, past = [], 0
    for start, stop, _ in spans:
        if start >= past:
            out += [text[past:start], mark]
        past = max(past, stop)
    return "".join([*out, text[past:]])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans and all spans, of every row of documents."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


#: The kinds' expressions for SQL, whose engine knows no lookahead; each has what a match is judged by as its group.
_SQL_KINDS = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "(AKIA[A-Z0-9]+)",
    "hex": "([0-9a-f]+)",
    "github": "gh[oprsu]_([A-Za-z0-9]{36})",
    "npm": "npm_([A-Za-z0-9]{36})",
}
_SQL_MATCHED = "\n  UNION ALL ".join(
    f"SELECT doc_id, text, {place} AS place, '{kind}' AS kind, regexp_extract_all(text, '{e}') AS whole, regexp_extract_all(text, '{e}', 1) AS body, string_split_regex(text, '{e}') AS between FROM texts" for place, (kind, e) in enumerate(_SQL_KINDS.items(), 1)
)

ORACLE_SQL = rf"""
WITH {CRC_TABLE_SQL},
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS (
  {_SQL_MATCHED}
),
placed AS (
  SELECT doc_id, text, place, kind, unnest(whole) AS match, unnest(body) AS body,
         unnest(list_transform(range(1, len(whole) + 1), lambda k: length(array_to_string(between[1:k], '')) + length(array_to_string(whole[1:k - 1], '')))) AS start
  FROM matched WHERE len(whole) > 0 AND (place != 3 OR list_bool_or(list_transform(body, lambda x: length(x) >= {HEX_LEAST})))
),
ended AS (SELECT *, start + length(match) AS stop FROM placed),
sealed AS (
  SELECT e.*, {crc_sql("list_transform(string_split(left(body, 30), ''), lambda x: unicode(x)::BIGINT)")} AS h
  FROM ended e, crc_table WHERE place >= 4 AND NOT regexp_matches(substr(text, stop + 1, 1), '[A-Za-z0-9]')
),
spans AS (
  SELECT doc_id, place, kind, start, stop FROM ended WHERE place = 1 AND length(body) >= 6 OR place = 2 AND length(body) >= 20 OR place = 3 AND length(body) >= {HEX_LEAST}
  UNION ALL
  SELECT doc_id, place, kind, start, stop FROM sealed
  WHERE right(body, 6) = array_to_string(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda p: substr('{BASE62.decode()}', 1 + (h // p) % 62, 1)), '')
),
told AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM spans)
SELECT d.doc_id, count(*) FILTER (place = 1) AS n_assign, count(*) FILTER (place = 2) AS n_access, count(*) FILTER (place = 3) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place <= 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
GROUP BY d.doc_id
"""
