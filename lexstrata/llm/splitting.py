"""Oversized texts to overlapping pieces, cut at natural boundaries.

Method: recursive bisection. A span that is too long is cut at the strongest boundary near its midpoint (blank line, line,
sentence, clause, word), and the halves go on as long as they exceed the limit less the overlap; at the end each piece but
the first gets the last ``overlap`` characters of the one before in front. Is there no line or sentence boundary near the
midpoint, the whole span is searched for one before anything weaker is taken.

Defined results: texts of at most ``limit`` characters, empty and null texts give no pieces. The first piece may fill the
limit. Lengths count Unicode code points. Pieces without their overlap, in order, are the whole text. A cut never stands
before a combining mark unless the span holds nothing else. Every row counts by itself, repeated or not.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

LIMIT, OVERLAP = 2000, 200
#: Shortened words after which a full stop ends no sentence.
SHORT = frozenset("ст п пп ч гл ред г гг см т им руб коп тыс напр др пр no nr art abs cf vgl ver see art. n núm pág p вж див стор чл ал бр ap".split())
#: German words before an ordinal number.
ORDINAL = frozenset("am vom zum der dem den des im".split())
_BLANK = re.compile(r"\r?\n(?:[^\S\n]*\r?\n)+")
_LINE = re.compile(r"\n")
#: Possessive, and only from the first sign of a run, so that no run is read more than twice.
_SENTENCE = re.compile(r"(?<![.!?…。！？])[.!?…。！？]++[)\]»”\"'’]*+\s++(?=[«„“\"'(\[–—-]*+\s*+[^\W_])")
_CLAUSE = re.compile(r"[;:,]\s+")
_WORD = re.compile(r"\s+")
_LAST_WORD = re.compile(r"([^\W_]+)\W*\Z")


def _sentence_ends(text: str) -> list[int]:
    out = []
    for m in _SENTENCE.finditer(text):
        if text[m.start()] == ".":
            before = text[max(0, m.start() - 24) : m.start()]
            word = _LAST_WORD.search(before)
            w = word.group(1).lower() if word and word.end() == len(before) else ""
            after = text[m.end()]
            if w in SHORT or (len(w) == 1 and w.isalpha()) or after.islower():
                continue
            if w.isdigit():
                lead = before[: word.start()].rstrip(" ")
                if not lead or lead.endswith("\n"):  # a number that opens a line or the text
                    if m.start() - len(w) == 0 or lead.endswith("\n"):
                        continue
                prior = _LAST_WORD.search(lead)
                if prior and prior.group(1).lower() in ORDINAL:
                    continue
        out.append(m.end())
    return out


def _boundaries(text: str) -> list[list[int]]:
    """Sorted cut places by strength, strongest first. A weaker list may repeat places of a stronger one."""
    return [[m.end() for m in _BLANK.finditer(text)], [m.end() for m in _LINE.finditer(text)], _sentence_ends(text), [m.end() for m in _CLAUSE.finditer(text)], [m.end() for m in _WORD.finditer(text)]]


def _nearest(places: list[int], lo: int, hi: int, mid: int) -> int | None:
    """The place in [lo, hi] nearest to mid."""
    i = bisect_left(places, mid)
    best = None
    for j in (i - 1, i):
        if 0 <= j < len(places) and lo <= places[j] <= hi and (best is None or abs(places[j] - mid) < abs(best - mid)):
            best = places[j]
    return best


def _cut(text: str, a: int, z: int, by: list[list[int]], least: int) -> int:
    mid, reach = (a + z) // 2, (z - a) // 4
    lo, hi = max(a + 1, a + least), z - 1
    near = (max(lo, mid - reach), min(hi, mid + reach))
    for places in by[:3]:
        if (c := _nearest(places, *near, mid)) is not None:
            return c
    for places in by[:3]:
        if (c := _nearest(places, lo, hi, mid)) is not None:
            return c
    for window in (near, (lo, hi)):
        for places in by[3:]:
            if (c := _nearest(places, *window, mid)) is not None:
                return c
    c = mid
    while c > lo and unicodedata.combining(text[c]):
        c -= 1
    return c if c > lo else mid


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece's own part; piece k > 0 then begins ``overlap`` characters before its start."""
    if len(text) <= limit:
        return [(0, len(text))]
    by, out, todo = _boundaries(text), [], [(0, len(text))]
    while todo:
        a, z = todo.pop()
        if z - a <= (limit if a == 0 else limit - overlap):
            out.append((a, z))
        else:
            c = _cut(text, a, z, by, overlap if a == 0 else 1)
            todo += [(c, z), (a, c)]
    return out


def split(df: DataFrame, row_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, piece_no, start, piece) for every text longer than ``limit``; numbered from 0. No shuffle; only long
    texts reach Python."""
    ship(df.sparkSession)
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half of the limit")
    schema = pa.schema([("row_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int64()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            cols: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for i, rid in enumerate(ids):
                t = texts[i].as_py()
                for k, (a, z) in enumerate(spans(t, limit, overlap)):
                    a = max(0, a - overlap) if k else a
                    for col, v in zip(cols, (rid, k, a, t[a:z])):
                        col.append(v)
                size += len(t)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols, size = ([], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    long = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("t")).filter(F.length("t") > limit)
    return long.mapInArrow(run, "row_id bigint, piece_no int, start bigint, piece string")
