"""Texts that look the same but differ in their characters, to one consistent form.

Method: each letter stands for its shape, and each shape has a set of scripts in which it can be written. The sets of a
token's letters are intersected. One script left: the token is written in it. Several (a whole-script confusable, such as
a word that could be Latin or Cyrillic throughout): the script of the text's other tokens decides. None (a mixed-script
token): the script of most of its unambiguous letters decides, and letters that it lacks stay. Before that, widths, kinds
of space and shapeless characters are brought to one form and accents composed. Since every choice depends on shapes
alone, texts that look the same get the same form, and others don't.

All of it runs on arrays of code points over a batch; only rows with combining marks are touched one by one.

Defined results: null stays null, '' stays ''. Case, digits, raised digits and letters like e and e with diaeresis stay
different. Line breaks stay; tabs count as spaces, and runs of spaces keep their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship

#: Letters of one shape, as Latin, Cyrillic, Greek ('-': none in that script).
SHAPES = """AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙ JЈ- KКΚ MМΜ N-Ν OОΟ PРΡ SЅ- TТΤ XХΧ YУΥ Z-Ζ QԚ- WԜ- VѴ- GԌ-
aа- cсϲ eе- iі- jјϳ lӏ- oоο pрρ sѕ- vѵν xх- yу- hһ- dԁ- qԛ- wԝ- æӕ- ÆӔ- əә- ƏӘ-""".split()
#: Further letters of those shapes, whose script has one already.
MORE_SHAPES = {"Ү": "Y", "Ӏ": "I"}
#: Code points without any shape of their own besides those of category Cf (ranges inclusive).
SHAPELESS = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0)]
#: Characters handled at once.
BATCH_CHARS = 1_000_000
_TAGS = (0xE0000, 0xE0FFF)  # tags and further variation selectors
_GONE = 0xFFFF  # no character; marks what is taken out
_MARKED = re.compile(r"(.)([̀-ͯ]+)", re.S)


def _script(c: int) -> int:
    """Bit of Latin 1, Cyrillic 2, Greek 4; else 0."""
    name = unicodedata.name(chr(c), "")
    return 1 if name.startswith("LATIN") else 2 if name.startswith("CYRILLIC") else 4 if name.startswith("GREEK") else 0


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[tuple[int, str], int], np.ndarray]:
    """By code point of the BMP: first mapping, whether NFC may change it, letter, shape, scripts; spelling by script and
    shape; and shape with accents to a composed letter; and the script in which each is."""
    first = np.arange(65536, dtype=np.uint32)
    unsure = np.zeros(65536, bool)
    letter = np.zeros(65536, bool)
    shape = np.arange(65536, dtype=np.uint16)
    scripts = np.full(65536, 7, np.uint8)
    own = np.zeros(65536, np.uint8)
    spell = np.zeros((3, 65536), np.uint16)
    base = {ord(c): ord(row[0]) for row in SHAPES for c in row if c != "-"} | {ord(c): ord(x) for c, x in MORE_SHAPES.items()}
    more: dict[tuple[int, str], list[int]] = {}
    classes: dict[tuple[int, str], dict[int, int]] = {}
    for c in range(65536):
        if 0xD800 <= c < 0xE000 or c == _GONE:
            continue
        ch, kind = chr(c), unicodedata.category(chr(c))
        if kind == "Zs" or c == 9:
            first[c] = 32
        elif kind == "Cf" and not 0x600 <= c <= 0x6DD and c != 0x070F:
            first[c] = _GONE
        form = unicodedata.decomposition(ch).split()
        if len(form) == 2 and form[0] in ("<wide>", "<narrow>"):
            first[c] = int(form[1], 16)
        letter[c] = kind[0] in "LM"
        unsure[c] = unicodedata.normalize("NFC", ch) != ch or kind[0] == "M" or 0x1161 <= c <= 0x11C2
        if kind[0] == "L" and (bit := _script(c)):
            scripts[c] = own[c] = bit
            parts = unicodedata.normalize("NFD", ch)
            if ord(parts[0]) in base and all(unicodedata.combining(x) for x in parts[1:]) and unicodedata.normalize("NFC", ch) == ch:
                key = (base[ord(parts[0])], parts[1:])
                if parts[0] in MORE_SHAPES:
                    more.setdefault(key, []).append(c)
                else:
                    classes.setdefault(key, {})[bit] = c
    for a, z in SHAPELESS:
        first[a : z + 1] = _GONE
    composed = {}
    for key, members in classes.items():
        rep = min(members.values())
        composed[key] = rep
        bits = 0
        for bit, c in members.items():
            bits |= bit
        for bit, c in members.items():
            spell[bit.bit_length() - 1, rep] = c
        scripts[rep] = bits
        for c in [*members.values(), *more.get(key, ())]:
            shape[c], scripts[c] = rep, bits
    return first, unsure, letter, shape, scripts, spell, composed, own


def _composed(text: str) -> str:
    """NFC, and accents on a letter composed in another script of its shape where its own has no such letter."""
    composed = _tables()[6]
    base = {ord(c): ord(row[0]) for row in SHAPES for c in row if c != "-"} | {ord(c): ord(x) for c, x in MORE_SHAPES.items()}

    def one(m: re.Match) -> str:
        parts = unicodedata.normalize("NFD", m.group())
        key = (base.get(ord(parts[0])), parts[1:])
        return chr(composed[key]) if key in composed else m.group()

    return _MARKED.sub(one, unicodedata.normalize("NFC", text))


def _resolve(cp: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points in the consistent spelling, mixed-script tokens and whole-script confusables by row). ``row``: the row
    of each; rows are apart by a line feed."""
    _, _, letter, shape, scripts, spell, _, own = _tables()
    low = np.where(cp < 65536, cp, _GONE).astype(np.uint16)
    is_letter = letter[low]
    at = np.flatnonzero(is_letter)
    if not len(at):
        return cp, np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    begins = np.append(True, at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(begins)
    shapes = shape[low[at]]
    masks = scripts[shapes]
    common = np.bitwise_and.reduceat(masks, starts)
    length = np.diff(np.append(starts, len(at)))
    token_row = row[at[starts]]
    index = np.array([0, 0, 1, 0, 2, 0, 0, 0])  # script of a single bit
    single = (common == 1) | (common == 2) | (common == 4)
    votes = np.bincount(token_row[single] * 3 + index[common[single]], length[single], rows * 3).reshape(rows, 3)
    main = votes.argmax(1)[token_row]
    lowest = np.array([0, 0, 1, 0, 2, 0, 1, 0])
    script = np.where(single, index[common], np.where((common >> main) & 1, main, lowest[common]))
    mixed = np.flatnonzero(common == 0)
    several = np.minimum.reduceat((spell > 0).sum(0).astype(np.uint8)[shapes], starts) > 1  # each letter has a double elsewhere
    whole = np.bincount(token_row[several & ~single & (common > 0)], minlength=rows)
    if len(mixed):
        which = np.full(len(starts), -1)
        which[mixed] = np.arange(len(mixed))
        of = np.repeat(which, length)
        sure = (of >= 0) & ((masks == 1) | (masks == 2) | (masks == 4))
        most = np.bincount(of[sure] * 3 + index[masks[sure]], minlength=len(mixed) * 3).reshape(-1, 3).astype(float)
        most[np.arange(len(mixed)), main[mixed]] += 0.5 * (most[np.arange(len(mixed)), main[mixed]] > 0)  # ties go with the text
        script[mixed] = most.argmax(1)
    written = spell[np.repeat(script, length), shapes]
    # A shape that the script lacks is written as its representative; letters of no shape class are that themselves.
    out = cp.copy()
    known = low[at] != _GONE
    out[at[known]] = np.where(written > 0, written, shapes)[known]
    as_stored = np.bitwise_or.reduceat(own[low[at]], starts)
    return out, np.bincount(token_row[np.isin(as_stored, (3, 5, 6, 7))], minlength=rows), whole


def consistent(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets) of the consistent forms of a batch, and the tokens of each text that mix scripts or could be
    written in another script throughout."""
    first, unsure = _tables()[:2]
    cp = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    low = np.where(cp < 65536, cp, 0)
    now = np.where(cp < 65536, first[low], cp)
    keep = (now != _GONE) & ((cp < _TAGS[0]) | (cp > _TAGS[1]))
    now, row = now[keep], row[keep]
    odd = np.unique(row[unsure[np.where(now < 65536, now, 0)] | (now >= 65536)])
    if len(odd):
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        parts, last = [], 0
        for r in odd:
            done = _composed(now[cuts[r] : cuts[r + 1]].tobytes().decode("utf-32-le"))
            parts += [now[last : cuts[r]], np.frombuffer(done.encode("utf-32-le"), np.uint32)]
            last = cuts[r + 1]
        parts.append(now[last:])
        sizes = np.diff(cuts)
        sizes[odd] = [len(p) for p in parts[1::2]]
        now, row = np.concatenate(parts), np.repeat(np.arange(len(texts)), sizes)
    offsets = np.searchsorted(row, np.arange(len(texts) + 1))
    made, mixed, whole = _resolve(now, row, len(texts))
    return made, offsets, mixed, whole


def consistent_form(text: str) -> str:
    """The form of one text."""
    cp = consistent([text])[0]
    return cp[:-1].tobytes().decode("utf-32-le")


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def forms(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, form, n_mixed, n_whole) for every row: the form, null for null text, and how many tokens mix scripts or are
    whole-script confusables. No shuffle."""
    ship(df.sparkSession)
    schema = pa.schema([("row_id", pa.int64()), ("form", pa.string()), ("n_mixed", pa.int32()), ("n_whole", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in _batches([t or "" for t in texts]):
                cp, off, mixed, several = consistent([t or "" for t in texts[a:z]])
                whole = cp.tobytes().decode("utf-32-le")
                made = [None if t is None else whole[off[i] : off[i + 1] - 1] for i, t in enumerate(texts[a:z])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).cast(pa.int64()), pa.array(made, pa.string()), pa.array(mixed, pa.int32()), pa.array(several, pa.int32())], schema=schema)

    return df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("t")).mapInArrow(run, "row_id bigint, form string, n_mixed int, n_whole int")


def form_keys(df: DataFrame, row_id: str, group: str, text: str) -> DataFrame:
    """(row_id, grp, f1, f2, t1, t2) for texts neither null nor empty: 128-bit hashes of form and text. No shuffle."""
    ship(df.sparkSession)
    names = ("f1", "f2", "t1", "t2")
    schema = pa.schema([("row_id", pa.int64()), ("grp", pa.string()), *[(n, pa.int64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, z in _batches(texts):
                cp, off, _, _ = consistent(texts[a:z])
                view = memoryview(cp).cast("B")
                digest = b"".join(xxhash.xxh3_128_digest(view[4 * off[i] : 4 * off[i + 1]]) + xxhash.xxh3_128_digest(texts[a + i].encode("utf-8", "surrogatepass")) for i in range(z - a))
                words = np.frombuffer(digest, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).cast(pa.int64()), batch.column(1).slice(a, z - a).cast(pa.string()), *[pa.array(words[:, k]) for k in range(4)]], schema=schema)

    source = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(group).cast("string").alias("grp"), F.col(text).alias("t"))
    return source.filter("t is not null and t <> '' and grp is not null").mapInArrow(run, "row_id bigint, grp string, f1 bigint, f2 bigint, t1 bigint, t2 bigint")


def _mixed_rows(keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the forms that occur in more than one spelling; one aggregation, so that groups of one string, however many
    rows they have, drop out before anything is joined."""
    spelling = F.struct("t1", "t2")
    mixed = keys.groupBy(*on).agg(F.min(spelling).alias("lo"), F.max(spelling).alias("hi")).filter("lo <> hi").select(*on)
    return materialise(keys.join(mixed, on, "left_semi"))  # few rows, read by several branches


def lookalike_pairs(keys: DataFrame, by: list[str]) -> DataFrame:
    """(*by, id_a, id_b): rows of one group with the same form and different texts. ``keys`` is read more than once and
    should be materialised. The distinct spellings of a form are paired, then each side takes its rows, so copies of one
    spelling never meet each other and every candidate is a pair."""
    on = [*by, "f1", "f2"]
    rows = _mixed_rows(keys, on)
    spellings = rows.select(*on, "t1", "t2").distinct()
    other = spellings.withColumnsRenamed({"t1": "u1", "t2": "u2"})
    pairs = spellings.join(other, on).filter("t1 < u1 or (t1 = u1 and t2 < u2)")
    left = pairs.join(rows.select(*on, "t1", "t2", F.col("row_id").alias("a")), [*on, "t1", "t2"]).select(*on, "u1", "u2", "a")
    both = left.join(rows.select(*on, F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("row_id").alias("b")), [*on, "u1", "u2"])
    return both.select(*by, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).filter("id_a < id_b")


def lookalike_classes(keys: DataFrame, by: list[str]) -> DataFrame:
    """(*by, class_id, row_id, n_rows, n_spellings): the rows of forms with several spellings, each with its class, named by
    its least id. Its size is that of the rows, however many pairs they make."""
    on = [*by, "f1", "f2"]
    rows = _mixed_rows(keys, on)
    spelled = rows.groupBy(*on, "t1", "t2").agg(F.count("*").alias("n"), F.min("row_id").alias("least"))
    classes = spelled.groupBy(*on).agg(F.min("least").alias("class_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"))
    return rows.join(classes, on).select(*by, "class_id", "row_id", "n_rows", "n_spellings")
