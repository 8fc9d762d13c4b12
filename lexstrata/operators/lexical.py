"""Tokens, sentences, mentions, markers, phrases and unknown forms of text blocks.

Offsets are UTF-8 bytes, half open. Positions come from arrays over whole batches (tokens) or from patterns; all other
operators are expressions inside the engine. Blocks of style ProviderComment are to be filtered out before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V
from ..functions.hashing import fnv1a64
from ..session import ship


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: letter, white space."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]), np.array([chr(c).isspace() for c in range(0x110000)])


def tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, token, start, end, spaced): runs of letters in lower case with byte offsets, and whether nothing but white
    space lies between a token and the one before; null and '' give no rows."""
    ship(df.sparkSession)
    source = df.select(*keys, F.col(text).alias("__t")).filter("__t <> ''")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", pos int, token string, start bigint, end bigint, spaced boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, spaces = _letters()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a in range(0, len(texts), 500):
                some = texts[a : a + 500]
                whole = "\n".join(some) + "\n"
                cp = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
                width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
                byte = np.cumsum(width) - width
                first = np.cumsum([0] + [len(t) + 1 for t in some[:-1]])
                is_letter = letters[cp]
                starts = np.flatnonzero(is_letter & ~np.append(False, is_letter[:-1]))
                ends = np.flatnonzero(is_letter & ~np.append(is_letter[1:], False)) + 1
                row = np.searchsorted(first, starts, "right") - 1
                base = byte[first[row]]
                begin = np.searchsorted(row, np.arange(len(some)))
                pos = np.arange(len(starts)) - begin[row]
                other = np.cumsum(~is_letter & ~spaces[cp])
                spaced = (pos > 0) & (other[starts] == other[np.append(0, ends[:-1]) - (np.arange(len(ends)) > 0)])
                words = [whole[s:e].lower() for s, e in zip(starts.tolist(), ends.tolist())]
                keyed = [batch.column(i).slice(a, len(some)).take(pa.array(row)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*keyed, pa.array(pos, pa.int32()), pa.array(words, pa.string()), pa.array(byte[starts] - base), pa.array(byte[ends] - base), pa.array(spaced)], names=[*batch.schema.names[:-1], "pos", "token", "start", "end", "spaced"])

    return source.mapInArrow(run, ddl)


_END = re.compile(rf"[.!?]+[{re.escape(V.CLOSING)}]*")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of sentences: runs of . ! ? with closing signs end one, except after short words, inside decimals
    and after a number that opens the sentence."""
    out, begin = [], 0
    for m in _END.finditer(text):
        i, last = m.start(), m.end()
        if text[i] == "." and last - i == 1:
            word = re.search(r"[^\W\d_]+\Z", text[max(0, i - 12) : i])
            if word and word.group().lower() in V.ABBREVIATIONS:
                continue
            if i and text[i - 1].isdigit() and text[i - 1].isascii() and text[last : last + 1].isascii() and text[last : last + 1].isdigit():
                continue
            head = text[begin:i].strip()
            if head and head.isascii() and head.isdigit() and text[last : last + 1].isspace():
                continue
        part = text[begin:last]
        if part.strip():
            out.append((begin + len(part) - len(part.lstrip()), last - (len(part) - len(part.rstrip()))))
        begin = last
    part = text[begin:]
    if part.strip():
        out.append((begin + len(part) - len(part.lstrip()), len(text) - (len(part) - len(part.rstrip()))))
    return out


def sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, start, end, sentence) with byte offsets."""
    ship(df.sparkSession)
    source = df.select(*keys, F.col(text).alias("__t")).filter("__t <> ''")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", pos int, start bigint, end bigint, sentence string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for r, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                at = char = 0
                for k, (a, z) in enumerate(sentence_spans(t)):
                    at += len(t[char:a].encode())
                    size = len(t[a:z].encode())
                    rows.append(r)
                    for c, v in zip(cols, (k, at, at + size, t[a:z])):
                        c.append(v)
                    at, char = at + size, z
            keyed = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keyed, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=[*batch.schema.names[:-1], "pos", "start", "end", "sentence"])

    return source.mapInArrow(run, ddl)


def mentions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ord, kind, number): an inflected article or point term, spaces or tabs, a dotted number; not before '..',
    '.x', a letter or '_'. Quantifiers are possessive, so a number is never shortened to make a match."""
    forms = "|".join(sorted(V.ARTICLE_FORMS + V.POINT_FORMS, key=len, reverse=True))
    pattern = rf"(?iu)(?<!\p{{L}})(?:{forms})[ \t]++\d++(?:\.\d++)*+(?!\.\.|\.\p{{L}}|[\p{{L}}_])"
    hit = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("ord", "hit"))
    kind = F.when(F.lower(F.regexp_extract("hit", r"^(\p{L}+)", 1)).isin(V.ARTICLE_FORMS), "article").otherwise("point")
    return hit.select(*keys, "ord", kind.alias("kind"), F.regexp_extract("hit", r"([\d.]+)$", 1).alias("number"))


#: White space in patterns of both engines: the property White_Space.
SPACE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
NUMBER = "[0-9]+(?:\\.[0-9]+)*"


def marker_pattern() -> str:
    """Groups: word with a number or Roman number, its number, word with a number, its number, section sign's number, a bare
    number, its sign, the title."""
    roman = "|".join(w for lv in ("razdel", "glava") for w in V.MARKER_PREFIXES[lv])
    plain = "|".join(V.MARKER_PREFIXES["statya"])
    return f"(?s)^{SPACE}*(?:(?:({roman}){SPACE}+({NUMBER}|[IVXLCDMivxlcdm]+)|({plain}){SPACE}+({NUMBER})|§{SPACE}*({NUMBER}))[.:)]|({NUMBER})([.)]))(?:{SPACE}(.*))?$"


def marker(text: Column) -> Column:
    """Struct (level, number, title) of a block that opens with a hierarchy marker, else null: white space, a prefix word
    with its number (Roman ones of I V X L C D M in either case for the two upper levels) or a bare number, then one of
    . : ) and white space or the end; bare numbers take '.' (chast) or ')' (punkt). Letters are no numbers here."""
    p = marker_pattern().removesuffix("$") + r"\z"
    part = {k: F.regexp_extract(text, p, k) for k in range(1, 9)}
    level = F.coalesce(*[F.when(part[k].isin(ws), lv) for lv, ws in V.MARKER_PREFIXES.items() for k in (1, 3)], F.when(part[5] != "", "paragraph"), F.when(part[7] == ".", "chast").otherwise("punkt"))
    number = F.concat(part[2], part[4], part[5], part[6])
    title = F.regexp_replace(part[8], f"^{SPACE}+|{SPACE}+\\z", "")
    return F.when(text.rlike(p), F.struct(level.alias("level"), number.alias("number"), title.alias("title")))


def _lookup(word: Column, classes: dict[str, list[str]]) -> Column:
    """The class whose list holds the word, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, ws in classes.items() for w in ws for x in (w, k)]), word)


def morphology(token_rows: DataFrame, by: list[str]) -> DataFrame:
    """Token rows that are legal marker words, with kind and ``negated``: the token just before is the negation, with
    nothing but white space between."""
    before = F.lag("token").over(W.partitionBy(*by).orderBy("pos"))
    return token_rows.withColumns({"kind": _lookup(F.col("token"), V.MARKER_WORDS), "b": before}).filter("kind is not null").select(
        *by, "pos", "token", "start", "end", "kind", F.coalesce((F.col("b") == "не") & F.col("spaced"), F.lit(False)).alias("negated")
    )


def words(df: DataFrame, keys: list[str], text: str, classes: dict[str, list[str]]) -> DataFrame:
    """(keys, ord, kind, token, negated): the words of the classes as whole tokens, as morphology and unknown_forms find
    them, without offsets; only the words found leave the text. Few words are looked for by one pattern."""
    some = "|".join(sorted((w for ws in classes.values() for w in ws), key=len, reverse=True))
    pattern = rf"(?<!\p{{L}})(?:не{SPACE}++)?(?:{some})(?!\p{{L}})"
    hit = df.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("ord", "hit"))
    token = F.regexp_extract("hit", r"(\p{L}+)\z", 1)
    return hit.select(*keys, "ord", token.alias("token"), F.col("hit").rlike(rf"^не{SPACE}").alias("negated")).withColumn("kind", _lookup(F.col("token"), classes))


def listed_words(df: DataFrame, keys: list[str], text: str, classes: dict[str, list[str]]) -> DataFrame:
    """(keys, ord, kind, token) as ``words`` without negation, for long word lists: the text's tokens meet one hash set."""
    all_tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    found = F.filter(all_tokens, lambda t: t.isin([w for ws in classes.values() for w in ws]))
    return df.select(*keys, F.posexplode(found).alias("ord", "token")).withColumn("kind", _lookup(F.col("token"), classes))


def deontic(marker_rows: DataFrame) -> DataFrame:
    """The three deontic kinds of morphology rows."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in V.DEONTIC.items() for x in kv]), F.col("kind"))
    return marker_rows.withColumn("kind", kind).filter("kind is not null")


def phrases(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ord, kind, phrase): an entry verb, 'в', 'силу', or a loss verb and 'силу', with only spaces or tabs between."""
    entry, loss = "|".join(V.PHRASE_VERBS["enters_into_force"]), "|".join(V.PHRASE_VERBS["loses_force"])
    pattern = rf"(?iu)(?<!\p{{L}})(?:(?:{entry})[ \t]+в|{loss})[ \t]+силу(?!\p{{L}})"
    hit = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("ord", "phrase"))
    enters = F.lower(F.regexp_extract("phrase", r"^(\p{L}+)", 1)).isin(V.PHRASE_VERBS["enters_into_force"])
    return hit.select(*keys, "ord", F.when(enters, "enters_into_force").otherwise("loses_force").alias("kind"), "phrase")


def unknown_forms(token_rows: DataFrame, classes: dict[str, list[str]] | None = None) -> DataFrame:
    """Token rows of unsupported forms with kind and fingerprint."""
    classes = classes or V.UNKNOWN_FORMS
    return token_rows.withColumn("kind", _lookup(F.col("token"), classes)).filter("kind is not null").withColumn("fingerprint", fnv1a64(F.col("token")))


def census(forms: DataFrame, by: list[str]) -> DataFrame:
    """Counts of unknown forms by kind."""
    return forms.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in V.UNKNOWN_FORMS])


def ranked_census(forms: DataFrame, patched: DataFrame | None = None) -> DataFrame:
    """(rank, kind, fingerprint, token, n) by count downwards, then token; less the (kind, fingerprint) already patched. The
    ranks of so many rows as there are forms in the word lists."""
    ranked = forms.groupBy("kind", "fingerprint").agg(F.count("*").alias("n"), F.min("token").alias("token"))
    if patched is not None:
        ranked = ranked.join(patched.select("kind", "fingerprint").distinct(), ["kind", "fingerprint"], "left_anti")
    return ranked.select(F.row_number().over(W.orderBy(F.desc("n"), "token", "kind")).alias("rank"), "kind", "fingerprint", "token", "n").orderBy("rank")


def depth_overflows(markers: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Near misses: rows (level, number) whose number has more parts than its level may have."""
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("level"))
    return markers.withColumns({"depth": F.size(F.split("number", r"\.")), "cap": cap}).filter("depth > cap")


def bodies(blocks: DataFrame, doc: list[str], order: str, is_marker: Column, text: str) -> DataFrame:
    """(doc, marker order, body): the tidy text of the blocks between a marker and the next, joined by line feeds. Blocks
    before the first marker belong to none."""
    run = W.partitionBy(*doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    owned = blocks.withColumns({"__m": is_marker, "__x": F.trim(F.col(text))}).withColumn("__owner", F.last(F.when(F.col("__m"), F.col(order)), True).over(run))
    part = owned.filter("__owner is not null").groupBy(*doc, F.col("__owner").alias("marker"))
    return part.agg(F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(~F.col("__m") & (F.col("__x") != ""), F.struct(F.col(order).alias("o"), F.col("__x").alias("x")))), lambda s: s.isNotNull())), lambda s: s["x"]), "\n").alias("body"))


def unit_owners(blocks: DataFrame, doc: list[str], order: str, unit: Column, reset: Column) -> DataFrame:
    """Blocks with ``owner``: the order of the last unit before them, unless a container or an undeclared marker (reset)
    came in between; unit and reset blocks themselves have no owner."""
    event = F.when(reset, F.lit(-1).cast("bigint")).when(unit, F.col(order).cast("bigint"))
    run = W.partitionBy(*doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.last(event, True).over(run)
    return blocks.withColumn("owner", F.when(event.isNull() & (before >= 0), before))


def resolve_level(token: Column) -> Column:
    """Level of a decoder's token: its alias, itself if it is a level, else null."""
    alias = F.try_element_at(F.create_map(*[F.lit(x) for kv in V.LEVEL_ALIASES.items() for x in kv]), token)
    return F.coalesce(alias, F.when(token.isin(V.LEVELS), token))


def transition_error(source: Column, target: Column, edges: list[tuple[str, str]] | None = None) -> Column:
    """'' for a declared transition, else 'unknown transition'."""
    allowed = F.concat_ws(">", source, target).isin([f"{a}>{b}" for a, b in edges or V.FSM_EDGES])
    return F.when(F.coalesce(allowed, F.lit(False)), "").otherwise("unknown transition")


def structural_probe(blocks: DataFrame, doc: list[str], text: str, unit_patterns: dict[str, str]) -> DataFrame:
    """(doc, one count for each group): blocks that open like a unit of the group. Groups of plain text have no pattern."""
    return blocks.groupBy(*doc).agg(*[F.count_if(F.col(text).rlike(p)).alias(f"n_{g}") for g, p in unit_patterns.items()])


def two_factor(group: Column, probes: dict[str, Column]) -> Column:
    """A group found by metadata counts only if the structure agrees: its probe has a hit, or it has none (plain text)."""
    out = F.lit("unknown")
    for g, n in probes.items():
        out = F.when((group == g) & (n > 0), g).otherwise(out)
    return F.when(group.isNotNull() & ~group.isin(list(probes)) & (group != ""), group).otherwise(out)
