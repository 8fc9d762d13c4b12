"""Queries of the text problems 1, 4, 7, 8 and 9 over their whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from .encoding import encode
from .language import label_language, line_languages, train
from .lookalikes import MORE_SHAPES, SHAPES, form_keys, forms, lookalike_classes, lookalike_pairs
from .mixing import Mix, mix
from .splitting import LIMIT, OVERLAP, split

_LONG = (("article_texts", "article_id", "text"), ("marker_bodies", "marker_id", "body"))
_LOOKS = (("article_texts", "article_id", "text"), ("observations", "obs_id", "context_sample"), ("open_blocks", "block_id", "text"))


def _named(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("tbl"), "*")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_named(t, split(table(spark, d, t), i, c)) for t, i, c in _LONG])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each text that the splitter cut; its first piece stands for it."""
    return p1_pieces(spark, d).filter("piece_no = 0").select("tbl", "row_id")


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each text put together again, with the longest piece and the overlaps that aren't the end of the piece
    before: what the limit, the overlap and the wholeness of the texts can be checked by."""
    p = p1_pieces(spark, d).groupBy("tbl", "row_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))).alias("p"))  # one text a row
    tails = F.transform(F.slice("p", 2, F.size("p")), lambda x, i: (F.substring(x["piece"], 1, OVERLAP) != F.right(F.get("p", i)["piece"], F.lit(OVERLAP))).cast("bigint"))
    whole = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(x["piece"].substr(F.lit(OVERLAP + 1), F.length(x["piece"])))), "")
    longest = F.array_max(F.transform("p", lambda x: F.length(x["piece"])))
    return p.select("tbl", "row_id", F.md5(whole).alias("text_md5"), (longest <= LIMIT).alias("within_limit"), F.aggregate(tails, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("bad_overlaps"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_named(t, forms(table(spark, d, t), i, c)) for t, i, c in _LOOKS])


def _form_keys(spark: SparkSession, d: str) -> DataFrame:
    return materialise(reduce(DataFrame.unionByName, [_named(t, form_keys(table(spark, d, t), i, "work_id", c)) for t, i, c in _LOOKS]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(_form_keys(spark, d), ["tbl", "grp"]).select("tbl", "id_a", "id_b")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each row whose text looks like another one of its work, with its class; the pairs of p4_found without expanding them."""
    return lookalike_classes(_form_keys(spark, d), ["tbl", "grp"]).select("tbl", F.col("grp").alias("work_id"), "class_id", "row_id", "n_rows", "n_spellings")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> Mix:
    counts = encode(table(spark, d, "documents").filter("source is not null"), "doc_id", "text", "count", keep=["source"])
    return mix(counts, table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report


def p8_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source came as near to its target share as whole blocks and documents allow (a hundredth and the size of its
    two largest documents in the mix) and no document passed its cap."""
    m = _mix(spark, d)
    largest = m.rows.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    r = m.report.join(largest, "source", "left").crossJoin(m.report.agg(F.sum("tokens").alias("all_tokens")))  # one row by one a source
    grain = 0.01 + 2 * F.coalesce(F.col("largest"), F.lit(0)) / F.greatest("all_tokens", F.lit(1))
    return r.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) < grain).alias("share_reached"), (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"))


def _line_languages(spark: SparkSession, d: str, min_chars: int, every: bool = False) -> DataFrame:
    docs = table(spark, d, "documents")
    return line_languages(docs, "doc_id", "text", train(docs, "doc_id", "text", "lang"), min_chars, every)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "documents").select("doc_id", label_language("lang").alias("label"))
    seen = _line_languages(spark, d, 60).select("doc_id", "lang").distinct()
    return seen.join(labels, "doc_id").filter("label is null or label <> lang").select("doc_id", "lang").distinct()


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every line that isn't blank, however short, with its language or 'none' where it has too few letters or words for one;
    the 60 characters are p9_found's alone."""
    return _line_languages(spark, d, 1, True)


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """The language of most characters of each document's lines, with the share-weighted confidence and the label's language.
    A document without a line of its own that tells is judged by its whole text; is there nothing to tell by (null, blank,
    figures), its language is 'none' with confidence 0. Every doc_id has a row."""
    docs = table(spark, d, "documents")
    model = train(docs, "doc_id", "text", "lang")
    lines = materialise(line_languages(docs, "doc_id", "text", model, 1))
    silent = docs.join(lines.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("text", F.regexp_replace("text", r"[\r\n]+", " "))
    by = lines.unionByName(line_languages(silent, "doc_id", "text", model, 1)).groupBy("doc_id", "lang").agg(F.sum("n_chars").alias("n"), F.sum(F.col("n_chars") * F.col("confidence")).alias("w"))
    best = by.groupBy("doc_id").agg(F.max(F.struct("n", "lang", "w")).alias("b"), F.sum("n").alias("all"))
    labels = docs.groupBy("doc_id").agg(F.min(label_language("lang")).alias("label"))
    told = labels.filter("doc_id is not null").join(best, "doc_id", "left")
    return told.select("doc_id", F.coalesce("b.lang", F.lit("none")).alias("lang"), F.coalesce(F.round(F.col("b.w") / F.col("all"), 6), F.lit(0.0)).alias("confidence"), F.coalesce("label", F.lit("")).alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rejoined": p1_rejoined, "p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms, "p7_ids": p7_ids,
    "p8_mix": p8_mix, "p8_report": p8_report, "p8_within": p8_within, "p9_found": p9_found, "p9_segments": p9_segments, "p9_documents": p9_documents,
}

#: The look of a text in SQL: NFC, one kind of space, no formatting characters, narrow forms, and one letter for each shape.
_FROM, _TO = zip(*[(c, row[0]) for row in SHAPES for c in row[1:] if c != "-"], *MORE_SHAPES.items())
_WIDE = [chr(c) for c in range(0xFF01, 0xFF5F)]


def _look(c: str) -> str:
    plain = f"translate(regexp_replace(regexp_replace(nfc_normalize({c}), '[\\p{{Zs}}\\t]', ' ', 'g'), '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{180B}}-\\x{{180F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g'), '{''.join(_WIDE).replace(chr(39), chr(39) * 2)}', '{''.join(chr(ord(w) - 0xFEE0) for w in _WIDE).replace(chr(39), chr(39) * 2)}')"
    # Accents apart, letters by shape, accents together again, so that a letter's accents don't hide its shape.
    return f"nfc_normalize(translate({_apart(plain)}, '{''.join(_FROM)}', '{''.join(_TO)}'))"


def _apart(c: str) -> str:
    """Composed letters of the Latin, Greek and Cyrillic blocks as base and accents."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))) for a, z in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)) for k in range(a, z) if unicodedata.normalize("NFC", chr(k)) == chr(k)]
    shaped = {x for row in SHAPES for x in row} | set(MORE_SHAPES)
    for one, parts in pairs:
        if len(parts) > 1 and parts[0] in shaped:
            c = f"replace({c}, '{one}', '{parts}')"
    return c


_ALIKE = "WITH k AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tbl, {i} AS id, work_id, {c} AS t FROM {t} WHERE {c} <> '' AND work_id IS NOT NULL" for t, i, c in _LOOKS) + f"), l AS MATERIALIZED (SELECT tbl, id, work_id, t, {_look('t')} AS look FROM k)"

ORACLES: dict[str, str] = {
    "p1_found": f"SELECT 'article_texts' AS tbl, article_id AS row_id FROM article_texts WHERE length(text) > {LIMIT} UNION ALL SELECT 'marker_bodies', marker_id FROM marker_bodies WHERE length(body) > {LIMIT}",
    "p1_rejoined": " UNION ALL ".join(f"SELECT '{t}' AS tbl, {i} AS row_id, md5({c}) AS text_md5, true AS within_limit, 0::bigint AS bad_overlaps FROM {t} WHERE length({c}) > {LIMIT}" for t, i, c in _LONG),
    "p4_found": f"{_ALIKE} SELECT a.tbl, a.id AS id_a, b.id AS id_b FROM l a JOIN l b ON a.tbl = b.tbl AND a.work_id = b.work_id AND a.look = b.look WHERE a.id < b.id AND a.t <> b.t",
    "p4_classes": f"{_ALIKE} SELECT tbl, work_id, class_id, id AS row_id, n_rows, n_spellings FROM l JOIN (SELECT tbl, work_id, look, min(id) AS class_id, count(*) AS n_rows, count(DISTINCT t) AS n_spellings FROM l GROUP BY 1, 2, 3 HAVING count(DISTINCT t) > 1) USING (tbl, work_id, look)",
    "p8_within": "SELECT source, true AS share_reached, true AS cap_kept FROM mix_targets",
}
