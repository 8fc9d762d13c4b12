"""Ladders of structural units: numbered and surface styles, and near misses of a document's structure.

A ladder is a list of entries (token, role, suffix, number_style, compound, recursive, surface), as data in the order of
their precedence; group and token are catalog names, never raw text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V
from ..functions.hashing import fnv1a64

DEPTH, TOKEN = "DepthOverflow", "NonCatalogToken"


def numbered_pattern(entry: dict) -> str | None:
    """Pattern of an entry's numbers at the start of a text, None for entries without a suffix."""
    if not entry.get("suffix"):
        return None
    sign = "".join(f"\\{c}" for c in entry["suffix"])
    if entry.get("number_style", "digit") == "letter_cyrillic":
        return f"^[а-я]{sign}"
    return ("^[0-9]+(?:\\.[0-9]+)*" if entry.get("compound") or entry.get("recursive") else "^[0-9]+") + sign


def numbered_match(text: Column, entry: dict) -> Column:
    """Whether a text opens with the entry's number: digits, compound ones where declared, or one small Cyrillic letter."""
    pattern = numbered_pattern(entry)
    return F.lit(False) if pattern is None else F.coalesce(text.rlike(pattern), F.lit(False))


def surface_prefix(text: Column, surface: str) -> Column:
    """Whether a text opens with the surface, in any case and not inside a longer word."""
    low = F.lower(text)
    return F.coalesce(low.startswith(surface.lower()) & ~low.substr(F.lit(len(surface) + 1), F.lit(1)).rlike(r"\p{L}"), F.lit(False))


def style_match(text: Column, ladder: list[dict]) -> Column:
    """Token of the first entry whose numbers match; surface entries don't take part; null if none does."""
    out = F.lit(None).cast("string")
    for entry in reversed(ladder):
        if not entry.get("surface"):
            out = F.when(numbered_match(text, entry), entry["token"]).otherwise(out)
    return out


def number_style(level: Column) -> Column:
    """Roman numbers or digits for the two upper levels, digits for the others, null for no level."""
    return F.when(level.isin(V.LEVELS[:2]), "roman_or_digit").when(level.isin(V.LEVELS), "digit")


def structural_fingerprint(kind: Column, group: Column, token: Column) -> Column:
    return fnv1a64(F.concat(kind, F.lit("|"), F.lower(F.trim(group)), F.lit("|"), F.lower(F.trim(token))))


def near_misses(rows: DataFrame, caps: dict[str, int], ladders: dict[str, list[str]]) -> DataFrame:
    """(kind, group, token, depth, cap) of rows (group, token, depth): a token deeper than its group's cap, or one that the
    group's ladder lacks (tokens compare in any case). Rows that are in order, or of unknown groups, give nothing."""
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("group"))
    known = F.lit(False)
    for group, tokens in ladders.items():
        known = known | ((F.col("group") == group) & F.lower("token").isin([t.lower() for t in tokens]))
    kind = F.when(F.col("group").isin(list(ladders)) & ~known, TOKEN).when(F.col("depth") > cap, DEPTH)
    return rows.select(kind.alias("kind"), "group", "token", F.when(kind == DEPTH, F.col("depth")).alias("depth"), F.when(kind == DEPTH, cap).alias("cap")).filter("kind is not null")


def near_miss_census(events: DataFrame, patched: DataFrame | None = None) -> DataFrame:
    """(kind, fingerprint, group, token, n, max_depth) with group and token in lower case, less what is already patched
    (kind, fingerprint)."""
    g = events.groupBy("kind", F.lower("group").alias("group"), F.lower("token").alias("token")).agg(F.count("*").alias("n"), F.max("depth").alias("max_depth"))
    g = g.withColumn("fingerprint", structural_fingerprint(F.col("kind"), F.col("group"), F.col("token")))
    if patched is not None:
        g = g.join(patched.select("kind", "fingerprint").distinct(), ["kind", "fingerprint"], "left_anti")
    return g.select("kind", "fingerprint", "group", "token", "n", "max_depth")


def ranked_near_misses(census: DataFrame) -> DataFrame:
    """The census with rank by count downwards, then token; as many rows as the catalogs have names."""
    return census.select(F.row_number().over(W.orderBy(F.desc("n"), "token", "kind", "group")).alias("rank"), "*").orderBy("rank")


def report_line() -> Column:
    """One line of a census report: fingerprints and counts, no names."""
    return F.format_string("- {kind: %s, fingerprint: %s, count: %d}", "kind", "fingerprint", "n")


def proposal_line() -> Column:
    """One line of a profile extension: a deeper cap, or a token for the ladder."""
    deeper = F.format_string("- {kind: %s, group: %s, token: %s, max_depth: %d, count: %d}", "kind", "group", "token", F.coalesce("max_depth", F.lit(0)), "n")
    return F.when(F.col("kind") == DEPTH, deeper).otherwise(F.format_string("- {kind: %s, group: %s, token: %s, count: %d}", "kind", "group", "token", "n"))


def parse_proposal(line: Column) -> Column:
    """Struct (kind, group, token, max_depth, count, fingerprint, error) of such a line."""
    p = r"^- \{kind: (\w+), group: ([^,}]+), token: ([^,}]+)(?:, max_depth: (\d{1,9}))?, count: (\d{1,18})\}\z"
    part = [F.regexp_extract(line, p, k) for k in range(1, 6)]
    ok = F.coalesce(line.rlike(p), F.lit(False)) & (((part[0] == DEPTH) & (part[3] != "")) | ((part[0] == TOKEN) & (part[3] == "")))
    keep = [F.when(ok, x) for x in part]
    return F.struct(
        keep[0].alias("kind"), keep[1].alias("group"), keep[2].alias("token"), F.when(ok & (part[3] != "") , part[3].try_cast("int")).alias("max_depth"), F.when(ok, part[4].try_cast("bigint")).alias("count"),
        F.when(ok, structural_fingerprint(part[0], part[1], part[2])).alias("fingerprint"), F.when(ok, "").otherwise("malformed").alias("error"),
    )
