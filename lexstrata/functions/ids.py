"""Validators and minted ids as column expressions: explicit outcome columns, never an exception, never NULL for a failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def id_error(c: str | Column, max_len: int = 64, extra: str = "") -> Column:
    """Reason why a string is no id, checked in the order empty, too long (in bytes), unsupported character; '' if it is one."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(c == "", "empty").when(F.octet_length(c) > max_len, "too long").when(~c.rlike(f"^[A-Za-z0-9_:.{extra}-]+$"), "unsupported character").otherwise("")


def path_error(c: str | Column, max_len: int = 64) -> Column:
    """As id_error with '/' allowed between segments that aren't empty."""
    c = F.coalesce(_col(c), F.lit(""))
    base = id_error(c, max_len, "/")
    return F.when(base != "", base).when(F.exists(F.split(c, "/"), lambda s: s == ""), "empty path segment").otherwise("")


def depth_of(path: str | Column, default: int = 1) -> Column:
    """Segments of a path that aren't empty; 1 where the path is null."""
    path = _col(path)
    return F.when(path.isNull(), default).otherwise(F.size(F.filter(F.split(path, "/"), lambda s: s != "")))


def work_id(authority: Column, date: Column, number: Column) -> tuple[Column, Column]:
    """(id, error) of a work: authority of at most 32 of [a-z0-9-], an ISO date, number of at most 24 of [a-z0-9.-]; the
    first that fails is named."""
    a, d, n = (F.coalesce(x, F.lit("")) for x in (authority, date, number))
    error = (
        F.when(~a.rlike("^[a-z0-9-]{1,32}$"), "authority").when(F.to_date(F.try_to_timestamp(d, F.lit("yyyy-MM-dd"))).isNull() | ~d.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(~n.rlike("^[a-z0-9.-]{1,24}$"), "number").otherwise("")
    )
    return F.when(error == "", F.concat(F.lit("work:ru:"), a, F.lit(":zakon:"), d, F.lit(":"), n)), error


def expression_id(work: Column, day: Column) -> Column:
    return F.concat(F.regexp_replace(work, "^work:", "expr:"), F.lit(":"), day.cast("string"))


def urn(work: Column) -> Column:
    return F.concat(F.lit("urn:eli:"), F.translate(F.regexp_replace(work, "^work:", ""), ":", "/"))


def citation_error(record: Column, span: Column, score: Column) -> Column:
    """Blank id or span, then a score that isn't a finite number from 0 to 1; '' if valid."""
    return (
        F.when(F.trim(F.coalesce(record, F.lit(""))) == "", "blank id")
        .when(F.trim(F.coalesce(span, F.lit(""))) == "", "blank span")
        .when(score.isNull() | F.isnan(score) | ~score.between(0, 1), "score")
        .otherwise("")
    )


def cross_act_edge_error(kind: Column, source: Column, target: Column, provenance: Column, kinds: list[str]) -> Column:
    """Self-edge, unknown kind, missing provenance, in that order."""
    return (
        F.when(source.eqNullSafe(target), "self edge").when(~F.coalesce(kind.isin(kinds), F.lit(False)), "unknown kind").when(F.trim(F.coalesce(provenance, F.lit(""))) == "", "missing provenance").otherwise("")
    )


def compare_acts(id_a: Column, number_a: Column, id_b: Column, number_b: Column) -> Column:
    return F.when(id_a == id_b, "same").when(number_a == number_b, "conflict").otherwise("different")


def bounded_detail(c: Column, most: int = 240) -> Column:
    return F.substring(F.regexp_replace(c, r"\p{Cc}", ""), 1, most)
