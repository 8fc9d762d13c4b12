"""Civil-day ordinals and dates found in names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import MONTHS

EPOCH, MIN_YEAR, MAX_YEAR = "1800-01-01", 1800, 2100


def iso_shape(c: Column) -> Column:
    """Shape only: 2023-99-99 passes."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def _date(c: Column, form: str) -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit(form)))


def day_ordinal(c: Column) -> Column:
    """Days since 1800-01-01; null for a wrong shape, a day that doesn't exist or a year out of bounds."""
    d = F.when(iso_shape(c), _date(c, "yyyy-MM-dd"))
    return F.when(F.year(d).between(MIN_YEAR, MAX_YEAR), F.datediff(d, F.lit(EPOCH).cast("date")))


def day_error(c: Column) -> Column:
    d = F.when(iso_shape(c), _date(c, "yyyy-MM-dd"))
    return F.when(~iso_shape(c), "shape").when(d.isNull(), "no such day").when(~F.year(d).between(MIN_YEAR, MAX_YEAR), "out of bounds").otherwise("")


def ordinal_day(n: Column) -> Column:
    """ISO day of an ordinal, null out of bounds."""
    last = F.datediff(F.lit(f"{MAX_YEAR}-12-31").cast("date"), F.lit(EPOCH).cast("date"))
    return F.when(n.between(0, last), F.date_format(F.date_add(F.lit(EPOCH).cast("date"), n.cast("int")), "yyyy-MM-dd"))


def date_in_name(c: Column) -> Column:
    """ISO date of a name: a day with a month's name first, else DD-MM-YYYY or DD.MM.YYYY; null if there is none."""
    low = F.lower(c)
    months = "|".join(MONTHS)
    words = rf"(\d{{1,2}})\s+({months})\s+(\d{{4}})"
    number = F.lit(None).cast("int")
    for name, k in MONTHS.items():
        number = F.when(F.regexp_extract(low, words, 2) == name, k).otherwise(number)
    figures = r"(\d{2})[-.](\d{2})[-.](\d{4})"
    spelled = F.format_string("%s-%02d-%s", F.regexp_extract(low, words, 3), number, F.lpad(F.regexp_extract(low, words, 1), 2, "0"))
    plain = F.concat_ws("-", *[F.regexp_extract(low, figures, k) for k in (3, 2, 1)])
    return F.when(low.rlike(words), spelled).when(low.rlike(figures), plain)


def act_number_in_name(c: Column) -> Column:
    """Up to five digits after 'n ', the numero sign or 'pp_'; null if there is none."""
    low = F.lower(c)
    found = [F.regexp_extract(low, p, 1) for p in (r"(?:^|[^\p{L}])n\s+(\d{1,5})", r"№\s*(\d{1,5})", r"pp_(\d{1,5})")]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def law_path(c: Column) -> Column:
    """Struct (date, number) of law_DATE_N-fz before '/', '_' or the end, the number with its '-fz'; null if there is none."""
    p = r"law_([0-9]{4}-[0-9]{2}-[0-9]{2})_([^/_]+-fz)(?=[/_]|\z)"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("date"), F.regexp_extract(c, p, 2).alias("number")))


def revision_path(c: Column) -> Column:
    """Date of rev-DATE before '_', '/' or the end; null if there is none."""
    p = r"rev-([0-9]{4}-[0-9]{2}-[0-9]{2})(?=[/_]|\z)"
    return F.when(c.rlike(p), F.regexp_extract(c, p, 1))


def edition_file(c: Column) -> Column:
    """Struct (edition_number, revision) of a file edition-N_rev-REVISION_...: the number up to '_', the revision after the
    first '_rev-' up to '_', without 'from-'; null for other names."""
    name = F.element_at(F.split(c, "/"), -1)
    number = F.try_to_number(F.regexp_extract(name, r"^edition-\+?([0-9]{1,10})_", 1), F.lit("9999999999")).cast("bigint")
    revision = F.regexp_replace(F.regexp_extract(name, "_rev-([^_]*)", 1), "^(from-)+", "")
    return F.when(name.rlike(r"^edition-\+?[0-9]{1,10}_") & F.contains(name, F.lit("_rev-")) & (number < 1 << 32), F.struct(number.alias("edition_number"), revision.alias("revision")))
