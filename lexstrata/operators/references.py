"""References to records that do not exist.

Method: references of composite keys are grouped by their null mask; each mask is anti-joined on its non-null columns
under the declared match semantics. Where records have a validity, the join brings the records of a key (at most FEW) to its
references, so that one shuffle of each side tells missing, deleted and late ones apart. Keys of more records go through a
sweep over the moments asked for, in three levels, so that neither they nor a bulk load fill one task.

Match semantics (those of SQL foreign keys)
  simple   a reference with any null column refers to nothing and is in order
  full     all columns null is in order; some null, some not, is an orphan
  partial  all null is in order; otherwise the non-null columns must occur together in one record

Defined results: repeated references and records change nothing but the number of rows returned; an empty target table
makes every checked reference an orphan; names of other columns may clash, since columns are renamed inside.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import materialise

#: Records of one key that may travel in one row; keys with more are swept, with the same results.
FEW = 64

def _mask(cols: list[str], present: tuple[bool, ...]) -> Column:
    out = F.lit(True)
    for c, p in zip(cols, present):
        out = out & (F.col(c).isNotNull() if p else F.col(c).isNull())
    return out


def _masks(k: int, match: str) -> list[tuple[tuple[bool, ...], str]]:
    """Each null mask with what becomes of it: 'pass', 'orphan' or 'join'."""
    if match not in ("simple", "full", "partial"):
        raise ValueError(f"unknown match semantics {match!r}")
    out = []
    for m in product((True, False), repeat=k):
        if all(m):
            out.append((m, "join"))
        elif not any(m) or match == "simple":
            out.append((m, "pass"))
        else:
            out.append((m, "orphan" if match == "full" else "join"))
    return out


def orphans(refs: DataFrame, ref_cols: list[str], targets: DataFrame, target_cols: list[str], match: str = "simple") -> DataFrame:
    """The rows of ``refs`` that refer to no row of ``targets``, with all their columns."""
    names = [f"__k{i}" for i in range(len(ref_cols))]
    keyed = refs.withColumns({n: F.col(f"`{c}`") for n, c in zip(names, ref_cols)})
    there = targets.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, target_cols)])
    out = keyed.limit(0)
    for present, fate in _masks(len(names), match):
        if fate == "pass":
            continue
        part = keyed.filter(_mask(names, present))
        if fate == "join":
            on = [n for n, p in zip(names, present) if p]
            part = part.join(there.select(*on).na.drop().distinct(), on, "left_anti").select(*keyed.columns)
        out = out.unionByName(part)
    return out.drop(*names)


def _as_of(refs: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """refs (on, __t, others) with ``__live`` (a record valid at __t) and ``__known`` (one recorded by then), for keys of many
    records. The moments at which a key is referred to are swept with its records in three levels (days, minutes, moments),
    so that neither a much-used key nor a bulk load fills one task; then each reference takes its moment's answer."""
    never = F.lit("0001-01-01").cast("timestamp_ntz")
    timed = refs.withColumn("__at", F.coalesce("__t", never))
    asked = timed.select(*on, F.col("__at").alias("at")).distinct().select(*on, "at", F.lit(0).alias("live"), F.lit(0).alias("known"), F.lit(1).alias("is_ref"))
    real = targets.filter("__start is not null")
    counts = F.when(F.col("__end").isNull() | (F.col("__end") > F.col("__start")), 1).otherwise(0)
    begin = real.select(*on, F.col("__start").alias("at"), counts.alias("live"), F.lit(1).alias("known"), F.lit(0).alias("is_ref"))
    end = real.filter("__end > __start").select(*on, F.col("__end").alias("at"), F.lit(-1).alias("live"), F.lit(0).alias("known"), F.lit(0).alias("is_ref"))
    moments = asked.unionByName(begin.unionByName(end).groupBy(*on, "at", "is_ref").agg(F.sum("live").alias("live"), F.sum("known").alias("known")).select(*asked.columns))
    moments = moments.withColumns({"day": F.to_date("at"), "minute": F.date_trunc("minute", "at")})

    def carried(rows: DataFrame, by: list[str], order: str, l: str, k: str) -> DataFrame:
        before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return rows.select(*by, order, F.coalesce(F.sum("l").over(before), F.lit(0)).alias(l), F.coalesce(F.sum("k").over(before), F.lit(0)).alias(k))

    minutes = moments.groupBy(*on, "day", "minute").agg(F.sum("live").alias("l"), F.sum("known").alias("k"))
    days = minutes.groupBy(*on, "day").agg(F.sum("l").alias("l"), F.sum("k").alias("k"))
    base = carried(minutes, [*on, "day"], "minute", "l1", "k1").join(carried(days, on, "day", "l0", "k0"), [*on, "day"])
    within = W.partitionBy(*on, "day", "minute").orderBy("at", "is_ref").rowsBetween(W.unboundedPreceding, 0)  # records of a moment come before references
    swept = moments.withColumns({"l2": F.sum("live").over(within), "k2": F.sum("known").over(within)}).filter("is_ref = 1").join(base, [*on, "day", "minute"])
    answers = swept.select(*on, F.col("at").alias("__at"), (F.col("l0") + F.col("l1") + F.col("l2") > 0).alias("__live"), (F.col("k0") + F.col("k1") + F.col("k2") > 0).alias("__known"))
    return timed.join(answers, [*on, "__at"])


def orphans_as_of(
    refs: DataFrame, ref_cols: list[str], at: str, keep: list[str], targets: DataFrame, target_cols: list[str], start: str, end: str, match: str = "simple"
) -> DataFrame:
    """(*keep, kind) for each reference without a record valid at its time ``at``, i.e. with start <= at and end null or
    later. kind: 'missing' if no record has the key, 'deleted' if one was recorded by then, else 'late'. A null time of
    a reference is before all records, a null start after all references; ends not after the start make a record that
    was never valid. References whose mask is an orphan by the match semantics are 'missing'."""
    names = [f"__k{i}" for i in range(len(ref_cols))]
    r = refs.select(*keep, *[F.col(f"`{c}`").alias(n) for n, c in zip(names, ref_cols)], F.col(f"`{at}`").cast("timestamp_ntz").alias("__t"))
    t = targets.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, target_cols)], F.col(f"`{start}`").cast("timestamp_ntz").alias("__start"), F.col(f"`{end}`").cast("timestamp_ntz").alias("__end"))
    out = None
    for present, fate in _masks(len(names), match):
        if fate == "pass":
            continue
        part = r.filter(_mask(names, present))
        if fate == "orphan":
            found = part.select(*keep, F.lit("missing").alias("kind"))
        else:
            on = [n for n, p in zip(names, present) if p]
            keyed = t.na.drop(subset=on)
            heavy = materialise(keyed.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select(*on))
            rest, light = part, keyed
            if busy := not heavy.isEmpty():
                rest, light = part.join(heavy, on, "left_anti"), keyed.join(heavy, on, "left_anti")
            # Of each key at most FEW records: one join answers all its references.
            spans = light.groupBy(*on).agg(F.min("__start").alias("__first"), F.collect_list(F.struct("__start", "__end")).alias("__spans"))
            live = F.exists("__spans", lambda s: (s["__start"] <= F.col("__t")) & (s["__end"].isNull() | (s["__end"] > F.col("__t"))))
            kind = F.when(F.col("__spans").isNull(), "missing").when(F.col("__first") <= F.col("__t"), "deleted").otherwise("late")
            found = rest.join(spans, on, "left").filter(~F.coalesce(live, F.lit(False))).select(*keep, kind.alias("kind"))
            if busy:
                state = _as_of(part.join(heavy, on, "left_semi"), keyed.join(heavy, on, "left_semi"), on).filter("not __live")
                found = found.unionByName(state.select(*keep, F.when(F.col("__known"), "deleted").otherwise("late").alias("kind")))
        out = found if out is None else out.unionByName(found)
    return out
