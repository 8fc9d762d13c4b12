"""Mixing sources to target weights by a low-discrepancy schedule.

Method: golden-ratio points (slot * phi mod 1) run through the cumulative target shares and give each slot of the mix a
source, so that every stretch of the mix has nearly the target shares. The slots of a source are ranked; rank r stands for
tokens [r * block, (r + 1) * block) of that source's documents, laid end to end and begun again after each pass, every
pass in another shuffled order. A document belongs to the block in which it starts. The size of the mix is the largest at which no source needs
more than its capped number of passes, so the shares are reached and the cap is never passed; a smaller size can be asked for.

Ranks and offsets are prefix sums in two levels (hash or slot ranges, then within a range), so a source with a third of all
rows is spread over all tasks.

Defined results: rows of null source or of a source without target stay out; documents without tokens take part with size 0
in every pass used. A target without any document, or with a null or non-positive share or cap, leaves nothing to mix
at its share: it is left out, the rest is rescaled and the report shows 0 for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialise

#: Fixed value: 2^32 divided by the golden ratio, odd, so that the points of 2^32 slots are all different.
GOLDEN = 2654435769
#: Rows that one range of the prefix sums holds on average; there are as many ranges as the rows need.
RANGE_ROWS = 50_000


@dataclass(frozen=True)
class Mix:
    rows: DataFrame  # slot, source, block, pass_no, doc_id, n_tokens
    report: DataFrame  # source, target_share, actual_share, tokens, documents, passes, most_repeats, max_repeats


def _prefix(df: DataFrame, group: list[str], range_col: str, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` by group in the order (range_col, order)."""
    sums = df.groupBy(*group, range_col).agg(F.sum(value).alias("__s"))
    ahead = W.partitionBy(*group).orderBy(range_col).rowsBetween(W.unboundedPreceding, -1)
    start = sums.select(*group, range_col, F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__base"))  # one row a range
    within = W.partitionBy(*group, range_col).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(start, [*group, range_col]).withColumn(name, F.col("__base") + F.col("__in")).drop("__in", "__base")


def mix(counts: DataFrame, targets: DataFrame, seed: int = 1, total_tokens: int | None = None, block_tokens: int | None = None) -> Mix:
    """``counts``: doc_id, source, n_tokens. ``targets``: source, target_share, max_repeats (a table of settings, one row a
    source). ``block_tokens``: size of a block; by default a 1/64 of the smallest source, 256 to 65,536."""
    spark = counts.sparkSession
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()  # settings: one row a source
    docs = materialise(counts.filter("source is not null and doc_id is not null").select(F.col("doc_id").alias("doc_id"), "source", F.col("n_tokens").cast("bigint").alias("n")))
    sized = [(r["source"], r["t"] or 0, r["k"]) for r in docs.groupBy("source").agg(F.sum("n").alias("t"), F.count("*").alias("k")).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()]  # one row a target
    have, rows_of = {s: t for s, t, _ in sized}, max((k for _, _, k in sized), default=0)
    use = sorted((r["source"], float(r["share"]), int(r["cap"])) for r in wanted if r["share"] and r["share"] > 0 and r["cap"] and r["cap"] > 0 and have.get(r["source"], 0) > 0)
    whole = sum(s for _, s, _ in use)
    size = min((have[s] * cap * whole / share for s, share, cap in use), default=0)
    if total_tokens is not None:
        size = min(size, total_tokens)
    block = block_tokens or max(256, min(65536, min((have[s] for s, _, _ in use), default=0) // 64))
    slots = int(size // block) if use else 0
    if not slots and use and size >= 1:
        slots, block = 1, max(1, int(size))
    if slots >= 1 << 32:
        raise ValueError("more than 2^32 slots: choose larger blocks")
    point = F.col("slot") * F.lit(GOLDEN) % F.lit(1 << 32) / F.lit(float(1 << 32))
    bounds, acc = [], 0.0
    for source, share, _ in use:
        acc += share / whole
        bounds.append((source, acc))
    pick = F.lit(bounds[-1][0]) if bounds else F.lit("")
    for source, upto in reversed(bounds[:-1]):
        pick = F.when(point < upto, F.lit(source)).otherwise(pick)
    schedule = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / RANGE_ROWS).alias("rng")).withColumn("source", pick)
    ranked = _prefix(schedule, ["source"], "rng", ["slot"], F.lit(1), "block")
    limits = spark.createDataFrame([(s, have[s], have[s] * c // block) for s, _, c in use], "source string, total bigint, blocks bigint")
    ranked = ranked.join(F.broadcast(limits), "source").filter(F.col("block") < F.greatest("blocks", F.lit(1)))
    ranked = ranked.select("slot", "source", "block", "total")
    # Offsets of the shuffled documents in their source's pass.
    # A document occurs once in each pass that the schedule uses; only blocks that it holds keep it.
    used = ranked.groupBy("source").agg(F.max("block").alias("b")).collect()  # one row a source
    limits = spark.createDataFrame([(r["source"], have[r["source"]], min(dict((s, c) for s, _, c in use)[r["source"]], int((r["b"] + 1) * block - 1) // have[r["source"]] + 1)) for r in used], "source string, total bigint, passes int")
    bits = max(0, (rows_of // RANGE_ROWS).bit_length())
    spread = docs.join(F.broadcast(limits), "source").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    spread = spread.withColumn("h", F.xxhash64(F.lit(seed), "pass_no", "source", "doc_id")).withColumn("rng", F.shiftright(F.col("h"), 64 - bits) if bits else F.lit(0))
    spread = _prefix(spread, ["source", "pass_no"], "rng", ["h", "doc_id"], F.col("n"), "off")
    spread = spread.withColumn("block", F.floor((F.col("pass_no") * F.col("total") + F.col("off")) / F.lit(block)))
    rows = ranked.drop("total").join(spread, ["source", "block"]).select("slot", "source", "block", "pass_no", "doc_id", F.col("n").alias("n_tokens"))
    by_doc = rows.groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max("pass_no").alias("p"))
    got = by_doc.groupBy("source").agg(F.sum("n").alias("tokens"), F.sum("k").alias("documents"), F.max("k").alias("most_repeats"), (F.max("p") + 1).alias("passes"))
    all_tokens = F.sum("tokens").over(W.partitionBy())  # one row a source
    asked = spark.createDataFrame([(r["source"], float(r["share"] or 0), int(r["cap"] or 0)) for r in wanted], "source string, target_share double, max_repeats int")
    report = asked.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_repeats", "passes"])
    report = report.withColumn("actual_share", F.coalesce(F.col("tokens") / F.when(all_tokens > 0, all_tokens), F.lit(0.0))).select("source", "target_share", "actual_share", "tokens", "documents", "passes", "most_repeats", "max_repeats")
    return Mix(rows, report)
