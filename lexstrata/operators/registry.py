"""Checks and roll-ups over a registry of items and edges, evaluation of extractors, hash chains and idempotent replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OPEN_CONTRADICTION = ("active", "hypothesis", "bounded-evidence")


def missing_endpoints(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(edge_id, side, ref): ends of edges (edge_id, from_id, to_id) that are no item (item_id)."""
    ends = edges.select("edge_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("ref")) for s in ("from", "to")])).alias("e")).select("edge_id", "e.*")
    return ends.filter("ref is not null").join(items.select(F.col("item_id").alias("ref")).distinct(), "ref", "left_anti").select("edge_id", "side", "ref")


def untraced(items: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Items of critical types that no edge touches."""
    touched = edges.select(F.explode(F.array("from_id", "to_id")).alias("item_id")).na.drop().distinct()
    return items.filter(F.col("item_type").isin(types)).join(touched, "item_id", "left_anti").select("item_id", "item_type")


def contradictions(edges: DataFrame, statuses: tuple[str, ...] = OPEN_CONTRADICTION) -> DataFrame:
    return edges.filter((F.col("edge_type") == "contradicts") & F.col("status").isin(*statuses)).select("edge_id", "from_id", "to_id", "status")


def unchecked(items: DataFrame, edges: DataFrame, risks: list[str], edge_types: list[str], target_types: list[str]) -> DataFrame:
    """Active items of high risk without an active checking edge to an item of a checking type."""
    targets = items.filter(F.col("item_type").isin(target_types)).select(F.col("item_id").alias("to_id")).distinct()
    covered = edges.filter(F.col("edge_type").isin(edge_types) & (F.col("status") == "active")).join(targets, "to_id", "left_semi").select(F.col("from_id").alias("item_id")).distinct()
    return items.filter(F.col("risk_level").isin(risks) & (F.col("status") == "active")).join(covered, "item_id", "left_anti").select("item_id", "risk_level")


def superseded_without_edge(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Superseded items that no active edge names as replaced, in either direction."""
    live = edges.filter("status = 'active'")
    replaced = live.filter("edge_type = 'supersedes'").select(F.col("to_id").alias("item_id")).union(live.filter("edge_type = 'superseded_by'").select("from_id")).distinct()
    return items.filter("status = 'superseded'").join(replaced, "item_id", "left_anti").select("item_id")


def evidence_boundary(items: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """Validated items none of whose anchors (array of struct with ``kind``) is of a class their proof level requires."""
    need = F.try_element_at(F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("proof_level"))
    kinds = F.coalesce(F.transform("source_anchors", lambda a: a["kind"]), F.array().cast("array<string>"))
    overlap = F.coalesce(F.arrays_overlap(F.filter(kinds, lambda x: x.isNotNull()), need), F.lit(False))
    return items.filter(F.col("status") == "validated").filter(need.isNotNull() & ~overlap).select("item_id", "proof_level")


def claim_lifecycle(items: DataFrame, edges: DataFrame, proven: list[str], proof_edges: list[str], backlog: list[str]) -> DataFrame:
    """(record_id, field, failure): validated items without a sufficient proof level, and ends of live proof edges whose item's
    status forbids its use as proof."""
    unsafe = items.filter((F.col("status") == "validated") & ~F.coalesce(F.col("proof_level").isin(proven), F.lit(False)))
    found = unsafe.select(F.col("item_id").alias("record_id"), F.lit("status").alias("field"), F.lit("unsafe-promotion").alias("failure"))
    live = edges.filter(F.col("edge_type").isin(proof_edges) & F.col("status").isin("active", "bounded-evidence", "validated"))
    ends = live.select("edge_id", F.explode(F.array(*[F.struct(F.lit(s).alias("field"), F.col(f"{s}_id").alias("item_id")) for s in ("from", "to")])).alias("e")).select("edge_id", "e.*")
    bad = ends.join(items.filter(F.col("status").isin(backlog)).select("item_id").distinct(), "item_id", "left_semi")
    return found.unionByName(bad.select(F.col("edge_id").alias("record_id"), "field", F.lit("proof-from-backlog").alias("failure")))


def gate_metadata(items: DataFrame, gate_type: str = "proof_gate") -> DataFrame:
    """(item_id, field): what active gates without proof lack of owner, verification (text) and source anchors (list)."""
    gates = items.filter((F.col("item_type") == gate_type) & (F.col("status") == "active") & (F.col("proof_level") == "none"))
    lack = {f: F.coalesce(F.trim(f), F.lit("")) == "" for f in ("owner", "verification")} | {"source_anchors": F.coalesce(F.size("source_anchors"), F.lit(0)) <= 0}
    return gates.select("item_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in lack.items()]), lambda x: x.isNotNull())).alias("field"))


def track_split(rows: DataFrame, tracks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(track, n, one sorted set a field): tracks (track, key) with the distinct values, of closed domains, of their rows."""
    return tracks.join(rows, key).groupBy("track").agg(F.count("*").alias("n"), *[F.array_sort(F.collect_set(f)).alias(f"{f}s") for f in fields])


def final_buckets(rows: DataFrame, status: str, names: dict[str, str]) -> DataFrame:
    """(status, bucket, n): counts by status and the bucket that it ends in, '' for a status without one."""
    return rows.groupBy(F.coalesce(status, F.lit("")).alias("status")).agg(F.count("*").alias("n")).select("status", bucket_of(F.col("status"), names, "").alias("bucket"), "n")


def accepted_facts(asked: DataFrame, proposals: DataFrame, key: list[str]) -> DataFrame:
    """Asked facts with ``is_fact``: whether a proposal of that key was accepted."""
    known = proposals.filter("outcome = 'accepted'").select(*key).distinct().withColumn("__f", F.lit(True))
    return asked.join(known, key, "left").withColumn("is_fact", F.coalesce("__f", F.lit(False))).drop("__f")


def retryable(outcome: Column) -> Column:
    return F.coalesce(outcome.isin("unavailable", "timeout", "transport_or_tls_failure"), F.lit(False))


def anchor_errors(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(item_id, pos, error) in order: path not local, file unknown, one line bound only or out of range. files: path, n_lines."""
    j = anchors.join(files, "path", "left")
    local = F.col("path").isNotNull() & ~F.col("path").rlike(r"^(/|[A-Za-z]+:)|(^|/)\.\.(/|$)")
    one = F.col("line_start").isNull() != F.col("line_end").isNull()
    bad = F.col("line_start").isNotNull() & ((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")) | (F.col("line_end") > F.col("n_lines")))
    return j.select("item_id", "pos", F.when(~local, "path").when(F.col("n_lines").isNull(), "no file").when(one, "one bound").when(bad, "line range").otherwise("").alias("error"))


def overclaims(text: Column, pattern: str, negation: str = r"(?i)\b(not|no|never|without|нет|не)\b") -> Column:
    """Sentences that match ``pattern`` and hold no negation."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(parts, lambda s: s.rlike(pattern) & ~s.rlike(negation))


def record_errors(required: list[str], enums: dict[str, list[str]], patterns: dict[str, str], types_of: dict[str, str] | None = None) -> Column:
    """Array of the violations of a record: required and not blank, closed enums, patterns found anywhere."""
    checks = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"required:{c}")) for c in required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.lit(f"enum:{c}")) for c, v in enums.items()]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).rlike(p), F.lit(f"pattern:{c}")) for c, p in patterns.items()]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def redact_block(text: Column, forbidden: list[str], flagged: Column, sink: Column, sinks: list[str]) -> Column:
    """'blocked' for a forbidden marker in any case, a flag or a sink that is not allowed; else 'allowed'."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m.lower())) for m in forbidden], F.lit(False))
    return F.when(hit | F.coalesce(flagged, F.lit(False)) | ~F.coalesce(sink.isin(sinks), F.lit(False)), "blocked").otherwise("allowed")


def buckets(items: DataFrame, level: str, names: dict[str, str], default: str, item_id: str) -> DataFrame:
    """(bucket, n): items by priority bucket; lists of ids stay rows, see ``bucket_of``."""
    return items.withColumn("bucket", bucket_of(F.col(level), names, default)).groupBy("bucket").agg(F.count(item_id).alias("n"))


def bucket_of(level: Column, names: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), level), F.lit(default))


def allow_list_diff(actual: DataFrame, allowed: DataFrame, key: list[str]) -> DataFrame:
    """(key, verdict): extra or missing, and forbidden_direction for an extra edge whose reverse is allowed."""
    a, b = actual.select(*key).distinct(), allowed.select(*key).distinct()
    extra = a.join(b, key, "left_anti")
    turned = b.select(F.col(key[1]).alias(key[0]), F.col(key[0]).alias(key[1]), F.lit(True).alias("__t"))
    out = extra.join(turned, key, "left").select(*key, F.when(F.col("__t"), "forbidden_direction").otherwise("extra").alias("verdict"))
    return out.unionByName(b.join(a, key, "left_anti").withColumn("verdict", F.lit("missing")))


def coverage(declared: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, state): covered, uncovered (declared, not seen) or undeclared."""
    d = declared.select(key).distinct().withColumn("__d", F.lit(True))
    s = seen.select(key).distinct().withColumn("__s", F.lit(True))
    return d.join(s, key, "full").select(key, F.when(F.col("__d") & F.col("__s"), "covered").when(F.col("__d"), "uncovered").otherwise("undeclared").alias("state"))


def filled_counts(rows: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts by group and kind with zeros for kinds that don't occur."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def surfaces(records: DataFrame, record_id: str, text: str, terms: dict[str, str]) -> DataFrame:
    """Presence flag of each surface's term in each record."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return records.select(record_id, *[F.contains(low, F.lit(t.lower())).alias(f"in_{n}") for n, t in terms.items()])


def run_outcome(log: Column, terms: list[str], most: int = 5) -> Column:
    """Struct (outcome, signals): failure with up to five signal terms found, else success."""
    low = F.lower(F.coalesce(log, F.lit("")))
    found = F.slice(F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]), lambda x: x.isNotNull()), 1, most)
    return F.struct(F.when(F.size(found) > 0, "failure").otherwise("success").alias("outcome"), found.alias("signals"))


def stale_companions(changed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(trigger, companion): rules (patterns of paths) whose trigger changed while no companion did."""
    flags = changed.agg(*[F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False)).alias(f"f{i}_{k}") for i, r in enumerate(rules) for k, p in enumerate(r)])
    rows = F.array(*[F.struct(F.lit(t).alias("trigger"), F.lit(c).alias("companion"), F.col(f"f{i}_0").alias("a"), F.col(f"f{i}_1").alias("b")) for i, (t, c) in enumerate(rules)])
    return flags.select(F.explode(rows).alias("r")).filter("r.a and not r.b").select("r.trigger", "r.companion")


def evaluation(gold: DataFrame, found: DataFrame, layer: str, key: list[str]) -> DataFrame:
    """(layer, tp, fp, fn, precision, recall, f1) over distinct keys, for layers of the gold set only."""
    g = gold.select(layer, *key).distinct().withColumn("__g", F.lit(1))
    f = found.select(layer, *key).distinct().withColumn("__f", F.lit(1))
    both = F.col("__g").isNotNull() & F.col("__f").isNotNull()
    sums = g.join(f, [layer, *key], "full").groupBy(layer).agg(F.count_if(both).alias("tp"), F.count_if(F.col("__g").isNull()).alias("fp"), F.count_if(F.col("__f").isNull()).alias("fn")).filter("tp + fn > 0")
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def conformance(rows: DataFrame, by: list[str], result: str) -> DataFrame:
    """Any fail is fail, else any unsupported is unsupported, else pass."""
    g = rows.groupBy(*by).agg(F.bool_or(F.col(result) == "fail").alias("f"), F.bool_or(F.col(result) == "unsupported").alias("u"))
    return g.select(*by, F.when(F.col("f"), "fail").when(F.col("u"), "unsupported").otherwise("pass").alias("outcome"))


def chain_violations(envelopes: DataFrame, packet: str, sequence: str, own: str, previous: str) -> DataFrame:
    """(packet, sequence, violation) of hash chains: numbers contiguous from 1, each naming the hash before it."""
    order = W.partitionBy(packet).orderBy(sequence, own)
    e = envelopes.withColumns({"__n": F.row_number().over(order), "__h": F.lag(own).over(order)})
    gap = F.when(F.col(sequence) != F.col("__n"), "sequence")
    link = F.when(~F.col(previous).eqNullSafe(F.col("__h")), "previous")
    return e.select(packet, sequence, F.explode(F.filter(F.array(gap, link), lambda x: x.isNotNull())).alias("violation"))


def replay(requests: DataFrame, op: str, effect: str, order: str, checks: list[tuple[Column, str]]) -> DataFrame:
    """Requests with ``outcome``: the first failing check by name, 'suppressed' for a valid repeat of (op, effect), else
    'applied': the first valid one by order. Replaying a log twice changes nothing."""
    failed = F.lit("")
    for bad, name in reversed(checks):
        failed = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(failed)
    r = requests.withColumn("__e", failed)
    first = r.filter("__e = ''").groupBy(op, effect).agg(F.min(order).alias("__first"))
    j = r.join(first, [op, effect], "left")
    return j.withColumn("outcome", F.when(F.col("__e") != "", F.col("__e")).when(F.col(order) == F.col("__first"), "applied").otherwise("suppressed")).drop("__e", "__first")


def attempts(rows: DataFrame, item: str, order: str) -> DataFrame:
    """Attempt number of each arrival of an item."""
    return rows.withColumn("attempt", F.row_number().over(W.partitionBy(item).orderBy(order)))
