"""Proposed membership from document order, admission, closure, edition diff and replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialise, ship


def propose(markers: DataFrame, doc: list[str], order: str, node: str, rank: Column, ranks: int) -> DataFrame:
    """(doc, order, node, parent): the nearest earlier bound marker with a strictly smaller rank (0 .. ranks - 1); none is a
    root. Markers with a null node or rank are unbound and left out. One running value for each rank replaces the stack."""
    before = W.partitionBy(*doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    bound = markers.withColumn("__r", rank).filter(F.col("__r").isNotNull() & F.col(node).isNotNull())
    lasts = {f"__l{r}": F.last(F.when(F.col("__r") == r, F.struct(F.col(order).alias("o"), F.col(node).alias("n"))), True).over(before) for r in range(ranks)}
    cols = bound.withColumns(lasts)
    smaller = F.filter(F.array(*[F.when(F.col("__r") > r, F.col(f"__l{r}")) for r in range(ranks)]), lambda x: x.isNotNull())
    return cols.select(*doc, order, node, F.array_max(smaller)["n"].alias("parent"))


def admit(proposals: DataFrame, doc: str, order: str = "ord") -> DataFrame:
    """(doc, ord, child, parent, outcome): proposals in order; 'self_parent', 'duplicate' (dropped), 'second_parent' and
    'cycle' are set aside, the first parent that closes no cycle wins ('admitted'). A child has a parent only from its
    admission on: until then each of its proposals is checked for a cycle, repeats of a rejected pair too. A rejected pair
    stays a cycle, as admitted edges never leave, so every distinct pair at its first place meets the ordered check of its
    document; all other outcomes follow from the place of the child's admission."""
    ship(proposals.sparkSession)
    p = proposals.withColumn("__self", F.col("child") == F.col("parent"))
    real = p.filter("not __self").select(doc, order, "child", "parent")
    selfs = p.filter("__self").select(doc, order, "child", "parent", F.lit("self_parent").alias("outcome"))
    kind = {c: proposals.schema[c].dataType.simpleString() for c in (doc, order)}

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "child", "parent"], kind="stable")
        up: dict[str, str] = {}
        places = []
        short: dict[str, str] = {}  # towards the root of each tree; a child without parent is the root of its own
        for o, c, q in zip(pdf[order], pdf["child"], pdf["parent"]):
            if c in up:
                continue
            top, way = q, []
            while top in short:
                way.append(top)
                top = short[top]
            for x in way:
                short[x] = top
            if top != c:
                up[c] = short[c] = q
                places.append(o)
        return pd.DataFrame({"__d": [pdf[doc].iloc[0]] * len(up), "__c": list(up), "__o": places, "__q": list(up.values())})

    pairs = real.groupBy(doc, "child", "parent").agg(F.min(order).alias(order))
    taken = pairs.groupBy(doc).applyInPandas(ordered, f"__d {kind[doc]}, __c string, __o {kind[order]}, __q string")
    nth = F.row_number().over(W.partitionBy(doc, "child", "parent").orderBy(order))
    met = real.withColumn("__n", nth).join(taken, F.col(doc).eqNullSafe(F.col("__d")) & (F.col("child") == F.col("__c")), "left")
    later = F.struct(F.col(order), F.col("parent")) > F.struct(F.col("__o"), F.col("__q"))
    outcome = F.when(F.col("parent") == F.col("__q"), F.when(F.col("__n") == 1, "admitted").otherwise("duplicate")).when(F.col("__q").isNotNull() & later, "second_parent").otherwise("cycle")
    return met.select(doc, order, "child", "parent", outcome.alias("outcome")).unionByName(selfs)


def bounded_closure(edges: DataFrame, seeds: DataFrame, bound: int = 8, version: str | None = None) -> DataFrame:
    """(seed, outcome, n_affected): what depends on a seed, at most ``bound`` nodes. edges: node, dep (node depends on dep; a
    registered node without dependencies has a null dep). 'unknown' for an unregistered seed, 'unbounded' beyond the bound,
    'incomplete' if a dependency met is not registered, else 'complete'. Before all of these, a seed whose ``claim`` is true
    (a forbidden claim of completeness) is 'incomplete', and one whose ``rule_version`` is another than ``version`` is
    'incompatible', where the columns exist and a version is given. At most bound + 1 rounds; a node keeps bound + 1 of its
    dependencies, which are enough to pass the bound, and a seed that has passed it is expanded no further, so a hub costs
    no more than its bound."""
    known = edges.select(F.col("node").alias("n")).distinct()
    place = F.row_number().over(W.partitionBy("node").orderBy("dep"))
    dep = materialise(edges.filter("dep is not null and dep <> node").select("node", "dep").distinct().withColumn("k", place).filter(F.col("k") <= bound + 1).select("node", "dep"))
    reached = materialise(seeds.select("seed", F.col("seed").alias("n")).distinct().join(known, "n", "left_semi").select("seed", "n"))
    for _ in range(bound):
        few = reached.groupBy("seed").agg(F.count("*").alias("k")).filter(F.col("k") <= bound).select("seed")
        more = reached.join(few, "seed", "left_semi").join(dep, F.col("n") == F.col("node")).select("seed", F.col("dep").alias("n"))
        reached = materialise(reached.union(more).distinct())  # the plan of a round holds the one before it twice
    state = reached.join(known.withColumn("ok", F.lit(True)), "n", "left").groupBy("seed").agg(F.count("*").alias("k"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_known"))
    claimed = F.max("claim") if "claim" in seeds.columns else F.lit(False)
    stale = F.max(~F.col("rule_version").eqNullSafe(F.lit(version))) if version is not None and "rule_version" in seeds.columns else F.lit(False)
    j = seeds.groupBy("seed").agg(claimed.alias("c"), stale.alias("v")).join(state, "seed", "left")
    outcome = F.when(F.coalesce("c", F.lit(False)), "incomplete").when(F.col("v"), "incompatible").when(F.col("k").isNull(), "unknown").when(F.col("k") > bound, "unbounded").when(~F.col("all_known"), "incomplete").otherwise("complete")
    return j.select("seed", outcome.alias("outcome"), F.when(outcome == "complete", F.col("k")).alias("n_affected"))


def edition_pairs(rows: DataFrame, edition: str, counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(before, after): ``counted`` rows of each edition's next lower one, under the higher edition's number, and of each
    edition but the lowest. The editions are those in which ``rows`` has any row; rows of null edition don't count."""
    has = rows.select(F.col(edition).alias("__e")).na.drop().distinct()
    pairs = F.broadcast(has.withColumn("__b", F.lag("__e").over(W.orderBy("__e"))).filter("__b is not null"))  # one row an edition
    old = counted.join(pairs, F.col(edition) == F.col("__b")).withColumn(edition, F.col("__e")).drop("__e", "__b")
    new = counted.join(pairs, F.col(edition) == F.col("__e")).drop("__e", "__b")
    return old, new


def marker_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows (duplicates kept) of either side whose key the other lacks, with ``change`` removed or added."""
    gone = before.join(after.select(*key).distinct(), key, "left_anti").withColumn("change", F.lit("removed"))
    return gone.unionByName(after.join(before.select(*key).distinct(), key, "left_anti").withColumn("change", F.lit("added")))


def first_of_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key, by aggregation."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*key, "__r.*")


def text_drafts(before: DataFrame, after: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, kind): attach where the text is new or changed, detach where the key is gone. Both sides have one row a key."""
    b = before.select(*key, F.col(text).alias("__b"), F.lit(1).alias("__hb"))
    a = after.select(*key, F.col(text).alias("__a"), F.lit(1).alias("__ha"))
    j = a.join(b, key, "full")
    kind = F.when(F.col("__ha").isNull(), "detach").when(F.col("__hb").isNull() | ~F.col("__a").eqNullSafe(F.col("__b")), "attach")
    return j.select(*key, kind.alias("kind")).filter("kind is not null")


def drift(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(missing, phantom, drift, expected): distinct ids on one side only; ``expected`` counts rows, repeated ones too."""
    e = expected.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("e"))
    a = actual.filter(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().withColumn("a", F.lit(1))
    sums = e.join(a, "k", "full").agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("phantom"), F.coalesce(F.sum("e"), F.lit(0)).alias("expected"))
    return sums.select("missing", "phantom", (F.col("missing") + F.col("phantom")).alias("drift"), "expected")


def heal(log: DataFrame, expected: DataFrame, present: DataFrame, day: int) -> DataFrame:
    """The log with an attach for each expected edge (child, parent) whose child is absent from ``present`` (child)."""
    add = expected.join(present.select("child").distinct(), "child", "left_anti").select(F.lit("attach").alias("kind"), "parent", "child", F.lit(day).cast(log.schema["day"].dataType).alias("day"))
    return log.select("kind", "parent", "child", "day").unionByName(add)


def forest_roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def insert_guards(edges: DataFrame, order: str) -> DataFrame:
    """Edges (child, parent) with ``guard``: duplicate, reverse or multiple_parents against earlier rows, else ''."""
    pair = F.least("child", "parent"), F.greatest("child", "parent")
    same = W.partitionBy("child", "parent").orderBy(order)
    both = W.partitionBy(*pair).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    mine = W.partitionBy("child").orderBy(order)
    turned = F.max(F.col("child") == F.greatest("child", "parent")).over(both) != F.min(F.col("child") == F.greatest("child", "parent")).over(both)
    first_way = F.first(F.col("child")).over(W.partitionBy(*pair).orderBy(order))
    guard = F.when(F.row_number().over(same) > 1, "duplicate").when((first_way != F.col("child")) & F.coalesce(~turned, F.lit(True)), "reverse").when(F.row_number().over(mine) > 1, "multiple_parents").otherwise("")
    return edges.withColumn("guard", guard)


def industrial_op_error(kind: Column, subjects: Column, targets: Column) -> Column:
    """Arity and collisions: renumber and move take one subject and one target, split one and two or more, merge two or more
    and one; no id may be on both sides or twice on one."""
    s, t = F.size(subjects), F.size(targets)
    arity = F.when(kind.isin("renumber", "move"), (s == 1) & (t == 1)).when(kind == "split", (s == 1) & (t >= 2)).when(kind == "merge", (s >= 2) & (t == 1))
    clash = F.arrays_overlap(subjects, targets) | (F.size(F.array_distinct(subjects)) < s) | (F.size(F.array_distinct(targets)) < t)
    return F.when(arity.isNull(), "unknown kind").when(~arity, "arity").when(clash, "collision").otherwise("")


def apply_ops(edges: DataFrame, ops: DataFrame, scope: str) -> DataFrame:
    """(scope, child, parent): edges after the operations of each scope in order. ops: scope, ord, op_id, kind, subjects,
    targets. A repeated op_id or an invalid operation is skipped. renumber and move give the subject's place to the target; split and
    merge drop all edges of the subjects and hang the targets under the parent of the first subject that has one. Order
    decides, so a scope (one act) is one group."""
    ship(edges.sparkSession)
    schema = f"{scope} {edges.schema[scope].dataType.simpleString()}, child string, parent string"

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        up = {c: p for c, p in zip(left["child"], left["parent"])} if len(left) else {}
        seen = set()
        for _, op in (right.sort_values("ord").iterrows() if len(right) else ()):
            subjects, targets = list(op["subjects"]), list(op["targets"])
            if op["op_id"] in seen or set(subjects) & set(targets):
                continue
            seen.add(op["op_id"])
            parent = next((up[s] for s in subjects if s in up), None)
            if op["kind"] in ("renumber", "move"):
                old, new = subjects[0], targets[0]
                if op["kind"] == "renumber":
                    up = {new if c == old else c: new if p == old else p for c, p in up.items()}
                else:
                    up[old] = new
            else:
                up = {c: p for c, p in up.items() if c not in subjects and p not in subjects}
                for t in targets:
                    if parent is not None:
                        up[t] = parent
        return pd.DataFrame({scope: [key[0]] * len(up), "child": list(up), "parent": list(up.values())})

    return edges.groupBy(scope).cogroup(ops.groupBy(scope)).applyInPandas(run, schema)


def write_set(nodes: list[tuple[DataFrame, str, str]], edges: list[tuple[DataFrame, str, str, str]], node_kinds: list[str], edge_kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Projection into typed nodes (kind, id) without repeats and edges (kind, from_id, to_id) with them. Each source comes as
    (rows, kind, id column) or (rows, kind, from column, to column); a kind outside the catalog is an error."""
    for _, kind, *_ in nodes:
        if kind not in node_kinds:
            raise ValueError(f"forbidden node kind {kind}")
    for _, kind, *_ in edges:
        if kind not in edge_kinds:
            raise ValueError(f"unknown edge kind {kind}")
    n = [df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id")) for df, kind, c in nodes]
    e = [df.select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("from_id"), F.col(b).cast("string").alias("to_id")) for df, kind, a, b in edges]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return union(n).na.drop().distinct(), union(e).na.drop()


def registry(bindings: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, outcome): one value for a key is bound (repeats are idempotent), several are a conflict."""
    g = bindings.groupBy(*key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    same = F.col("lo") == F.col("hi")
    return g.select(*key, F.when(same, F.col("lo")).alias(value), F.when(same, "bound").otherwise("conflict").alias("outcome"))
