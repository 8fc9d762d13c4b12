"""Markers bound to components, their texts, and trees assembled from proposals and replayed from edition to edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, ids
from ..functions import vocabulary as V
from . import membership as M
from . import temporal as T


def bind_markers(markers: DataFrame, bindings: DataFrame, order: str) -> DataFrame:
    """Markers (work_id, level, key_path, others) with ``component`` and ``outcome``: the first binding by ``order`` of the same
    work (null equals null), level and path is 'bound', none is 'unknown' with a null component."""
    first = bindings.groupBy("work_id", "level", "key_path").agg(F.min_by("component", order).alias("component"))
    m, b = markers.alias("m"), first.alias("b")
    on = F.col("m.work_id").eqNullSafe(F.col("b.work_id")) & (F.col("m.level") == F.col("b.level")) & (F.col("m.key_path") == F.col("b.key_path"))
    return m.join(b, on, "left").select("m.*", "b.component", F.when(F.col("b.component").isNull(), "unknown").otherwise("bound").alias("outcome"))


def text_log(bound: DataFrame, body: str, title: str, day: Column, bodies: bool = True) -> DataFrame:
    """(component, text, day) of bound markers: the tidy body or, where it is blank, the tidy title; without ``bodies`` the title
    as it stands. Markers without either give nothing."""
    head = F.coalesce(F.trim(title), F.lit(""))
    text = F.when(F.coalesce(F.trim(body), F.lit("")) != "", F.trim(body)).otherwise(head) if bodies else F.col(title)
    rows = bound.filter("outcome = 'bound'").select("component", text.alias("text"), day.alias("day"))
    return rows.filter(F.trim("text") != "")


def commit(admitted: DataFrame, day: int) -> DataFrame:
    """Admitted edges (child, parent, outcome) as attach events of a membership log."""
    return admitted.filter("outcome = 'admitted'").select(F.lit("attach").alias("kind"), "parent", "child", F.lit(day).alias("day"))


def assemble(admitted: DataFrame, day: int) -> DataFrame:
    """(node, parent, root, depth, path) of the tree that the admitted edges make at a day."""
    return T.tree(T.membership(commit(admitted, day), day))


def assembly_report(tree_rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(nodes, roots, missing, phantom, drift) of a tree against the expected ids (node)."""
    counted = tree_rows.agg(F.count("*").alias("nodes"), F.count_if(F.col("depth") == 0).alias("roots"))
    return counted.join(M.drift(expected, tree_rows, "node").select("missing", "phantom", "drift"), F.lit(True))


def edition_tree(log: DataFrame, presence_log: DataFrame, expression: str, at) -> DataFrame:
    """The membership tree at a day, pruned to the components that an expression includes."""
    present = T.presence(presence_log, at).filter((F.col("expression") == expression) & (F.col("outcome") == "included"))
    return T.prune(T.tree(T.membership(log, at)), present.select(F.col("component").alias("node")))


def edition_replay(before: DataFrame, after: DataFrame, pair: str) -> DataFrame:
    """(pair, added, removed, drift): edges (pair, child, parent) of a seed and a target. The seed is committed, the difference
    becomes attach and detach events of a later day, and the fold of both must give the target: drift counts the edges
    that differ. A child has one parent on each side."""
    key = [pair, "child", "parent"]
    old, new = before.select(*key).distinct(), after.select(*key).distinct()
    diff = M.marker_diff(old, new, key)
    # Pairs are folded side by side: a child's name carries its pair.
    named = F.to_json(F.struct(pair, "child"))
    seed = old.select(F.lit("attach").alias("kind"), "parent", named.alias("child"), F.lit(1).alias("day"))
    drafts = diff.select(F.when(F.col("change") == "added", "attach").otherwise("detach").alias("kind"), "parent", named.alias("child"), F.lit(2).alias("day"))
    fold = T.membership(seed.unionByName(drafts), 2).withColumn("f", F.lit(1))
    target = new.select(pair, named.alias("child"), "parent").withColumn("t", F.lit(1))
    j = fold.join(target.drop(pair), ["child", "parent"], "full").filter("f is null or t is null").select(F.get_json_object("child", f"$.{pair}").alias("p"))
    counts = diff.groupBy(pair).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    every = old.select(pair).union(new.select(pair)).distinct()
    drifts = j.groupBy(F.col("p").cast(old.schema[pair].dataType).alias(pair)).agg(F.count("*").alias("drift"))
    return every.join(counts, pair, "left").join(drifts, pair, "left").fillna(0, ["added", "removed", "drift"])


def complete(required: DataFrame, edges: DataFrame, act: str) -> DataFrame:
    """(act, missing, outcome): 'complete' if each required component (act, node) is an end of an edge (act, child, parent)."""
    ends = edges.select(act, F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("__in", F.lit(1))
    g = required.select(act, "node").distinct().join(ends, [act, "node"], "left").groupBy(act).agg(F.count_if(F.col("__in").isNull()).alias("missing"))
    return g.withColumn("outcome", F.when(F.col("missing") == 0, "complete").otherwise("incomplete"))


def visibility(members: DataFrame, presence_rows: DataFrame, expression: str) -> DataFrame:
    """(visible, hidden): components (node) of a fold that an expression includes, and those that it doesn't."""
    seen = presence_rows.filter((F.col("expression") == expression) & (F.col("outcome") == "included")).select(F.col("component").alias("node")).distinct().withColumn("__v", F.lit(1))
    return members.select("node").distinct().join(seen, "node", "left").agg(F.count("__v").alias("visible"), F.count_if(F.col("__v").isNull()).alias("hidden"))


def merge_gaps(known: Column, residual: Column, hides: Column) -> Column:
    """Known gaps in order, then residual ones that are new; those of an executor that hides gaps aren't trusted."""
    none = F.array().cast("array<string>")
    old = F.coalesce(known, none)
    return F.when(F.coalesce(hides, F.lit(False)), old).otherwise(F.concat(old, F.array_except(F.coalesce(residual, none), old)))


def node_kind_error(kind: Column) -> Column:
    """'forbidden kind' before 'unknown kind'; '' for a kind of the catalog."""
    return F.when(kind.isin(V.FORBIDDEN_KINDS), "forbidden kind").when(~F.coalesce(kind.isin(V.NODE_KINDS + V.EDGE_KINDS), F.lit(False)), "unknown kind").otherwise("")


def path_bindings(path: Column, bindings: list[dict[str, str]]) -> Column:
    """Array of the bindings whose ``path_needle`` occurs in a path, in any case and in their order. The list is configuration;
    a binding without one of its fields is an error."""
    names = list(bindings[0]) if bindings else []
    if any(not row.get(n) for row in bindings for n in names):
        raise ValueError("a binding has an empty field")
    low = F.lower(F.coalesce(path, F.lit("")))
    hits = [F.when(F.contains(low, F.lit(row["path_needle"].lower())), F.struct(*[F.lit(row[n]).alias(n) for n in names])) for row in bindings]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def path_expression(path: Column, works: list[dict[str, str]]) -> Column:
    """Expression id of an edition's path, null if nothing grounds it: the first work (path_needle, authority, act_number,
    enactment_date, edition_date) whose needle occurs; else law_DATE_N-fz with a known number of that very date, at the
    day of its rev-DATE or, without one, of the enactment."""
    found = F.get(path_bindings(path, works), F.lit(0))

    def minted(authority: Column, enacted: Column, number: Column, edition: Column) -> Column:
        return ids.expression_id(ids.work_id(authority, enacted, number)[0], dates.day_ordinal(edition))

    law = dates.law_path(path)
    grounded = F.lit(None).cast("string")
    for w in reversed(works):
        same = (law["number"] == w["act_number"]) & (law["date"] == w["enactment_date"])
        grounded = F.when(same, minted(F.lit(w["authority"]), law["date"], law["number"], F.coalesce(dates.revision_path(path), law["date"]))).otherwise(grounded)
    return F.when(found.isNotNull(), minted(found["authority"], found["enactment_date"], found["act_number"], found["edition_date"])).otherwise(grounded)


def path_edition_day(path: Column, editions: list[dict[str, str]]) -> Column:
    """Ordinal of the edition day of the first edition (path_needle, edition_date) whose needle occurs."""
    return dates.day_ordinal(F.get(path_bindings(path, editions), F.lit(0))["edition_date"])
