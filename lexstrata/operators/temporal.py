"""As-of folds over append-only event logs: status, text, membership, presence.

A fold never guesses: no event is 'unknown', contradictory events of the same day are 'conflict'. Future events are
invisible at a day. Where the data model lets one conflict fail a whole call, these operators name the keys concerned
instead. All of them aggregate by key before anything is joined; only rows of a key's last day are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .hierarchy import LOCAL_EDGES, hierarchy

def status_as_of(events: DataFrame, key: str, day: str, status: str, at, requested: DataFrame | None = None) -> DataFrame:
    """(key, status, outcome) at a day. Two aggregations with map-side combination: by key and day, then by key, so a hot
    key never fills one task. With ``requested`` each of its keys gets a row."""
    seen = events.filter(F.col(key).isNotNull() & (F.col(day) <= at))
    daily = seen.groupBy(key, day).agg(F.min(status).alias("lo"), F.max(status).alias("hi"))
    last = daily.groupBy(key).agg(F.max_by(F.struct("lo", "hi"), day).alias("s"))
    out = last.select(key, F.when(F.col("s.lo") == F.col("s.hi"), F.col("s.lo")).otherwise("unknown").alias("status"), F.when(F.col("s.lo") == F.col("s.hi"), "resolved").otherwise("conflict").alias("outcome"))
    if requested is not None:
        out = requested.select(key).distinct().join(out, key, "left").select(key, F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("outcome", F.lit("unknown")).alias("outcome"))
    return out


def as_of_join(requests: DataFrame, events: DataFrame, key: str, at: str, day: str, value: str) -> DataFrame:
    """(requests' columns, value): the latest value with day <= at for each request, by a union and a running last value
    instead of a join on inequality. Only the days of a key are swept, asked for and of events alike, however many
    requests and events a day has; then each request takes its day's answer. Requests of null key or day have a null value."""
    asked = requests.select(key, F.col(at).alias("__d"), F.lit(1).alias("__q"), F.lit(None).cast(events.schema[value].dataType).alias("__v")).distinct()
    right = events.filter(F.col(value).isNotNull()).groupBy(key, F.col(day).alias("__d")).agg(F.max(value).alias("__v")).select(key, "__d", F.lit(0).alias("__q"), "__v")
    run = W.partitionBy(key).orderBy("__d", "__q").rowsBetween(W.unboundedPreceding, 0)
    answers = asked.unionByName(right).withColumn("__a", F.last("__v", True).over(run)).filter("__q = 1").select(F.col(key).alias("__k"), "__d", "__a")
    return requests.join(answers, (F.col(key) == F.col("__k")) & (F.col(at) == F.col("__d")), "left").select(*requests.columns, F.col("__a").alias(value))


def text_as_of(log: DataFrame, key: list[str], day: str, text: str, order: str, at) -> DataFrame:
    """(key, outcome, text, texts): the text of the last day; several events of that day are a conflict that keeps every
    text, copies too, in log order."""
    seen = log.filter(F.col(day) <= at)
    # The last day by aggregation, then only its rows: a hot key is never sorted as a whole. Null keys have no answer.
    tied = seen.join(seen.groupBy(*key).agg(F.max(day).alias(day)), [*key, day])
    g = tied.groupBy(*key).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]).alias("texts"))
    one = F.col("n") == 1
    return g.select(*key, F.when(one, "resolved").otherwise("conflict").alias("outcome"), F.when(one, F.get("texts", F.lit(0))).alias("text"), F.when(~one, F.col("texts")).otherwise(F.array().cast("array<string>")).alias("texts"))


def membership_conflicts(log: DataFrame, at) -> DataFrame:
    """(day, child, n_parents): attached on one day under more than one parent. Log: kind, parent, child, day."""
    seen = log.filter((F.col("kind") == "attach") & (F.col("day") <= at))
    return seen.groupBy("day", "child").agg(F.count_distinct("parent").alias("n_parents")).filter("n_parents > 1")


def membership(log: DataFrame, at) -> DataFrame:
    """(child, parent): membership at a day. The last attach of a child replaces every earlier parent; a detach removes
    only its exact pair, and on the same day it comes after the attach. Children with a conflict are left out; see
    membership_conflicts."""
    seen = log.filter(F.col("day") <= at)
    daily = seen.filter("kind = 'attach'").groupBy("child", "day").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi"))
    last = daily.groupBy("child").agg(F.max_by(F.struct("day", "lo"), "day").alias("a"), F.bool_or(F.col("lo") != F.col("hi")).alias("bad"))
    attached = last.filter("not bad").select("child", F.col("a.lo").alias("parent"), F.col("a.day").alias("since"))
    gone = seen.filter("kind = 'detach'").groupBy("child", "parent").agg(F.max("day").alias("until"))
    return attached.join(gone, ["child", "parent"], "left").filter("until is null or until < since").select("child", "parent")


def presence(log: DataFrame, at) -> DataFrame:
    """(expression, component, outcome): included, excluded or conflict (both on the last day). Log: expression, component,
    kind (include, exclude), day. Expressions inherit nothing from each other."""
    daily = log.filter(F.col("day") <= at).groupBy("expression", "component", "day").agg(F.bool_or(F.col("kind") == "include").alias("i"), F.bool_or(F.col("kind") == "exclude").alias("x"))
    last = daily.groupBy("expression", "component").agg(F.max_by(F.struct("i", "x"), "day").alias("s"))
    return last.select("expression", "component", F.when(F.col("s.i") & F.col("s.x"), "conflict").when(F.col("s.i"), "included").otherwise("excluded").alias("outcome"))


def tree(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, parent, root, depth, path) of a membership fold: roots are parents that are no children, children hang below
    them, and what lies on or only below a pure cycle is left out."""
    h = hierarchy(edges, local_edges=local_edges).filter("not on_cycle").select("node", "parent", "root", "depth", "path")
    roots = edges.select(F.col("parent").alias("root")).distinct().join(edges.select(F.col("child").alias("root")), "root", "left_anti")
    return h.join(roots, "root", "left_semi")


def prune(tree_rows: DataFrame, present: DataFrame, node: str = "node") -> DataFrame:
    """Tree rows that are present or have a present descendant: the paths of present nodes are exploded once."""
    keep = tree_rows.join(present.select(F.col(node).alias("node")).distinct(), "node", "left_semi").select(F.explode("path").alias("node")).distinct()
    return tree_rows.join(keep, "node", "left_semi")


def status_with_structure(statuses: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Temporal join: status rows with parent, number of children and whether the structure is known; it never raises a
    status. The children themselves are rows, see ``children_of``."""
    up = edges.select(F.col("child").alias(key), "parent")
    down = edges.groupBy(F.col("parent").alias(key)).agg(F.count("*").alias("n_children"))
    j = statuses.join(up, key, "left").join(down, key, "left")
    return j.withColumns({"structural_known": F.col("parent").isNotNull() | F.col("n_children").isNotNull(), "n_children": F.coalesce("n_children", F.lit(0))})


def children_of(edges: DataFrame, keys: DataFrame, key: str, order: str) -> DataFrame:
    """(key, place, child): the children of each key in the order of their insertion, as rows."""
    place = F.row_number().over(W.partitionBy("parent").orderBy(order, "child"))
    return edges.join(keys.select(F.col(key).alias("parent")).distinct(), "parent", "left_semi").select(F.col("parent").alias(key), place.alias("place"), "child")


def governing_clock(requests: DataFrame, anchors: DataFrame, governing: str) -> DataFrame:
    """(request, outcome): an anchor of the governing clock resolves; any other anchor is a rejected substitute; none is missing."""
    a = anchors.groupBy("request").agg(F.bool_or(F.col("clock") == governing).alias("g"))
    return requests.select("request").distinct().join(a, "request", "left").select("request", F.when(F.col("g"), "resolved").when(F.col("g").isNotNull(), "substitute_rejected").otherwise("missing_anchor").alias("outcome"))
