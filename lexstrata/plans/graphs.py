"""Queries over links, vectors, event logs, membership and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.ids import cross_act_edge_error
from ..functions.text import tidy, tidy_id
from ..operators import links as K
from ..operators import membership as M
from ..operators import registry as R
from ..operators import temporal as T
from ..operators import vectors as X
from ..session import table

AT = "2024-01-15"


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").filter("obs_id is not null")


# Links -------------------------------------------------------------------------------------------------------------
def link_classes(spark: SparkSession, d: str) -> DataFrame:
    kind, confidence = K.classify_first(F.col("context_sample"))
    return _obs(spark, d).select("obs_id", kind.alias("kind"), confidence.alias("confidence"))


def link_scores(spark: SparkSession, d: str) -> DataFrame:
    kind, confidence = K.classify_scored(F.col("context_sample"))
    _, boost = K.profile(F.lit("acts/law_2013-04-05_44-fz/edition-3.xml"))
    return _obs(spark, d).select("obs_id", kind.alias("kind"), F.round(confidence, 9).alias("confidence"), F.round(K.boosted(kind, confidence, boost), 9).alias("boosted"))


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    kind, _ = K.classify_first(F.col("context_sample"))
    links = _obs(spark, d).filter("work_id is not null and link_text is not null").withColumns({"kind": kind, "p": F.col("obs_id").cast("string")})
    return K.derive_edges(links, "work_id", "link_text", "kind", "p")


def link_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations of links that no rule knows, in their order."""
    unknown = _obs(spark, d).filter(K.classify_first(F.col("context_sample"))[0] == "unknown")
    return K.observations(unknown, "link_text", "context_sample", "work_id", "obs_id").select("link_text", "n", F.coalesce("first_context", F.lit("")).alias("first_context"), "n_dests")


def edition_link_counts(spark: SparkSession, d: str) -> DataFrame:
    kind, _ = K.classify_first(F.col("text"))
    a = table(spark, d, "article_texts").filter("text is not null").select("edition_number", kind.alias("kind"))
    return K.edition_counts(a, ["edition_number"])


def edition_link_deltas(spark: SparkSession, d: str) -> DataFrame:
    cols = ["amends_count", "cites_count", "implements_count", "unknown_count"]
    s = table(spark, d, "edition_summaries").groupBy("edition_number").agg(*[F.max(c).alias(c) for c in cols]).withColumn("act", F.lit("act"))
    return K.edition_deltas(s, ["act"], "edition_number", cols).fillna(0).drop("act")


def catalog_latest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    locators = c.select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("uri:"), F.col("c_custkey").cast("string")).alias("uri"))
    docs = c.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_name")).alias("title"))
    eds = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("edition_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5).cast("int").alias("edition_number"), F.to_date("o_orderdate").alias("revision_date"))
    return K.catalog_lookup(locators, docs, eds).select("uri", "outcome", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("edition_id", F.lit(-1)).alias("edition_id"))


def catalog_misses(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "valid_edges").select(F.col("id").alias("edge_id"), F.coalesce(tidy_id("to_id"), F.lit("")).alias("ref"))
    return K.marked_lookup(e, table(spark, d, "valid_items").select(tidy_id("id").alias("ref")), "ref")


def document_groups(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "documents").select("doc_id", F.coalesce("work_id", F.lit("")).alias("path"), F.coalesce("document_group", F.lit("")).alias("kind"))
    return o.withColumn("g", K.ranked_needles({"path": F.col("path"), "kind": F.col("kind")}, V.GROUP_NEEDLES)).select("doc_id", "g.outcome", "g.value", F.array_join("g.conflicts", ",").alias("conflicts"))


def corpus_roles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_texts").select("article_id", F.coalesce("title", F.lit("")).alias("title"))
    return a.withColumn("g", K.ranked_needles({"title": F.col("title")}, V.ROLE_NEEDLES)).select("article_id", "g.outcome", "g.value")


def cross_act_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "valid_edges")
    kind = F.coalesce(F.lower(tidy("edge_type")), F.lit(""))
    return e.select(F.col("id").alias("edge_id"), cross_act_edge_error(kind, tidy_id("from_id"), tidy_id("to_id"), F.col("rationale"), V.CROSS_ACT_KINDS).alias("error"))


# Vectors -----------------------------------------------------------------------------------------------------------
def _batch_hits(spark: SparkSession, d: str) -> DataFrame:
    """Top 10 of all rows for every row whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return X.top_k_batch(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), 10)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return X.citations(_batch_hits(spark, d)).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "citation", "citation_error")


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    hits = _batch_hits(spark, d)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label").join(hits.select("id").distinct(), "id", "left_semi")
    meta = e.withColumn("metadata", F.array(F.struct(F.lit("label").alias("k"), (F.col("label") % 4).cast("string").alias("v")), F.struct(F.lit("other").alias("k"), F.lit("0").alias("v"))))
    nodes = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("label"))
    labels = X.with_labels(meta, nodes).select("id", F.array_join("labels", ",").alias("labels"))
    return hits.join(labels, "id").select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "labels")


def nodes_by_label(spark: SparkSession, d: str) -> DataFrame:
    return X.by_label(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), 3)


def graph_upserts(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").alias("source"), F.dayofmonth("ts").alias("target"), F.col("event_type").alias("label"), "event_id")
    return X.latest(log, ["source", "target"], "event_id").select("source", "target", "label")


def evidence_answers(spark: SparkSession, d: str) -> DataFrame:
    requested = table(spark, d, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("item"))
    evidence = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item"))
    return X.evidence_outcome(requested, evidence, "request", "item")


# Event logs --------------------------------------------------------------------------------------------------------
def _force(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")


def status_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Asked for: every customer and every user of events."""
    force = _force(spark, d)
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).union(force.select("user_id").na.drop())
    return T.status_as_of(force, "user_id", "day", "event_type", F.lit(AT).cast("date"), users)


def status_at_orders(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(AT).cast("date").alias("at"), "c_nationkey")
    return T.as_of_join(requests, _force(spark, d), "user_id", "at", "day", "event_type").select("user_id", "c_nationkey", F.coalesce("event_type", F.lit("unknown")).alias("status"))


def text_as_of(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_texts").filter("number is not null and work_id is not null and edition_number is not null").withColumn("number", tidy("number"))
    t = T.text_as_of(a, ["work_id", "number"], "edition_number", "text", "article_id", 4)
    return t.select("work_id", "number", "outcome", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.size("texts").alias("n_texts"))


def _order_log(spark: SparkSession, d: str, child: str = "o", parent: str = "c") -> DataFrame:
    """Orders under customers, or customers under orders, by their own keys: each is attached on the order's day and detached
    30 days later where the status is F."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("o"), F.concat(F.lit("c"), "o_custkey").alias("c"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    keys = [F.col(parent).alias("parent"), F.col(child).alias("child")]
    attached = o.select(F.lit("attach").alias("kind"), *keys, "day")
    return attached.unionByName(o.filter("o_orderstatus = 'F'").select(F.lit("detach").alias("kind"), *keys, F.date_add("day", 30).alias("day")))


def membership_fold(spark: SparkSession, d: str) -> DataFrame:
    return T.membership(_order_log(spark, d), F.lit("1997-06-01").cast("date"))


def membership_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """An order has one customer and no conflicts; a customer with several orders on a day has."""
    return T.membership_conflicts(_order_log(spark, d, "c", "o"), F.lit("1997-06-01").cast("date"))


def presence_fold(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").filter("event_type in ('view', 'click')").select(F.col("user_id").alias("expression"), F.floor("value").cast("bigint").alias("component"), F.when(F.col("event_type") == "view", "include").otherwise("exclude").alias("kind"), F.to_date("ts").alias("day"))
    return T.presence(log, F.lit(AT).cast("date"))


def region_tree(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    e = n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
    return T.tree(e).select("node", F.coalesce("parent", F.lit("")).alias("parent"), "root", "depth")


def region_tree_pruned(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    e = n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
    present = c.filter("c_acctbal > 9900").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return T.prune(T.tree(e), present).select("node", "depth")


def status_structure(spark: SparkSession, d: str) -> DataFrame:
    s = T.status_as_of(_force(spark, d), "user_id", "day", "event_type", F.lit(AT).cast("date")).withColumn("user_id", F.concat(F.lit("c"), "user_id"))
    e = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return T.status_with_structure(s, e, "user_id").select("user_id", "status", F.coalesce("parent", F.lit("")).alias("parent"), "n_children", "structural_known")


def clock_anchors(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("request"))
    a = table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_type").alias("clock"))
    return T.governing_clock(r, a, "purchase")


# Membership --------------------------------------------------------------------------------------------------------
def _refines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "valid_edges").filter(F.lower(tidy("edge_type")) == "refines")
    return e.select("id", "work" if "work" in e.columns else F.lit("all").alias("work"), tidy_id("from_id").alias("child"), tidy_id("to_id").alias("parent"), "recorded_at").na.drop(subset=["id", "child", "parent"])


def marker_changes(spark: SparkSession, d: str) -> DataFrame:
    """Markers of every edition against the next lower one that has rows, under the higher edition's number."""
    m = table(spark, d, "marker_bodies")
    counted = m.filter("number is not null and work_id is not null").select("work_id", "marker_level", tidy("number").alias("number"), "edition_number", "marker_id")
    before, after = M.edition_pairs(m, "edition_number", counted)
    return M.marker_diff(before, after, ["edition_number", "work_id", "marker_level", "number"]).select("edition_number", "marker_id", "change")


def text_changes(spark: SparkSession, d: str) -> DataFrame:
    """Texts of every edition against the next lower one that has rows, under the higher edition's number."""
    a = table(spark, d, "article_texts")
    key = ["edition_number", "work_id", "number"]
    counted = a.filter("number is not null and work_id is not null and edition_number is not null").withColumn("number", tidy("number"))
    before, after = M.edition_pairs(a, "edition_number", M.first_of_key(counted.select(*key, "text", "article_id"), key, "article_id"))
    return M.text_drafts(before, after, key, "text")


def structure_drift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").filter("o_orderdate < '1996-01-01'").select(F.col("o_custkey").alias("id"))
    return M.drift(e, table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")


def _healed(log: DataFrame, name: str) -> DataFrame:
    at = F.lit("1997-06-01").cast("date")
    expected = log.filter("kind = 'attach'").groupBy("child").agg(F.min("parent").alias("parent"))
    seen = log.filter(F.col("day") <= at)
    now = T.membership(seen, at)
    days = seen.withColumn("day", F.datediff("day", F.lit("1970-01-01").cast("date")))
    left = M.drift(expected, T.membership(M.heal(days, expected, now.select("child"), 20000), 30000), "child")
    return M.drift(expected, now, "child").select(F.lit(name).alias("log"), F.col("missing").alias("absent")).crossJoin(left.select("missing"))


def healed_drift(spark: SparkSession, d: str) -> DataFrame:
    """Children absent at the day and children missing after healing, of all that are ever attached. Those with a conflict
    count as well: membership leaves them out, so healing can't bring them back."""
    return _healed(_order_log(spark, d), "orders").unionByName(_healed(_order_log(spark, d, "c", "o"), "customers"))


def forest_roots(spark: SparkSession, d: str) -> DataFrame:
    return M.forest_roots(_refines(spark, d))


def edge_guards(spark: SparkSession, d: str) -> DataFrame:
    return M.insert_guards(_refines(spark, d).groupBy("id").agg(F.min("child").alias("child"), F.min("parent").alias("parent")), "id").groupBy("guard").agg(F.count("*").alias("n"))


def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    e = _refines(spark, d).select(F.col("child").alias("node"), F.col("parent").alias("dep"))
    tops = table(spark, d, "valid_items").select(tidy_id("id").alias("node"), F.lit(None).cast("string").alias("dep")).filter("node is not null").distinct()
    seeds = e.select(F.col("node").alias("seed")).distinct()
    return M.bounded_closure(e.unionByName(tops), seeds).groupBy("outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_affected"), F.lit(0)).alias("affected"))


def admitted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Admission by supplier: each line proposes its part under the part of the line before it in its order."""
    from pyspark.sql.window import Window as W

    li = table(spark, d, "lineitem")
    before = F.lag("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    o = li.select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("p"), "l_partkey").alias("child"), F.concat(F.lit("p"), before).alias("parent"))
    return M.admit(o.na.drop(subset=["parent"]), "doc").groupBy("doc", "outcome").agg(F.count("*").alias("n"))


def registry_bindings(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "marker_bodies").filter("work_id is not null and number is not null and marker_level is not null").select("work_id", "marker_level", tidy("number").alias("number"), F.coalesce("title", F.lit("")).alias("title"))
    return M.registry(m, ["work_id", "marker_level", "number"], "title").select("work_id", "marker_level", "number", "outcome")


def write_set_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_texts").filter("number is not null").withColumns({"component": F.concat("work_id", F.lit("/"), tidy("number")), "expression": F.concat("work_id", F.lit(":"), "edition_number")})
    n, e = M.write_set([(a, "Work", "work_id"), (a, "Expression", "expression"), (a, "ComponentConcept", "component")], [(a, "expression_of", "expression", "work_id"), (a, "component_in_expression", "component", "expression")], V.NODE_KINDS, V.EDGE_KINDS)
    return n.groupBy("kind").agg(F.count("*").alias("n")).unionByName(e.groupBy("kind").agg(F.count("*").alias("n")))


# Registry ----------------------------------------------------------------------------------------------------------
def _items(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "valid_items").withColumn("item_id", tidy_id("id")).filter("item_id is not null")
    rest = ["item_type", "status", "risk_level", "proof_level", "source_anchors", "owner", "layer"]
    return X.latest(i.select("item_id", *rest, F.struct("recorded_at", "id", "title").alias("o")), ["item_id"], "o").select("item_id", *rest)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "valid_edges").select(F.col("id").alias("edge_id"), tidy_id("from_id").alias("from_id"), tidy_id("to_id").alias("to_id"), F.lower(tidy("edge_type")).alias("edge_type"), "status")


def registry_missing_ends(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_endpoints(_edges(spark, d), _items(spark, d))


def registry_untraced(spark: SparkSession, d: str) -> DataFrame:
    return R.untraced(_items(spark, d).select("item_id", "item_type"), _edges(spark, d), V.CRITICAL_TYPES)


def registry_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return R.contradictions(_edges(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def registry_unchecked(spark: SparkSession, d: str) -> DataFrame:
    return R.unchecked(_items(spark, d).select("item_id", "item_type", "risk_level", "status"), _edges(spark, d), ["high", "critical"], V.CHECKING_EDGES, ["evidence", "gate", "proof_gate"])


def registry_superseded(spark: SparkSession, d: str) -> DataFrame:
    return R.superseded_without_edge(_items(spark, d).select("item_id", "status"), _edges(spark, d))


def registry_evidence(spark: SparkSession, d: str) -> DataFrame:
    need = {"unit-test": ["test-artifact"], "integration-test": ["test-artifact", "runtime-artifact"], "static-check": ["source-code"]}
    return R.evidence_boundary(_items(spark, d).withColumn("status", F.lit("validated")), need).groupBy("proof_level").agg(F.count("*").alias("n"))


def registry_buckets(spark: SparkSession, d: str) -> DataFrame:
    return R.buckets(_items(spark, d), "risk_level", {"critical": "P0", "high": "P1", "medium": "P2"}, "P3", "item_id")


def registry_matrix(spark: SparkSession, d: str) -> DataFrame:
    return R.filled_counts(_items(spark, d), "item_type", "status", ["active", "proposed", "superseded", "rejected", "never"])


def registry_surfaces(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "valid_items").select("id", "summary").filter("id is not null")
    return R.surfaces(i, "id", "summary", {"article": "article", "draft": "draft"}).groupBy("in_article", "in_draft").agg(F.count("*").alias("n"))


def registry_coverage(spark: SparkSession, d: str) -> DataFrame:
    declared = _items(spark, d).select(F.col("item_id").alias("ref"))
    return R.coverage(declared, _edges(spark, d).select(F.col("to_id").alias("ref")).na.drop(), "ref").groupBy("state").agg(F.count("*").alias("n"))


def extractor_scores(spark: SparkSession, d: str) -> DataFrame:
    """Labels as the gold set, a rule on the text as the extractor."""
    docs = table(spark, d, "documents").filter("text is not null")
    gold = docs.filter("lang is not null").select(F.lower(F.substring(tidy("lang"), 1, 2)).alias("layer"), "doc_id")
    found = docs.select(F.when(F.col("text").rlike("[а-яА-Я]"), "ru").otherwise("en").alias("layer"), "doc_id")
    e = R.evaluation(gold, found, "layer", ["doc_id"])
    return e.select("layer", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def conformance_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") > 49.5, "fail").when(F.col("l_quantity") > 48.5, "unsupported").otherwise("pass").alias("r"))
    return R.conformance(r, ["l_suppkey"], "r")


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = _edges(spark, d).withColumns({"edge_type": F.coalesce("edge_type", F.lit("")), "status": F.coalesce("status", F.lit(""))}).rollup("edge_type", "status").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("edge_type", F.lit("*")).alias("edge_type"), F.coalesce("status", F.lit("*")).alias("status"), "n")


def chain_check(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    e = table(spark, d, "events").select("user_id", "event_id", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256).alias("own"))
    order = W.partitionBy("user_id").orderBy("event_id")
    chain = e.withColumns({"seq": F.row_number().over(order), "prev": F.lag("own").over(order)})
    broken = chain.withColumns({"prev": F.when(F.col("event_id") % 100 == 7, F.lit("x")).otherwise(F.col("prev")), "seq": F.when(F.col("event_id") % 250 == 9, F.col("seq") + 1).otherwise(F.col("seq"))})
    return R.chain_violations(broken, "user_id", "seq", "own", "prev").groupBy("violation").agg(F.count("*").alias("n"))


def replay_outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select("event_id", F.col("user_id").alias("op"), F.col("event_type").alias("effect"), "value")
    return R.replay(r, "op", "effect", "event_id", [(F.col("value") < 1, "incomplete"), (F.col("value") > 99, "corrupt")]).groupBy("op", "outcome").agg(F.count("*").alias("n"))


def intake_attempts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").filter("context_sample is not null").select("obs_id", F.sha2("context_sample", 256).alias("item"))
    return R.attempts(o, "item", "obs_id").select("obs_id", "attempt")


QUERIES = {f.__name__: f for f in (
    link_classes, link_scores, link_edges, link_observations, edition_link_counts, edition_link_deltas, catalog_latest, catalog_misses, document_groups, corpus_roles,
    cross_act_edges, vector_topk, vector_labels, nodes_by_label, graph_upserts, evidence_answers, status_as_of, status_at_orders, text_as_of, membership_fold,
    membership_conflicts, presence_fold, healed_drift, admitted_edges, region_tree, region_tree_pruned, status_structure, clock_anchors, marker_changes, text_changes,
    structure_drift, forest_roots, edge_guards, dependency_closure, registry_bindings, write_set_counts, registry_missing_ends, registry_untraced, registry_contradictions,
    registry_unchecked, registry_superseded, registry_evidence, registry_buckets, registry_matrix, registry_surfaces, registry_coverage, extractor_scores,
    conformance_rollup, status_rollup, chain_check, replay_outcomes, intake_attempts,
)}

# The same results in SQL -----------------------------------------------------------------------------------------
_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(8195)||chr(8201)||chr(8239)||chr(12288)"


def _tid(c: str) -> str:
    return f"nullif(upper(trim({c}, {_WS})), '')"


def _first(c: str, what: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(coalesce({c}, '')), '{r[1].lower()}') THEN " + (f"'{r[0]}'" if what == 0 else str(r[2])) for r in V.LINK_RULES) + (" ELSE 'unknown' END" if what == 0 else " ELSE 0.1 END")


def _scored() -> str:
    low, cols, names = "lower(coalesce(context_sample, ''))", [], []
    for name, _, confidence, match, needles, variants in V.LINK_TEMPLATES:
        signals = [f"contains({low}, '{n.lower()}')" for n in needles] + (["(" + " OR ".join(f"contains({low}, '{v.lower()}')" for v in variants) + ")"] if variants else [])
        hits = " + ".join(f"{x}::int" for x in signals)
        cols.append((f"CASE WHEN {hits} = {len(signals)} THEN {confidence} ELSE 0 END" if match == "all" else f"({hits}) / {len(signals)}::double * {confidence}") + f" AS {name}")
        names.append(name)
    best = f"greatest(0.1, {', '.join(names)})"
    kind = "CASE WHEN " + best + " = 0.1 THEN 'unknown' " + " ".join(f"WHEN {t[0]} = {best} THEN '{t[1]}'" for t in V.LINK_TEMPLATES) + " END"
    return f"SELECT obs_id, {kind} AS kind, round({best}::double, 9) AS confidence, round({best}::double * 1.0, 9) AS boosted FROM (SELECT obs_id, {', '.join(cols)} FROM observations)"


def _ranked(fields: dict[str, str], needles, source: str, key: str, conflicts: bool) -> str:
    rows = ", ".join(f"('{g}', '{f}', '{n.lower()}', {r})" for g, f, n, r in needles if f in fields)
    value = "CASE f " + " ".join(f"WHEN '{f}' THEN lower(coalesce({c}, ''))" for f, c in fields.items()) + " END"
    extra = ", CASE WHEN len(vs) > 1 THEN array_to_string(list_sort(vs), ',') ELSE '' END AS conflicts" if conflicts else ""
    return f"""WITH n(g, f, x, r) AS (VALUES {rows}), h AS (SELECT s.{key}, g, r FROM {source} s, n WHERE contains({value}, x)),
      b AS (SELECT {key}, list(DISTINCT g) AS vs FROM h WHERE r = (SELECT min(r) FROM h k WHERE k.{key} = h.{key}) GROUP BY 1)
      SELECT s.{key}, CASE WHEN vs IS NULL THEN 'unknown' WHEN len(vs) > 1 THEN 'conflict' ELSE 'found' END AS outcome, CASE WHEN len(vs) = 1 THEN vs[1] ELSE '' END AS value{extra} FROM {source} s LEFT JOIN b USING ({key})"""


_FORCE = f"""WITH f AS (SELECT user_id, ts::date AS day, event_type FROM events WHERE user_id IS NOT NULL AND ts::date <= DATE '{AT}'),
  l AS (SELECT user_id, min(event_type) AS lo, max(event_type) AS hi FROM f WHERE day = (SELECT max(day) FROM f g WHERE g.user_id = f.user_id) GROUP BY 1),
  st AS (SELECT user_id, CASE WHEN lo = hi THEN lo ELSE 'unknown' END AS status, CASE WHEN lo = hi THEN 'resolved' ELSE 'conflict' END AS outcome FROM l)"""

def _order_sql(log: str, child: str, parent: str) -> str:
    """CTEs {log}_log, its attaches by day and fold at the day, then the same with what is healed."""
    keys = {"o": "'o' || o_orderkey", "c": "'c' || o_custkey"}

    def fold(name: str, source: str) -> str:
        return f"""{name}_daily AS (SELECT child, day, min(parent) AS lo, count(DISTINCT parent) AS k FROM {source} WHERE kind = 'attach' GROUP BY 1, 2), {name}_last AS (SELECT child, arg_max(lo, day) AS parent, max(day) AS since, bool_or(k > 1) AS bad FROM {name}_daily GROUP BY 1),
  {name}_gone AS (SELECT child, parent, max(day) AS until FROM {source} WHERE kind = 'detach' GROUP BY 1, 2),
  {name}_fold AS (SELECT l.child, l.parent FROM {name}_last l LEFT JOIN {name}_gone g ON g.child = l.child AND g.parent = l.parent WHERE NOT bad AND (until IS NULL OR until < since))"""

    return f"""{log}_all AS (SELECT 'attach' AS kind, {keys[child]} AS child, {keys[parent]} AS parent, o_orderdate::date AS day FROM orders UNION ALL SELECT 'detach', {keys[child]}, {keys[parent]}, o_orderdate::date + 30 FROM orders WHERE o_orderstatus = 'F'),
  {log}_log AS (SELECT * FROM {log}_all WHERE day <= DATE '1997-06-01'), {fold(log, log + '_log')},
  {log}_due AS (SELECT child, min(parent) AS parent FROM {log}_all WHERE kind = 'attach' GROUP BY 1),
  {log}_more AS (SELECT * FROM {log}_log UNION ALL SELECT 'attach', child, parent, DATE '2024-10-04' FROM {log}_due WHERE child NOT IN (SELECT child FROM {log}_fold)), {fold(log + '_healed', log + '_more')}"""


def _healed_sql(log: str) -> str:
    return f"SELECT '{log}' AS log, count(*) FILTER (child NOT IN (SELECT child FROM {log}_fold)) AS absent, count(*) FILTER (child NOT IN (SELECT child FROM {log}_healed_fold)) AS missing FROM {log}_due"


_TREE = "WITH e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), roots AS (SELECT DISTINCT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e))"
_REFINES = f"(SELECT id, {_tid('from_id')} AS child, {_tid('to_id')} AS parent FROM valid_edges WHERE lower(trim(edge_type, {_WS})) = 'refines' AND id IS NOT NULL AND {_tid('from_id')} IS NOT NULL AND {_tid('to_id')} IS NOT NULL)"
_ITEMS = f"items AS (SELECT * FROM (SELECT *, {_tid('id')} AS item_id, row_number() OVER (PARTITION BY {_tid('id')} ORDER BY recorded_at DESC NULLS LAST, id DESC, title DESC NULLS LAST) AS rn FROM valid_items) WHERE rn = 1 AND item_id IS NOT NULL)"
_EDGES = f"edges AS (SELECT id AS edge_id, {_tid('from_id')} AS from_id, {_tid('to_id')} AS to_id, lower(trim(edge_type, {_WS})) AS edge_type, status FROM valid_edges)"
_MK = f"(SELECT work_id, marker_level, trim(number, {_WS}) AS number, edition_number, marker_id FROM marker_bodies WHERE number IS NOT NULL AND work_id IS NOT NULL)"
_ART = f"(SELECT *, trim(number, {_WS}) AS n FROM article_texts WHERE number IS NOT NULL AND work_id IS NOT NULL AND edition_number IS NOT NULL)"
_COS = "list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::double * x[2]::double))"
_BATCH = f"""q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 50 = 0),
  scored AS (SELECT query_id, vec_id, label, greatest(0, least(1, {_COS} / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q, lambda x: x::double * x::double)))))) AS score
  FROM embeddings, q WHERE embedding IS NOT NULL), hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= 10)"""
_GOLD = "gold AS (SELECT DISTINCT lower(trim(lang)[1:2]) AS layer, doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), found AS (SELECT DISTINCT CASE WHEN regexp_matches(text, '[а-яА-Я]') THEN 'ru' ELSE 'en' END AS layer, doc_id FROM documents WHERE text IS NOT NULL)"
_COUNTS = ("amends_count", "cites_count", "implements_count", "unknown_count")

ORACLES: dict[str, str] = {
    "link_classes": f"SELECT obs_id, {_first('context_sample', 0)} AS kind, ({_first('context_sample', 1)})::double AS confidence FROM observations WHERE obs_id IS NOT NULL",
    "link_scores": _scored(),
    "link_edges": f"""SELECT CASE WHEN kind = 'amends' THEN link_text ELSE work_id END AS edge_from, CASE WHEN kind = 'amends' THEN work_id ELSE link_text END AS edge_to, kind, obs_id::varchar AS provenance
      FROM (SELECT *, {_first('context_sample', 0)} AS kind FROM observations WHERE work_id IS NOT NULL AND link_text IS NOT NULL AND obs_id IS NOT NULL) WHERE kind <> 'unknown'""",
    "link_observations": f"SELECT link_text, count(*) AS n, coalesce(nullif(min_by(coalesce(context_sample, chr(0)), obs_id), chr(0)), '') AS first_context, count(DISTINCT work_id) AS n_dests FROM observations WHERE link_text IS NOT NULL AND obs_id IS NOT NULL AND {_first('context_sample', 0)} = 'unknown' GROUP BY link_text",
    "edition_link_counts": f"SELECT edition_number, count(*) AS n_links, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("amends", "cites", "implements", "specifies", "unknown")) + f" FROM (SELECT edition_number, {_first('text', 0)} AS kind FROM article_texts WHERE text IS NOT NULL) GROUP BY 1",
    "edition_link_deltas": "SELECT edition_number, " + ", ".join(f"coalesce({c} - lag({c}) OVER (ORDER BY edition_number), 0) AS d_{c}" for c in _COUNTS) + " FROM (SELECT edition_number, " + ", ".join(f"max({c}) AS {c}" for c in _COUNTS) + " FROM edition_summaries GROUP BY 1)",
    "catalog_latest": """WITH e AS (SELECT o_custkey AS s, arg_max(o_orderkey, {'a': coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END, 0), 'b': strftime(o_orderdate, '%Y-%m-%d'), 'c': o_orderkey}) AS edition_id FROM orders GROUP BY 1)
      SELECT 'uri:' || c_custkey AS uri, CASE WHEN c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 11 = 0 OR coalesce(trim(c_name), '') = '' THEN 'error: no title' ELSE 'found' END AS outcome,
      CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN coalesce(c_name, '') ELSE '' END AS title, coalesce(edition_id, -1) AS edition_id FROM customer LEFT JOIN e ON s = c_custkey""",
    "catalog_misses": f"SELECT id AS edge_id, coalesce({_tid('to_id')}, '') AS ref, coalesce({_tid('to_id')} IN (SELECT {_tid('id')} FROM valid_items WHERE {_tid('id')} IS NOT NULL), false) AS in_catalog, CASE WHEN {_tid('to_id')} IS NULL THEN 'empty id' ELSE '' END AS error FROM valid_edges",
    "document_groups": _ranked({"path": "work_id", "kind": "document_group"}, V.GROUP_NEEDLES, "documents", "doc_id", True),
    "corpus_roles": _ranked({"title": "title"}, V.ROLE_NEEDLES, "article_texts", "article_id", False),
    "cross_act_edges": f"""SELECT id AS edge_id, CASE WHEN {_tid('from_id')} IS NOT DISTINCT FROM {_tid('to_id')} THEN 'self edge' WHEN coalesce(lower(trim(edge_type, {_WS})), '') NOT IN ({", ".join(f"'{k}'" for k in V.CROSS_ACT_KINDS)}) THEN 'unknown kind'
      WHEN coalesce(trim(rationale), '') = '' THEN 'missing provenance' ELSE '' END AS error FROM valid_edges""",
    "vector_topk": f"WITH {_BATCH} SELECT query_id, vec_id, round(score, 6) AS score, 'vector-store:' || vec_id AS citation, '' AS citation_error FROM hits",
    "vector_labels": f"WITH {_BATCH} SELECT query_id, vec_id, coalesce(r_name, '') AS labels FROM hits LEFT JOIN region ON r_regionkey = label % 4",
    "nodes_by_label": "SELECT vec_id AS id, label FROM embeddings WHERE label = 3",
    "graph_upserts": "SELECT user_id AS source, day(ts)::int AS target, arg_max(event_type, event_id) AS label FROM events GROUP BY 1, 2",
    "evidence_answers": """SELECT o_custkey AS request, count(*) AS requested, count(*) FILTER (hit) AS found, CASE WHEN count(*) FILTER (hit) = 0 THEN 'no_answer' WHEN count(*) FILTER (hit) = count(*) THEN 'answered' ELSE 'partial' END AS outcome
      FROM (SELECT o_custkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS hit FROM orders) GROUP BY 1""",
    "status_as_of": f"{_FORCE} SELECT u.u AS user_id, coalesce(status, 'unknown') AS status, coalesce(outcome, 'unknown') AS outcome FROM (SELECT c_custkey AS u FROM customer UNION SELECT user_id FROM events WHERE user_id IS NOT NULL) u LEFT JOIN st ON st.user_id = u.u",
    "status_at_orders": f"""WITH e AS (SELECT user_id, ts::date AS day, max(event_type) AS v FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
      SELECT c_custkey AS user_id, c_nationkey, coalesce((SELECT arg_max(v, day) FROM e WHERE e.user_id = c_custkey AND day <= DATE '{AT}'), 'unknown') AS status FROM customer""",
    "text_as_of": f"""WITH a AS (SELECT * FROM {_ART} WHERE edition_number <= 4), t AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY work_id, n ORDER BY edition_number DESC) AS r FROM a) WHERE r = 1)
      SELECT work_id, n AS number, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'conflict' END AS outcome, md5(CASE WHEN count(*) = 1 THEN coalesce(max(text), '') ELSE '' END) AS text_md5, CAST(CASE WHEN count(*) = 1 THEN 0 ELSE count(*) END AS INT) AS n_texts FROM t GROUP BY 1, 2""",
    "membership_fold": f"WITH {_order_sql('orders', 'o', 'c')} SELECT child, parent FROM orders_fold",
    "membership_conflicts": f"WITH {_order_sql('customers', 'c', 'o')} SELECT day, child, k AS n_parents FROM customers_daily WHERE k > 1",
    "presence_fold": f"""WITH d AS (SELECT user_id AS expression, floor(value)::bigint AS component, ts::date AS day, bool_or(event_type = 'view') AS i, bool_or(event_type = 'click') AS x FROM events WHERE event_type IN ('view', 'click') AND ts::date <= DATE '{AT}' GROUP BY 1, 2, 3)
      SELECT expression, component, CASE WHEN i AND x THEN 'conflict' WHEN i THEN 'included' ELSE 'excluded' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY expression, component ORDER BY day DESC) AS r FROM d) WHERE r = 1""",
    "healed_drift": f"WITH {_order_sql('orders', 'o', 'c')}, {_order_sql('customers', 'c', 'o')} {_healed_sql('orders')} UNION ALL {_healed_sql('customers')}",
    "region_tree": f"{_TREE} SELECT node, '' AS parent, node AS root, 0 AS depth FROM roots UNION ALL SELECT e.child, e.parent, e.parent, 1 FROM e JOIN roots ON roots.node = e.parent UNION ALL SELECT f.child, f.parent, e.parent, 2 FROM e JOIN roots ON roots.node = e.parent JOIN e f ON f.parent = e.child",
    "region_tree_pruned": "WITH p AS (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9900) SELECT DISTINCT 'c' || c_custkey AS node, 2 AS depth FROM p UNION SELECT 'n' || n_nationkey, 1 FROM p UNION SELECT 'r' || n_regionkey, 0 FROM p",
    "status_structure": f"{_FORCE} SELECT 'c' || user_id AS user_id, status, coalesce('n' || c_nationkey, '') AS parent, 0::bigint AS n_children, c_custkey IS NOT NULL AS structural_known FROM st LEFT JOIN customer ON c_custkey = user_id",
    "clock_anchors": "SELECT c_custkey AS request, CASE WHEN bool_or(event_type = 'purchase') THEN 'resolved' WHEN count(event_id) > 0 THEN 'substitute_rejected' ELSE 'missing_anchor' END AS outcome FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1",
    "marker_changes": f"""WITH x AS (SELECT e, lag(e) OVER (ORDER BY e) AS b FROM (SELECT DISTINCT edition_number AS e FROM marker_bodies WHERE edition_number IS NOT NULL)), m AS {_MK}
      SELECT x.e AS edition_number, marker_id, 'removed' AS change FROM m a JOIN x ON a.edition_number = x.b WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.edition_number = x.e AND a.work_id = b.work_id AND a.marker_level = b.marker_level AND a.number = b.number)
      UNION ALL SELECT x.e, marker_id, 'added' FROM m a JOIN x ON a.edition_number = x.e AND x.b IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.edition_number = x.b AND a.work_id = b.work_id AND a.marker_level = b.marker_level AND a.number = b.number)""",
    "text_changes": f"""WITH x AS (SELECT e, lag(e) OVER (ORDER BY e) AS before FROM (SELECT DISTINCT edition_number AS e FROM article_texts WHERE edition_number IS NOT NULL)),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edition_number, work_id, n ORDER BY article_id) AS r FROM {_ART}) WHERE r = 1),
      a AS (SELECT x.e, f.* FROM f JOIN x ON edition_number = x.e AND x.before IS NOT NULL), b AS (SELECT x.e, f.* FROM f JOIN x ON edition_number = x.before)
      SELECT coalesce(a.e, b.e) AS edition_number, coalesce(a.work_id, b.work_id) AS work_id, coalesce(a.n, b.n) AS number, CASE WHEN a.e IS NULL THEN 'detach' ELSE 'attach' END AS kind FROM a FULL JOIN b ON a.e = b.e AND a.work_id = b.work_id AND a.n = b.n
      WHERE a.e IS NULL OR b.e IS NULL OR a.text IS DISTINCT FROM b.text""",
    "structure_drift": """WITH e AS (SELECT o_custkey AS id FROM orders WHERE o_orderdate < '1996-01-01'), d AS (SELECT DISTINCT id FROM e) SELECT count(*) FILTER (c_custkey IS NULL) AS missing, count(*) FILTER (id IS NULL) AS phantom,
      count(*) FILTER (c_custkey IS NULL OR id IS NULL) AS drift, (SELECT count(id) FROM e) AS expected FROM d FULL JOIN customer ON c_custkey = id""",
    "dependency_closure": f"""WITH RECURSIVE e AS (SELECT DISTINCT child, parent FROM {_REFINES}), reach AS (SELECT DISTINCT child AS seed, child AS n FROM e UNION SELECT r.seed, e.parent FROM reach r JOIN e ON e.child = r.n),
      known AS (SELECT child AS n FROM e UNION SELECT {_tid('id')} FROM valid_items WHERE {_tid('id')} IS NOT NULL), s AS (SELECT seed, count(*) AS k, bool_and(reach.n IN (SELECT n FROM known)) AS ok FROM reach GROUP BY 1),
      o AS (SELECT CASE WHEN k > 8 THEN 'unbounded' WHEN NOT ok THEN 'incomplete' ELSE 'complete' END AS outcome, k FROM s) SELECT outcome, count(*) AS n, coalesce(sum(k) FILTER (outcome = 'complete'), 0)::bigint AS affected FROM o GROUP BY 1""",
    "edge_guards": f"""WITH e AS (SELECT id, min(child) AS c, min(parent) AS p FROM {_REFINES} GROUP BY id), g AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM e b WHERE b.id < a.id AND b.c = a.c AND b.p = a.p) THEN 'duplicate'
      WHEN EXISTS (SELECT 1 FROM e b WHERE b.id < a.id AND b.c = a.p AND b.p = a.c) THEN 'reverse' WHEN EXISTS (SELECT 1 FROM e b WHERE b.id < a.id AND b.c = a.c) THEN 'multiple_parents' ELSE '' END AS guard FROM e a) SELECT guard, count(*) AS n FROM g GROUP BY 1""",
    "forest_roots": f"SELECT DISTINCT parent AS node FROM {_REFINES} WHERE parent NOT IN (SELECT child FROM {_REFINES})",
    "registry_bindings": f"SELECT work_id, marker_level, trim(number, {_WS}) AS number, CASE WHEN count(DISTINCT coalesce(title, '')) = 1 THEN 'bound' ELSE 'conflict' END AS outcome FROM marker_bodies WHERE work_id IS NOT NULL AND number IS NOT NULL AND marker_level IS NOT NULL GROUP BY ALL",
    "write_set_counts": f"""WITH a AS (SELECT work_id, work_id || ':' || edition_number AS x, work_id || '/' || trim(number, {_WS}) AS c FROM article_texts WHERE number IS NOT NULL)
      SELECT 'Work' AS kind, count(DISTINCT work_id) AS n FROM a UNION ALL SELECT 'Expression', count(DISTINCT x) FROM a UNION ALL SELECT 'ComponentConcept', count(DISTINCT c) FROM a
      UNION ALL SELECT 'expression_of', count(*) FROM a WHERE x IS NOT NULL AND work_id IS NOT NULL UNION ALL SELECT 'component_in_expression', count(*) FROM a WHERE x IS NOT NULL AND c IS NOT NULL""",
    "registry_missing_ends": f"WITH {_ITEMS}, {_EDGES}, e AS (SELECT edge_id, 'from' AS side, from_id AS ref FROM edges UNION ALL SELECT edge_id, 'to', to_id FROM edges) SELECT * FROM e WHERE ref IS NOT NULL AND ref NOT IN (SELECT item_id FROM items)",
    "registry_untraced": f"WITH {_ITEMS}, {_EDGES} SELECT item_id, item_type FROM items WHERE item_type IN ({', '.join(repr(t) for t in V.CRITICAL_TYPES)}) AND item_id NOT IN (SELECT from_id FROM edges WHERE from_id IS NOT NULL UNION SELECT to_id FROM edges WHERE to_id IS NOT NULL)",
    "registry_contradictions": f"WITH {_EDGES} SELECT status, count(*) AS n FROM edges WHERE edge_type = 'contradicts' AND status IN ('active', 'hypothesis', 'bounded-evidence') GROUP BY 1",
    "registry_unchecked": f"""WITH {_ITEMS}, {_EDGES} SELECT item_id, risk_level FROM items WHERE risk_level IN ('high', 'critical') AND status = 'active' AND item_id NOT IN
      (SELECT from_id FROM edges WHERE from_id IS NOT NULL AND edge_type IN ({', '.join(repr(t) for t in V.CHECKING_EDGES)}) AND status = 'active' AND to_id IN (SELECT item_id FROM items WHERE item_type IN ('evidence', 'gate', 'proof_gate')))""",
    "registry_superseded": f"WITH {_ITEMS}, {_EDGES} SELECT item_id FROM items WHERE status = 'superseded' AND item_id NOT IN (SELECT CASE WHEN edge_type = 'supersedes' THEN to_id ELSE from_id END AS x FROM edges WHERE status = 'active' AND edge_type IN ('supersedes', 'superseded_by') AND CASE WHEN edge_type = 'supersedes' THEN to_id ELSE from_id END IS NOT NULL)",
    "registry_evidence": f"""WITH {_ITEMS} SELECT proof_level, count(*) AS n FROM items WHERE proof_level IN ('unit-test', 'integration-test', 'static-check') AND NOT coalesce(list_has_any(list_transform(source_anchors, lambda a: a.kind),
      CASE proof_level WHEN 'unit-test' THEN ['test-artifact'] WHEN 'integration-test' THEN ['test-artifact', 'runtime-artifact'] ELSE ['source-code'] END), false) GROUP BY 1""",
    "registry_buckets": f"WITH {_ITEMS} SELECT CASE risk_level WHEN 'critical' THEN 'P0' WHEN 'high' THEN 'P1' WHEN 'medium' THEN 'P2' ELSE 'P3' END AS bucket, count(*) AS n FROM items GROUP BY 1",
    "registry_matrix": f"WITH {_ITEMS} SELECT item_type, " + ", ".join(f"count(*) FILTER (status = '{k}') AS n_{k}" for k in ("active", "proposed", "superseded", "rejected", "never")) + " FROM items GROUP BY 1",
    "registry_surfaces": "SELECT contains(lower(coalesce(summary, '')), 'article') AS in_article, contains(lower(coalesce(summary, '')), 'draft') AS in_draft, count(*) AS n FROM valid_items WHERE id IS NOT NULL GROUP BY 1, 2",
    "registry_coverage": f"WITH {_ITEMS}, {_EDGES}, t AS (SELECT DISTINCT to_id AS ref FROM edges WHERE to_id IS NOT NULL) SELECT CASE WHEN item_id IS NULL THEN 'undeclared' WHEN ref IS NULL THEN 'uncovered' ELSE 'covered' END AS state, count(*) AS n FROM items FULL JOIN t ON item_id = ref GROUP BY 1",
    "extractor_scores": f"""WITH {_GOLD}, s AS (SELECT coalesce(g.layer, f.layer) AS layer, count(*) FILTER (g.doc_id IS NOT NULL AND f.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn
      FROM gold g FULL JOIN found f ON g.layer = f.layer AND g.doc_id = f.doc_id GROUP BY 1), m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::double ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::double ELSE tp / (tp + fn) END AS r FROM s WHERE tp + fn > 0)
      SELECT layer, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM m""",
    "conformance_rollup": "SELECT l_suppkey, CASE WHEN bool_or(l_quantity > 49.5) THEN 'fail' WHEN bool_or(l_quantity > 48.5) THEN 'unsupported' ELSE 'pass' END AS outcome FROM lineitem GROUP BY 1",
    "status_rollup": f"WITH {_EDGES}, e AS (SELECT coalesce(edge_type, '') AS t, coalesce(status, '') AS s FROM edges) SELECT CASE WHEN grouping(t) = 1 THEN '*' ELSE t END AS edge_type, CASE WHEN grouping(s) = 1 THEN '*' ELSE s END AS status, count(*) AS n FROM e GROUP BY ROLLUP (t, s)",
    "chain_check": """WITH e AS (SELECT user_id, event_id, sha256(event_id || '|' || event_type) AS own FROM events), c AS (SELECT *, row_number() OVER w AS seq, lag(own) OVER w AS prev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      b AS (SELECT user_id, own, CASE WHEN event_id % 100 = 7 THEN 'x' ELSE prev END AS prev, CASE WHEN event_id % 250 = 9 THEN seq + 1 ELSE seq END AS seq FROM c),
      v AS (SELECT *, row_number() OVER w AS k, lag(own) OVER w AS h FROM b WINDOW w AS (PARTITION BY user_id ORDER BY seq, own))
      SELECT 'sequence' AS violation, count(*) AS n FROM v WHERE seq <> k UNION ALL SELECT 'previous', count(*) FROM v WHERE prev IS DISTINCT FROM h""",
    "replay_outcomes": """WITH r AS (SELECT *, user_id AS op, CASE WHEN value < 1 THEN 'incomplete' WHEN value > 99 THEN 'corrupt' ELSE '' END AS e FROM events),
      o AS (SELECT op, CASE WHEN e <> '' THEN e WHEN row_number() OVER (PARTITION BY op, event_type, e ORDER BY event_id) = 1 THEN 'applied' ELSE 'suppressed' END AS outcome FROM r) SELECT op, outcome, count(*) AS n FROM o GROUP BY 1, 2""",
    "intake_attempts": "SELECT obs_id, CAST(row_number() OVER (PARTITION BY sha256(context_sample) ORDER BY obs_id) AS INT) AS attempt FROM observations WHERE context_sample IS NOT NULL",
}
