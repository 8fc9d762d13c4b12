"""Queries that bind, assemble, replay and check, and those over ladders, catalogs and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.hashing import fnv_digest, pair_digest
from ..functions.text import tidy, tidy_id
from ..operators import assembly as A
from ..operators import ladders as D
from ..operators import lexical as L
from ..operators import links as K
from ..operators import membership as M
from ..operators import registry as R
from ..operators import temporal as T
from ..session import table
from . import graphs as G
from .documents import _edition_names
from .lexical import _list

WORKS = [
    {"path_needle": "n-435-fz", "authority": "federal", "act_number": "435-fz", "enactment_date": "2012-01-02", "edition_date": "2014-05-06"},
    {"path_needle": "0003_rev", "authority": "federal", "act_number": "44-fz", "enactment_date": "2013-04-05", "edition_date": "2015-01-01"},
    {"path_needle": "law_none", "authority": "federal", "act_number": "44-fz", "enactment_date": "2013-04-05", "edition_date": "2013-04-05"},
]
LADDERS = {"federal_law": ["statya", "chast", "punkt"], "government_resolution": ["punkt", "podpunkt"], "court_practice": ["statya"]}
CAPS = {"federal_law": 1, "government_resolution": 2, "court_practice": 1}
LADDER = [
    {"token": "prilozhenie", "role": "container", "surface": "Приложение"}, {"token": "punkt", "role": "unit", "suffix": ".", "compound": True},
    {"token": "podpunkt", "role": "subunit", "suffix": ")", "number_style": "letter_cyrillic"}, {"token": "abzats", "role": "subunit", "suffix": ")"},
]


# Markers, bindings and texts -----------------------------------------------------------------------------------------
def _markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "marker_bodies").select("marker_id", "work_id", F.col("marker_level").alias("level"), tidy("number").alias("key_path"), "title", "body", "edition_number", "order_index")


def _bindings(spark: SparkSession, d: str) -> DataFrame:
    """Components of the markers of each work's lowest edition, some of them of no work."""
    m = _markers(spark, d).filter("key_path is not null and level is not null and marker_id % 3 <> 0")
    work = F.when(F.col("marker_id") % 7 > 0, F.col("work_id"))
    return m.select(work.alias("work_id"), "level", "key_path", F.concat(F.lit("cc:"), "marker_id").alias("component"), F.col("marker_id").alias("ord"))


def _bound(spark: SparkSession, d: str) -> DataFrame:
    return A.bind_markers(_markers(spark, d), _bindings(spark, d), "ord")


def bound_markers(spark: SparkSession, d: str) -> DataFrame:
    return _bound(spark, d).select("marker_id", F.coalesce("component", F.lit("")).alias("component"), "outcome")


def component_texts(spark: SparkSession, d: str) -> DataFrame:
    t = A.text_log(_bound(spark, d), "body", "title", F.col("edition_number"))
    return t.groupBy("component", "day").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def component_titles(spark: SparkSession, d: str) -> DataFrame:
    t = A.text_log(_bound(spark, d), "body", "title", F.col("edition_number"), bodies=False)
    return t.groupBy("component").agg(F.count("*").alias("n"), F.min(F.md5("text")).alias("first_md5"))


def write_set_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = V.NODE_KINDS[:2] + V.FORBIDDEN_KINDS[:2] + ["Other", None]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("obs_id") % len(kinds) + 1).cast("int"))
    return table(spark, d, "observations").select("obs_id", A.node_kind_error(kind).alias("error"))


# Trees ---------------------------------------------------------------------------------------------------------------
def _nations(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    return n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))


def assembled_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nations and customers admitted, committed and folded, against nations and the customers in credit."""
    edges = _nations(spark, d).withColumn("outcome", F.lit("admitted"))
    expected = table(spark, d, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("node")).union(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey")))
    return A.assembly_report(A.assemble(edges, 1), expected)


def edition_tree(spark: SparkSession, d: str) -> DataFrame:
    log = _nations(spark, d).select(F.lit("attach").alias("kind"), "parent", "child", F.lit(1).alias("day"))
    c = table(spark, d, "customer")
    shown = c.select(F.lit("e1").alias("expression"), F.concat(F.lit("c"), "c_custkey").alias("component"), F.when(F.col("c_acctbal") > 9000, "include").otherwise("exclude").alias("kind"), F.lit(1).alias("day"))
    return A.edition_tree(log, shown, "e1", 1).select("node", "depth")


def edition_replay(spark: SparkSession, d: str) -> DataFrame:
    """For each edition, the edges of its predecessor with the difference applied."""
    m = _markers(spark, d).filter("work_id is not null and key_path is not null and level is not null")
    edges = m.select("edition_number", F.concat_ws("/", "work_id", "level", "key_path").alias("child"), F.col("work_id").alias("parent"))
    before, after = M.edition_pairs(table(spark, d, "marker_bodies"), "edition_number", edges)
    return A.edition_replay(before, after, "edition_number")


def whole_acts(spark: SparkSession, d: str) -> DataFrame:
    """Parts that an order needs against the pairs of parts that neighbouring lines make."""
    from pyspark.sql.window import Window as W

    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("act"), "l_linenumber", F.concat(F.lit("p"), "l_partkey").alias("node"))
    edges = li.select("act", F.col("node").alias("child"), F.lag("node").over(W.partitionBy("act").orderBy("l_linenumber")).alias("parent")).na.drop()
    return A.complete(li, edges, "act")


def visible_components(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type in ('view', 'click')")
    log = e.select(F.lit("x").alias("expression"), F.col("user_id").cast("string").alias("component"), F.when(F.col("event_type") == "view", "include").otherwise("exclude").alias("kind"), F.to_date("ts").alias("day"))
    members = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("node"))
    return A.visibility(members, T.presence(log, F.lit(G.AT).cast("date")), "x")


def merged_gaps(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "valid_items").filter("id is not null").select("id", "recorded_at", "title", "non_claims", F.transform("source_anchors", lambda a: a["kind"]).alias("kinds"), "generated_draft")
    return i.groupBy("generated_draft").agg(F.sum(F.size(A.merge_gaps(F.col("non_claims"), F.col("kinds"), F.col("generated_draft")))).alias("n")).select(F.coalesce("generated_draft", F.lit(False)).alias("hides"), "n").groupBy("hides").agg(F.sum("n").alias("n"))


def path_expressions(spark: SparkSession, d: str) -> DataFrame:
    n = _edition_names(spark, d).select("path").union(spark.createDataFrame([("x/N-435-FZ/act.xml",), ("law_2013-04-06_44-fz",), ("law_2013-04-05_44-fz/seed",), ("nothing",)], "path string"))
    p = F.col("path")
    return n.select("path", F.coalesce(A.path_expression(p, WORKS), F.lit("")).alias("expression"), F.size(A.path_bindings(p, WORKS)).alias("n_bindings"), F.coalesce(A.path_edition_day(p, WORKS), F.lit(-1)).alias("day"))


# Ladders -------------------------------------------------------------------------------------------------------------
def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.coalesce("document_group", F.lit("")).alias("group"), F.posexplode(F.split("text", "\n")).alias("ix", "line"))


def ladder_units(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    token = F.coalesce(D.style_match(line, LADDER), F.lit(""))
    return _lines(spark, d).select(token.alias("token"), D.surface_prefix(line, "Статья").alias("article"), D.surface_prefix(line, "Приложение").alias("annex")).groupBy("token", "article", "annex").agg(F.count("*").alias("n"))


def _misses(spark: SparkSession, d: str) -> DataFrame:
    m = _lines(spark, d).withColumn("m", L.marker(F.col("line"))).filter("m is not null")
    rows = m.select("group", F.col("m.level").alias("token"), F.size(F.split("m.number", r"\.")).alias("depth"))
    return D.near_misses(rows, CAPS, LADDERS)


def near_misses(spark: SparkSession, d: str) -> DataFrame:
    return D.ranked_near_misses(D.near_miss_census(_misses(spark, d))).select("rank", "kind", "group", "token", "n", F.coalesce("max_depth", F.lit(-1)).alias("max_depth"))


def near_misses_unpatched(spark: SparkSession, d: str) -> DataFrame:
    """The census less what its own proposals for one group cover, after writing and reading them as lines."""
    census = D.near_miss_census(_misses(spark, d))
    read = census.filter(F.col("group") == "federal_law").select(D.parse_proposal(D.proposal_line()).alias("p")).filter("p.error = ''").select("p.kind", "p.fingerprint")
    return D.near_miss_census(_misses(spark, d), read).select("kind", "group", "token", "n")


def unit_report(spark: SparkSession, d: str) -> DataFrame:
    """By group: documents, their articles, and how many article numbers have one text or several."""
    lines = _lines(spark, d).withColumn("m", L.marker(F.col("line")))
    units = lines.filter("m.level = 'statya'").groupBy("group", "doc_id", F.col("m.number").alias("number")).agg(F.count("*").alias("k"))
    by_unit = units.groupBy("group").agg(F.sum("k").alias("n_units"), F.count_if(F.col("k") == 1).alias("n_resolved"), F.count_if(F.col("k") > 1).alias("n_conflicts"))
    return lines.groupBy("group").agg(F.count_distinct("doc_id").alias("n_documents")).join(by_unit, "group", "left").fillna(0)


# Catalogs, digests, registry -------------------------------------------------------------------------------------------
def catalog_coverage(spark: SparkSession, d: str) -> DataFrame:
    return K.coverage_summary(G.catalog_misses(spark, d))


def classifier_recall(spark: SparkSession, d: str) -> DataFrame:
    """Links whose best template says they amend, against the first matching rule; plain article titles as negatives."""
    rule = K.classify_first
    o = table(spark, d, "observations").filter("obs_id is not null").select(F.col("obs_id").alias("item_id"), K.classify_scored(F.col("context_sample"))[0].alias("relation_type"), F.col("context_sample").alias("raw_tooltip"), F.lit("explicit").alias("normalization_status"))
    golden = K.golden_relations(o).withColumn("hit", rule(F.col("raw_tooltip"))[0] == "amends")
    titles = table(spark, d, "article_texts").select(F.col("article_id").alias("source_id"), "title", F.lit("normative").alias("kind"))
    negatives = K.plain_titles(titles, 300).withColumn("hit", rule(F.col("title"))[0] == "amends")
    m = K.measured(golden, negatives, "hit")
    return m.select("hits", "misses", "false_positives", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


def chain_digests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "valid_edges").select("*", F.transform("source_anchors", lambda a: F.coalesce(a["path"], F.lit(""))).alias("refs"))
    parts = [F.coalesce(c, F.lit("")) for c in ("edge_type", "from_id", "to_id", "status")]
    pair = F.transform("source_anchors", lambda a: F.struct(F.coalesce(a["path"], F.lit("")).alias("id"), F.coalesce(a["kind"], F.lit("")).alias("family")))
    distinct = e.select(fnv_digest(*parts, more=F.col("refs")).alias("proposal"), fnv_digest(F.coalesce("id", F.lit("")), more=F.col("refs")).alias("chain"), pair_digest(parts[1], parts[2], pair).alias("pair"))
    return distinct.distinct()


def claim_failures(spark: SparkSession, d: str) -> DataFrame:
    items = G._items(spark, d).withColumn("status", F.when(F.col("risk_level") == "low", "validated").otherwise(F.col("status")))
    return R.claim_lifecycle(items, G._edges(spark, d), ["unit-test", "integration-test"], ["validated_by", "checked_by", "refines"], ["superseded", "rejected"]).groupBy("field", "failure").agg(F.count("*").alias("n"))


def gate_gaps(spark: SparkSession, d: str) -> DataFrame:
    items = G._items(spark, d).withColumns({"item_type": F.lit("proof_gate"), "proof_level": F.lit("none"), "verification": F.col("layer")})
    return R.gate_metadata(items).groupBy("field").agg(F.count("*").alias("n"))


def track_split(spark: SparkSession, d: str) -> DataFrame:
    items = G._items(spark, d).select("item_id", "status", "risk_level")
    tracks = G._edges(spark, d).filter("edge_type is not null and from_id is not null").select(F.col("edge_type").alias("track"), F.col("from_id").alias("item_id")).distinct()
    t = R.track_split(items, tracks, "item_id", ["status", "risk_level"])
    return t.select("track", "n", F.array_join("statuss", ",").alias("statuses"), F.array_join("risk_levels", ",").alias("risk_levels"))


def closure_buckets(spark: SparkSession, d: str) -> DataFrame:
    return R.final_buckets(G._items(spark, d), "status", {"active": "open", "proposed": "open", "superseded": "closed", "rejected": "closed"})


def accepted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders asked for by customer, against the lines that were returned."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("subject"), F.col("o_custkey").alias("object"))
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    proposals = li.select(F.col("l_orderkey").alias("subject"), F.col("o_custkey").alias("object"), F.when(F.col("l_returnflag") == "R", "accepted").otherwise("rejected").alias("outcome"))
    return R.accepted_facts(asked, proposals, ["subject", "object"]).groupBy("is_fact").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    bound_markers, component_texts, component_titles, write_set_kinds, assembled_tree, edition_tree, edition_replay, whole_acts, visible_components, merged_gaps, path_expressions,
    ladder_units, near_misses, near_misses_unpatched, unit_report, catalog_coverage, classifier_recall, chain_digests, claim_failures, gate_gaps, track_split, closure_buckets, accepted_facts,
)}

_WS = G._WS
_M = f"m AS (SELECT marker_id, work_id, marker_level AS level, trim(number, {_WS}) AS key_path, title, body, edition_number FROM marker_bodies)"
_B = f"""WITH {_M}, k AS (SELECT w AS work_id, level, key_path, arg_min('cc:' || marker_id, marker_id) AS component FROM (SELECT *, CASE WHEN marker_id % 7 > 0 THEN work_id END AS w FROM m WHERE key_path IS NOT NULL AND level IS NOT NULL AND marker_id % 3 <> 0) GROUP BY 1, 2, 3),
  x AS (SELECT m.*, component FROM m LEFT JOIN k ON m.work_id IS NOT DISTINCT FROM k.work_id AND m.level = k.level AND m.key_path = k.key_path)"""
_EDGE = "e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
_LINE = "l AS (SELECT doc_id, coalesce(document_group, '') AS grp, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
_LEVEL = "CASE WHEN lower(g.g1) <> '' THEN CASE WHEN lower(g.g1) = 'раздел' THEN 'razdel' ELSE 'glava' END WHEN g.g3 <> '' THEN 'statya' WHEN g.g5 <> '' THEN 'paragraph' WHEN g.g7 = '.' THEN 'chast' ELSE 'punkt' END"
_MARKED = f"{_LINE}, g AS (SELECT *, regexp_extract(line, '{L.marker_pattern()}', ['g1', 'g2', 'g3', 'g4', 'g5', 'g6', 'g7', 'g8']) AS g FROM l WHERE regexp_matches(line, '{L.marker_pattern()}')), u AS (SELECT doc_id, grp, {_LEVEL} AS token, g.g2 || g.g4 || g.g5 || g.g6 AS number FROM g)"
_MISS = f"""WITH {_MARKED}, r AS (SELECT *, len(string_split(number, '.')) AS depth FROM u), s AS (SELECT CASE WHEN {" OR ".join(f"(grp = '{k}' AND token NOT IN ({_list(t)}))" for k, t in LADDERS.items())} THEN 'NonCatalogToken'
  WHEN {" OR ".join(f"(grp = '{k}' AND depth > {c})" for k, c in CAPS.items())} THEN 'DepthOverflow' END AS kind, * FROM r),
  c AS (SELECT kind, grp, token, count(*) AS n, max(CASE WHEN kind = 'DepthOverflow' THEN depth END) AS max_depth FROM s WHERE kind IS NOT NULL GROUP BY 1, 2, 3)"""
_STYLE = "CASE " + " ".join(f"WHEN regexp_matches(line, '{D.numbered_pattern(x)}') THEN '{x['token']}'" for x in LADDER if D.numbered_pattern(x)) + " ELSE '' END"
_PREFIX = "(starts_with(lower(line), '{s}') AND NOT regexp_matches(substr(lower(line), {n} + 1, 1), '\\p{{L}}'))"


def _fnv(c: str) -> str:
    steps = f"list_transform(range(0, strlen({c})), lambda i: ('0x' || substr(hex(encode({c})), 2 * i + 1, 2))::int::hugeint)"
    return f"'fnv1a64:' || lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::hugeint, {steps}), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint)), 16, '0')"


_REFS = "array_to_string(list_concat([{a}], list_transform(coalesce(source_anchors, []), lambda a: {x})), '|')"
_ORD = "date_diff('day', DATE '1800-01-01', DATE '{}')"
_PART = "coalesce(edge_type, '') || '|' || coalesce(from_id, '') || '|' || coalesce(to_id, '') || '|' || coalesce(status, '')"

ORACLES: dict[str, str] = {
    "bound_markers": f"{_B} SELECT marker_id, coalesce(component, '') AS component, CASE WHEN component IS NULL THEN 'unknown' ELSE 'bound' END AS outcome FROM x",
    "component_texts": f"{_B}, t AS (SELECT component, edition_number AS day, CASE WHEN coalesce(trim(body, ' '), '') <> '' THEN trim(body, ' ') ELSE coalesce(trim(title, ' '), '') END AS text FROM x WHERE component IS NOT NULL) SELECT component, day, count(*) AS n, sum(length(text))::bigint AS n_chars FROM t WHERE trim(text, ' ') <> '' GROUP BY 1, 2",
    "component_titles": f"{_B} SELECT component, count(*) AS n, min(md5(title)) AS first_md5 FROM x WHERE component IS NOT NULL AND trim(title, ' ') <> '' GROUP BY 1",
    "write_set_kinds": "SELECT obs_id, CASE WHEN obs_id % 6 IN (2, 3) THEN 'forbidden kind' WHEN obs_id % 6 IN (4, 5) THEN 'unknown kind' ELSE '' END AS error FROM observations",
    "assembled_tree": f"WITH {_EDGE}, n AS (SELECT child AS node FROM e UNION SELECT parent FROM e), x AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal > 0 UNION SELECT 'n' || n_nationkey FROM nation) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT parent) FROM e WHERE parent NOT IN (SELECT child FROM e)) AS roots, (SELECT count(*) FROM x WHERE node NOT IN (SELECT node FROM n)) AS missing, (SELECT count(*) FROM n WHERE node NOT IN (SELECT node FROM x)) AS phantom, (SELECT count(*) FROM n WHERE node NOT IN (SELECT node FROM x)) + (SELECT count(*) FROM x WHERE node NOT IN (SELECT node FROM n)) AS drift",
    "edition_tree": "WITH p AS (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000) SELECT DISTINCT 'c' || c_custkey AS node, 2 AS depth FROM p UNION SELECT 'n' || n_nationkey, 1 FROM p UNION SELECT 'r' || n_regionkey, 0 FROM p",
    "edition_replay": f"""WITH {_M}, x AS (SELECT e, lag(e) OVER (ORDER BY e) AS b FROM (SELECT DISTINCT edition_number AS e FROM marker_bodies WHERE edition_number IS NOT NULL)), k AS (SELECT DISTINCT edition_number AS n, work_id || '/' || level || '/' || key_path AS c FROM m WHERE work_id IS NOT NULL AND level IS NOT NULL AND key_path IS NOT NULL),
      o AS (SELECT x.e, c FROM k JOIN x ON n = x.b), w AS (SELECT x.e, c FROM k JOIN x ON n = x.e AND x.b IS NOT NULL) SELECT coalesce(o.e, w.e) AS edition_number, count(*) FILTER (o.c IS NULL) AS added, count(*) FILTER (w.c IS NULL) AS removed, 0::bigint AS drift FROM o FULL JOIN w ON o.e = w.e AND o.c = w.c GROUP BY 1""",
    "whole_acts": "SELECT l_orderkey AS act, CASE WHEN count(*) = 1 THEN 1 ELSE 0 END::bigint AS missing, CASE WHEN count(*) = 1 THEN 'incomplete' ELSE 'complete' END AS outcome FROM lineitem GROUP BY 1",
    "visible_components": f"WITH d AS (SELECT user_id, ts::date AS day, bool_or(event_type = 'view') AS i, bool_or(event_type = 'click') AS x FROM events WHERE event_type IN ('view', 'click') AND ts::date <= DATE '{G.AT}' GROUP BY 1, 2), p AS (SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM d) WHERE r = 1 AND i AND NOT x) SELECT count(*) FILTER (c_custkey IN (SELECT user_id FROM p)) AS visible, count(*) FILTER (c_custkey NOT IN (SELECT user_id FROM p)) AS hidden FROM customer",
    "merged_gaps": "SELECT coalesce(generated_draft, false) AS hides, sum(len(coalesce(non_claims, [])) + CASE WHEN coalesce(generated_draft, false) THEN 0 ELSE len(list_distinct(list_filter(list_transform(coalesce(source_anchors, []), lambda a: a.kind), lambda k: NOT list_contains(coalesce(non_claims, []), k)))) END)::bigint AS n FROM valid_items WHERE id IS NOT NULL GROUP BY 1",
    "path_expressions": f"""WITH e AS (SELECT DISTINCT edition_number AS n, coalesce(revision_date, 'initial') AS r FROM edition_summaries WHERE edition_number IS NOT NULL),
      p AS (SELECT 'acts/law_2013-04-05_44-fz/edition-' || lpad(n::varchar, 4, '0') || CASE WHEN n % 5 = 4 THEN '_' ELSE '_rev-' END || r || '_from-x_1f.xml' AS path, CASE WHEN n % 5 <> 4 AND regexp_full_match(r, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(r AS DATE) ELSE DATE '2013-04-05' END AS day, true AS known FROM e UNION ALL VALUES ('x/N-435-FZ/act.xml', NULL, false), ('law_2013-04-06_44-fz', NULL, false), ('law_2013-04-05_44-fz/seed', DATE '2013-04-05', true), ('nothing', NULL, false))
      SELECT path, CASE WHEN contains(lower(path), 'n-435-fz') THEN 'expr:ru:federal:zakon:2012-01-02:435-fz:' || {_ORD.format('2014-05-06')} WHEN contains(path, '0003_rev') THEN 'expr:ru:federal:zakon:2013-04-05:44-fz:' || {_ORD.format('2015-01-01')} WHEN known AND day IS NOT NULL THEN 'expr:ru:federal:zakon:2013-04-05:44-fz:' || date_diff('day', DATE '1800-01-01', day) ELSE '' END AS expression,
      (contains(lower(path), 'n-435-fz') OR contains(path, '0003_rev'))::int AS n_bindings, CASE WHEN contains(lower(path), 'n-435-fz') THEN {_ORD.format('2014-05-06')} WHEN contains(path, '0003_rev') THEN {_ORD.format('2015-01-01')} ELSE -1 END::int AS day FROM p""",
    "ladder_units": f"WITH {_LINE} SELECT {_STYLE} AS token, {_PREFIX.format(s='статья', n=6)} AS article, {_PREFIX.format(s='приложение', n=10)} AS annex, count(*) AS n FROM l GROUP BY 1, 2, 3",
    "near_misses": f"{_MISS} SELECT row_number() OVER (ORDER BY n DESC, token, kind, grp)::int AS rank, kind, grp AS \"group\", token, n, coalesce(max_depth, -1)::int AS max_depth FROM c",
    "near_misses_unpatched": f"{_MISS} SELECT kind, grp AS \"group\", token, n FROM c WHERE grp <> 'federal_law'",
    "unit_report": f"WITH {_MARKED}, k AS (SELECT grp, doc_id, number, count(*) AS k FROM u WHERE token = 'statya' GROUP BY 1, 2, 3), b AS (SELECT grp, sum(k)::bigint AS n_units, count(*) FILTER (k = 1) AS n_resolved, count(*) FILTER (k > 1) AS n_conflicts FROM k GROUP BY 1) SELECT grp AS \"group\", count(DISTINCT doc_id) AS n_documents, coalesce(any_value(n_units), 0) AS n_units, coalesce(any_value(n_resolved), 0) AS n_resolved, coalesce(any_value(n_conflicts), 0) AS n_conflicts FROM l LEFT JOIN b USING (grp) GROUP BY grp",
    "catalog_coverage": f"SELECT count(*) FILTER (coalesce({G._tid('to_id')} IN (SELECT {G._tid('id')} FROM valid_items WHERE {G._tid('id')} IS NOT NULL), false)) AS resolved, count(*) AS total FROM valid_edges",
    "classifier_recall": f"""WITH s AS ({G._scored()}), g AS (SELECT {G._first('context_sample', 0)} = 'amends' AS hit FROM observations JOIN s USING (obs_id) WHERE s.kind = 'amends' AND length(context_sample) > 0),
      t AS (SELECT {G._first('title', 0)} = 'amends' AS hit FROM (SELECT title FROM article_texts WHERE title IS NOT NULL AND NOT regexp_matches(title, 'внесении изменений|внесении изменения|внести изменения|внести изменение') ORDER BY article_id LIMIT 300)),
      m AS (SELECT (SELECT count(*) FILTER (hit) FROM g) AS hits, (SELECT count(*) FILTER (NOT hit) FROM g) AS misses, (SELECT count(*) FILTER (hit) FROM t) AS false_positives) SELECT *, round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 1 END, 9)::double AS recall, round(CASE WHEN hits + false_positives > 0 THEN hits / (hits + false_positives) ELSE 1 END, 9)::double AS precision FROM m""",
    "chain_digests": f"""WITH t AS (SELECT {_REFS.format(a=_PART, x="coalesce(a.path, '')")} AS p, {_REFS.format(a="coalesce(id, '')", x="coalesce(a.path, '')")} AS c, {_REFS.format(a="coalesce(from_id, '') || '|' || coalesce(to_id, '')", x="coalesce(a.path, '') || ':' || coalesce(a.kind, '')")} AS q FROM valid_edges)
      SELECT DISTINCT {_fnv('p')} AS proposal, {_fnv('c')} AS chain, {_fnv('q')} AS pair FROM t""",
    "claim_failures": f"""WITH {G._ITEMS}, {G._EDGES}, i AS (SELECT item_id, proof_level, CASE WHEN risk_level = 'low' THEN 'validated' ELSE status END AS status FROM items), l AS (SELECT * FROM edges WHERE edge_type IN ('validated_by', 'checked_by', 'refines') AND status IN ('active', 'bounded-evidence', 'validated')),
      f AS (SELECT 'status' AS field, 'unsafe-promotion' AS failure FROM i WHERE status = 'validated' AND coalesce(proof_level NOT IN ('unit-test', 'integration-test'), true) UNION ALL SELECT 'from', 'proof-from-backlog' FROM l WHERE from_id IN (SELECT item_id FROM i WHERE status IN ('superseded', 'rejected')) UNION ALL SELECT 'to', 'proof-from-backlog' FROM l WHERE to_id IN (SELECT item_id FROM i WHERE status IN ('superseded', 'rejected'))) SELECT field, failure, count(*) AS n FROM f GROUP BY 1, 2""",
    "gate_gaps": f"WITH {G._ITEMS}, a AS (SELECT * FROM items WHERE status = 'active') SELECT field, count(*) AS n FROM (SELECT 'owner' AS field FROM a WHERE coalesce(trim(owner, ' '), '') = '' UNION ALL SELECT 'verification' FROM a WHERE coalesce(trim(layer, ' '), '') = '' UNION ALL SELECT 'source_anchors' FROM a WHERE len(coalesce(source_anchors, [])) = 0) GROUP BY 1",
    "track_split": f"WITH {G._ITEMS}, {G._EDGES}, t AS (SELECT DISTINCT edge_type AS track, from_id AS item_id FROM edges WHERE edge_type IS NOT NULL AND from_id IS NOT NULL) SELECT track, count(*) AS n, coalesce(array_to_string(list_sort(list(DISTINCT status) FILTER (status IS NOT NULL)), ','), '') AS statuses, coalesce(array_to_string(list_sort(list(DISTINCT risk_level) FILTER (risk_level IS NOT NULL)), ','), '') AS risk_levels FROM t JOIN items USING (item_id) GROUP BY 1",
    "closure_buckets": f"WITH {G._ITEMS} SELECT coalesce(status, '') AS status, CASE WHEN status IN ('active', 'proposed') THEN 'open' WHEN status IN ('superseded', 'rejected') THEN 'closed' ELSE '' END AS bucket, count(*) AS n FROM items GROUP BY 1, 2",
    "accepted_facts": "SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS is_fact, count(*) AS n FROM orders GROUP BY 1",
}
