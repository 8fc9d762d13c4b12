"""Queries of the general training-data problems 2, 3, 5 and 6 over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tidy, tidy_id
from ..operators.hierarchy import closure, cycle_nodes, hierarchy
from ..operators.nested import TABLES, flatten
from ..operators.references import orphans, orphans_as_of
from ..operators.snapshots import changes
from ..session import table


def refines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "valid_edges").filter(F.lower(tidy("edge_type")) == "refines")
    return e.select(tidy_id("from_id").alias("child"), tidy_id("to_id").alias("parent")).na.drop()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cycle_nodes(refines(spark, d)).select(F.col("node").alias("item_id"))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every item with its path, depth, root and the size of its subtree; items on cycles have '' and -1 there."""
    h = hierarchy(refines(spark, d), sizes=True)
    text = [F.coalesce(c, F.lit("")).alias(n) for c, n in ((F.col("parent"), "parent_id"), (F.col("root"), "root"), (F.array_join("path", "/"), "path"))]
    return h.select(F.col("node").alias("item_id"), *text, F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("n_descendants", F.lit(-1)).cast("bigint").alias("n_descendants"), "on_cycle")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return closure(refines(spark, d)).select(F.col("node").alias("item_id"), F.col("descendant").alias("descendant_id"), "distance")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten(table(spark, d, "review_packets"), "record_id", "payload", "non_claims", ["finding_pos", "claim_pos", "finding_id", "status"])


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A flat table; of an event's payload its members, not its text, which ``flatten`` gives as written."""
    columns = [c for c in TABLES[name] if c != "payload"]
    return lambda spark, d: flatten(table(spark, d, "review_packets"), "record_id", "payload", name, columns)


def _article_changes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_texts").withColumn("number", tidy("number"))
    return changes(a, "edition_number", ["work_id", "number"], "text", "loaded_at", "article_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _article_changes(spark, d)


def p5_editions(spark: SparkSession, d: str) -> DataFrame:
    """Changes by edition with its revision date (the first of its spellings in ISO order, '' if there is none)."""
    counts = _article_changes(spark, d).groupBy("edition_number", "change_kind").agg(F.count("*").alias("n"))
    dates = table(spark, d, "edition_summaries").groupBy("edition_number").agg(F.coalesce(F.min(tidy("revision_date")), F.lit("")).alias("revision_date"))
    return counts.join(F.broadcast(dates), "edition_number", "left").withColumn("revision_date", F.coalesce("revision_date", F.lit("")))  # one row an edition


def _ends(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of every edge, from one scan."""
    e = table(spark, d, "valid_edges").select(F.col("id").alias("edge_id"), "from_id", "to_id", "recorded_at")
    both = e.select("edge_id", "recorded_at", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), tidy_id(f"{s}_id").alias("ref")) for s in ("from", "to")])).alias("x"))
    return both.select("edge_id", "x.side", "x.ref", "recorded_at").filter("ref is not null and edge_id is not null")


def _orphan_ends(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "valid_items").select(tidy_id("id").alias("item_id"), F.col("recorded_at").alias("r"), F.col("removed_at").alias("x"))
    return orphans_as_of(_ends(spark, d), ["ref"], "recorded_at", ["edge_id", "side", "ref", "recorded_at"], items, ["item_id"], "r", "x")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphan_ends(spark, d).select("edge_id", "side", "kind").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan ends by table, end, month of recorded_at ('' if unknown) and kind."""
    o = _orphan_ends(spark, d).distinct().select(F.lit("valid_edges").alias("tbl"), "side", F.coalesce(F.date_format("recorded_at", "yyyy-MM"), F.lit("")).alias("month"), "kind")
    return o.groupBy("tbl", "side", "month", "kind").agg(F.count("*").alias("n"))


def p6_composite(spark: SparkSession, d: str) -> DataFrame:
    """Markers whose work and number, as far as they are not null, occur together in no article text (partial match)."""
    m = table(spark, d, "marker_bodies").select("marker_id", "work_id", tidy("number").alias("number"))
    a = table(spark, d, "article_texts").select("work_id", tidy("number").alias("number"))
    return orphans(m, ["work_id", "number"], a, ["work_id", "number"], "partial").select("marker_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_nodes": p2_nodes,
    "p2_descendants": p2_descendants,
    "p3_found": p3_found,
    **{f"p3_{name}": _flat(name) for name in TABLES},
    "p5_found": p5_found,
    "p5_editions": p5_editions,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_composite": p6_composite,
}

#: White space that may stand around an id or a number, for DuckDB's trim.
_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(8195)||chr(8201)||chr(8239)||chr(12288)"
_EDGE = f"""SELECT DISTINCT upper(trim(from_id, {_WS})) AS c, upper(trim(to_id, {_WS})) AS p FROM valid_edges
  WHERE lower(trim(edge_type, {_WS})) = 'refines' AND trim(from_id, {_WS}) <> '' AND trim(to_id, {_WS}) <> ''"""
#: Least distances downwards; a pair keeps its first and so its least distance.
_BELOW = f"""WITH RECURSIVE e AS ({_EDGE}), below AS (SELECT p AS a, c AS x, 1 AS k FROM e UNION SELECT r.a, e.c, r.k + 1 FROM below r JOIN e ON e.p = r.x
    LEFT JOIN recurring.below o ON o.a = r.a AND o.x = e.c WHERE o.k IS NULL OR o.k > r.k + 1),
  cyc AS (SELECT a AS n FROM below WHERE a = x), pairs AS (SELECT a, x, k FROM below WHERE a NOT IN (SELECT n FROM cyc))"""
_BELOW = _BELOW.replace("below AS (", "below(a, x, k) USING KEY (a, x) AS (", 1)
#: Least depths from the topmost ordinary items, then the parent of least depth and id.
_PATHS = """nodes AS (SELECT c AS n FROM e UNION SELECT p FROM e), plain AS (SELECT * FROM e WHERE c NOT IN (SELECT n FROM cyc) AND p NOT IN (SELECT n FROM cyc)),
  tops AS (SELECT n FROM nodes WHERE n NOT IN (SELECT n FROM cyc) AND n NOT IN (SELECT c FROM plain)),
  walks AS (SELECT n, 0 AS k FROM tops UNION SELECT c, k + 1 FROM walks JOIN plain ON p = n), depths AS (SELECT n, min(k) AS k FROM walks GROUP BY n),
  ups AS (SELECT c, min(p) AS p FROM plain JOIN depths a ON a.n = c JOIN depths b ON b.n = p WHERE b.k = a.k - 1 GROUP BY c),
  path AS (SELECT n, '' AS parent_id, n AS root, n AS path, 0 AS depth FROM tops UNION ALL SELECT u.c, u.p, r.root, r.path || '/' || u.c, r.depth + 1 FROM path r JOIN ups u ON u.p = r.n)"""
_SNAP = f"""WITH latest AS (SELECT * FROM (SELECT edition_number AS e, work_id AS w, trim(number, {_WS}) AS n, text,
    row_number() OVER (PARTITION BY edition_number, work_id, trim(number, {_WS}) ORDER BY loaded_at DESC NULLS LAST, article_id DESC) AS rn
    FROM article_texts WHERE number IS NOT NULL AND work_id IS NOT NULL AND edition_number IS NOT NULL) WHERE rn = 1),
  eds AS (SELECT e, lag(e) OVER (ORDER BY e) AS before FROM (SELECT DISTINCT edition_number AS e FROM article_texts WHERE edition_number IS NOT NULL)),
  new AS (SELECT l.*, x.before FROM latest l JOIN eds x USING (e) WHERE x.before IS NOT NULL),
  old AS (SELECT x.e AS at, l.w, l.n, l.text FROM latest l JOIN eds x ON l.e = x.before),
  found AS (SELECT coalesce(new.e, old.at) AS edition_number, coalesce(new.w, old.w) AS work_id, coalesce(new.n, old.n) AS number,
    CASE WHEN old.w IS NULL THEN 'added' WHEN new.w IS NULL THEN 'removed' WHEN new.text IS DISTINCT FROM old.text THEN 'changed' END AS change_kind
    FROM new FULL JOIN old ON new.e = old.at AND new.w = old.w AND new.n = old.n)"""
_ENDS = f"""WITH items AS (SELECT upper(trim(id, {_WS})) AS i, recorded_at AS r, removed_at AS x FROM valid_items),
  ends AS (SELECT DISTINCT id AS edge_id, side, upper(trim(ref, {_WS})) AS ref, recorded_at AS t FROM
    (SELECT id, 'from' AS side, from_id AS ref, recorded_at FROM valid_edges UNION ALL SELECT id, 'to', to_id, recorded_at FROM valid_edges)
    WHERE trim(ref, {_WS}) <> '' AND id IS NOT NULL),
  judged AS (SELECT e.edge_id, e.side, e.ref, e.t, count(i.i) AS n, count(*) FILTER (i.r <= e.t) AS known, count(*) FILTER (i.r <= e.t AND (i.x IS NULL OR i.x > e.t)) AS live
    FROM ends e LEFT JOIN items i ON e.ref = i.i GROUP BY ALL),
  found AS (SELECT edge_id, side, t, CASE WHEN n = 0 THEN 'missing' WHEN known > 0 THEN 'deleted' ELSE 'late' END AS kind FROM judged WHERE live = 0)"""

#: Packets by the engine's JSON functions: the text without marks before it, out of strings that hold it.
_LEAD = "chr(65279)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
_OUT = "SELECT record_id, ltrim(CASE WHEN starts_with(t, '\"') THEN CASE WHEN json_valid(t) THEN json_extract_string(t, '$') END ELSE t END, {lead}) AS t FROM {source}"
_ITEMS_OF = "CASE WHEN json_type({v}) = 'ARRAY' THEN json_extract({v}, '$[*]') WHEN coalesce(json_type({v}), 'NULL') = 'NULL' THEN []::json[] ELSE [{v}] END"


_SPANS, _TARGETS, _EVENTS, _EDGES_OF = (f"json_extract({v}, '$.{n}')" for v, n in (("f", "source_spans"), ("f", "candidate_targets"), ("p", "events"), ("p", "edges")))


def _each(name: str, source: str, keep: str, value: str, pos: str) -> str:
    """CTE of the items, other than null, of a list in each row of a source."""
    return f"{name} AS (SELECT {keep}, generate_subscripts(a, 1) - 1 AS {pos}, unnest(a) AS {name}_v FROM (SELECT {keep}, {_ITEMS_OF.format(v=value)} AS a FROM {source}))"


_PACKET = f"""WITH t0 AS (SELECT record_id, ltrim(payload, {_LEAD}) AS t FROM review_packets WHERE payload IS NOT NULL AND record_id IS NOT NULL), t1 AS ({_OUT.format(lead=_LEAD, source='t0')}), t2 AS ({_OUT.format(lead=_LEAD, source='t1')}),
  o AS (SELECT record_id, t::json AS t FROM t2 WHERE CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END),
  p AS (SELECT record_id, CASE WHEN json_type(t, '$.packet') = 'OBJECT' THEN json_extract(t, '$.packet') WHEN json_type(t, '$.envelope.packet') = 'OBJECT' THEN json_extract(t, '$.envelope.packet') ELSE t END AS p FROM o),
  q AS (SELECT record_id, p, coalesce(CASE WHEN json_type(p, '$.normalization') = 'OBJECT' THEN json_extract_string(p, '$.normalization.status') END, '') AS status FROM p),
  {_each('f0', 'q', 'record_id, status', "json_extract(p, '$.findings')", 'finding_pos')}, f AS (SELECT record_id, status, finding_pos::int AS finding_pos, f0_v AS f, coalesce(json_extract_string(f0_v, '$.finding_id'), '') AS finding_id FROM f0 WHERE json_type(f0_v) <> 'NULL'),
  {_each('c1', 'q', 'record_id, status', "json_extract(p, '$.non_claims')", 'claim_pos')}, {_each('c2', 'f', 'record_id, status, finding_pos, finding_id', "json_extract(f, '$.non_claims')", 'claim_pos')},
  c AS (SELECT record_id, -1 AS finding_pos, claim_pos::int AS claim_pos, '' AS finding_id, status, json_extract_string(c1_v, '$') AS claim FROM c1 WHERE json_type(c1_v) <> 'NULL' UNION ALL SELECT record_id, finding_pos, claim_pos::int, finding_id, status, json_extract_string(c2_v, '$') FROM c2 WHERE json_type(c2_v) <> 'NULL')"""


def _members(v: str, **names: str) -> str:
    return ", ".join(f"json_extract_string({v}, '$.{path}') AS {out}" for out, path in names.items())


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


ORACLES: dict[str, str] = {
    "p3_found": f"{_PACKET} SELECT record_id, finding_pos, claim_pos, finding_id, status FROM c",
    "p3_non_claims": f"{_PACKET} SELECT * FROM c",
    "p3_packets": f"{_PACKET} SELECT record_id, {_members('p', packet_id='packet_id', schema_version='schema_version', source_path='source.path', source_kind='source.source_kind', content_sha256='source.content_sha256', reviewed_git_revision='source.reviewed_git_revision', received_at='source.received_at', method='normalization.method', extractor_version='normalization.extractor_version')}, status, (SELECT count(*) FROM f WHERE f.record_id = q.record_id)::int AS n_findings FROM q",
    "p3_findings": f"{_PACKET} SELECT record_id, finding_pos, finding_id, status, {_members('f', **_same('kind', 'concern_class', 'reviewer_severity', 'summary', 'required_proof_class', 'normalization_status', 'disposition_status', 'execution_status', 'verification_status'))} FROM f",
    "p3_spans": f"{_PACKET}, {_each('s', 'f', 'record_id, status, finding_pos, finding_id', _SPANS, 'span_pos')} SELECT record_id, finding_pos, span_pos::int AS span_pos, finding_id, status, {_members('s_v', **_same('path', 'line_start', 'line_end', 'quote_sha256', 'heading'))} FROM s WHERE json_type(s_v) <> 'NULL'",
    "p3_targets": f"{_PACKET}, {_each('s', 'f', 'record_id, status, finding_pos, finding_id', _TARGETS, 'target_pos')} SELECT record_id, finding_pos, target_pos::int AS target_pos, finding_id, status, {_members('s_v', surface='surface', target_id='id', note='note')} FROM s WHERE json_type(s_v) <> 'NULL'",
    "p3_events": f"{_PACKET}, {_each('s', 'q', 'record_id, status', _EVENTS, 'event_pos')} SELECT record_id, event_pos::int AS event_pos, status, {_members('s_v', **_same('event_id', 'event_type', 'at', 'actor_class'))}, CASE WHEN json_type(s_v, '$.payload') = 'OBJECT' THEN json_extract_string(s_v, '$.payload.disposition') END AS disposition FROM s WHERE json_type(s_v) <> 'NULL'",
    "p3_event_items": f"{_PACKET}, {_each('s', 'q', 'record_id', _EVENTS, 'event_pos')}, e AS (SELECT record_id, event_pos, unnest(['evidence_anchors', 'non_claims']) AS list, unnest([json_extract(s_v, '$.payload.evidence_anchors'), json_extract(s_v, '$.payload.non_claims')]) AS v FROM s WHERE json_type(s_v, '$.payload') = 'OBJECT'), {_each('i', 'e', 'record_id, event_pos, list', 'v', 'item_pos')} SELECT record_id, event_pos::int AS event_pos, list, item_pos::int AS item_pos, json_extract_string(i_v, '$') AS item FROM i WHERE json_type(i_v) <> 'NULL'",
    "p3_edges": f"{_PACKET}, {_each('s', 'q', 'record_id, status', _EDGES_OF, 'edge_pos')} SELECT record_id, edge_pos::int AS edge_pos, status, {_members('s_v', edge_type='type', from_ref='from', to_ref='to', edge_status='status')} FROM s WHERE json_type(s_v) <> 'NULL'",
    "p2_found": f"WITH RECURSIVE e AS ({_EDGE}), reach AS (SELECT c, p FROM e UNION SELECT r.c, e.p FROM reach r JOIN e ON e.c = r.p) SELECT c AS item_id FROM reach WHERE c = p",
    "p2_nodes": f"""{_BELOW}, {_PATHS} SELECT n AS item_id, parent_id, root, path, depth, (SELECT count(*) FROM pairs WHERE a = n) AS n_descendants, false AS on_cycle FROM path UNION ALL SELECT n, '', '', '', -1, -1, true FROM cyc""",
    "p2_descendants": f"{_BELOW} SELECT a AS item_id, x AS descendant_id, k AS distance FROM pairs",
    "p5_found": f"{_SNAP} SELECT * FROM found WHERE change_kind IS NOT NULL",
    "p5_editions": f"""{_SNAP} SELECT edition_number, change_kind, count(*) AS n, coalesce(any_value(d), '') AS revision_date FROM found
      LEFT JOIN (SELECT edition_number, min(trim(revision_date, {_WS})) AS d FROM edition_summaries GROUP BY 1) USING (edition_number)
      WHERE change_kind IS NOT NULL GROUP BY edition_number, change_kind""",
    "p6_found": f"{_ENDS} SELECT DISTINCT edge_id, side, kind FROM found",
    "p6_composite": f"""WITH m AS (SELECT marker_id, work_id AS w, trim(number, {_WS}) AS n FROM marker_bodies), a AS (SELECT DISTINCT work_id AS w, trim(number, {_WS}) AS n FROM article_texts)
      SELECT marker_id FROM m WHERE (w IS NOT NULL OR n IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM a WHERE (m.w IS NULL OR a.w = m.w) AND (m.n IS NULL OR a.n = m.n))""",
    "p6_report": f"{_ENDS} SELECT 'valid_edges' AS tbl, side, coalesce(strftime(t, '%Y-%m'), '') AS month, kind, count(*) AS n FROM found GROUP BY ALL",
}
