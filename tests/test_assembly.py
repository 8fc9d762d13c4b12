"""Bindings, texts, replay, ladders, paths, digests and measures on small fixtures with nulls, ties and empty tables."""

from pyspark.sql import functions as F

from lexstrata.functions import hashing
from lexstrata.operators import assembly as A
from lexstrata.operators import ladders as D
from lexstrata.operators import links as K
from lexstrata.operators import membership as M
from lexstrata.operators import registry as R
from lexstrata.operators import temporal as T

MARKERS = "i int, work_id string, level string, key_path string, title string, body string, component string"


def test_first_binding_wins_and_null_works_are_equal(spark):
    m = spark.createDataFrame([(1, "w", "statya", "1", "T", " b ", "x"), (2, None, "statya", "1", "T2", " ", "x"), (3, "w", None, "1", None, None, "x"), (4, "w", "statya", "2", None, "", "x")], MARKERS).drop("component")
    b = spark.createDataFrame([("w", "statya", "1", "c2", 2), ("w", "statya", "1", "c1", 1), (None, "statya", "1", "c3", 3), ("w", "statya", "2", "c4", 4)], "work_id string, level string, key_path string, component string, ord int")
    bound = A.bind_markers(m, b, "ord")
    assert {r["i"]: (r["component"], r["outcome"]) for r in bound.collect()} == {1: ("c1", "bound"), 2: ("c3", "bound"), 3: (None, "unknown"), 4: ("c4", "bound")}
    assert {tuple(r) for r in A.text_log(bound, "body", "title", F.lit(5)).collect()} == {("c1", "b", 5), ("c3", "T2", 5)}
    assert {tuple(r)[:2] for r in A.text_log(bound, "body", "title", F.lit(5), bodies=False).collect()} == {("c1", "T"), ("c3", "T2")}
    assert A.bind_markers(m.limit(0), b, "ord").count() == 0 and {r["outcome"] for r in A.bind_markers(m, b.limit(0), "ord").collect()} == {"unknown"}


def test_replay_gives_the_target(spark):
    old = spark.createDataFrame([(1, "a", "p"), (1, "b", "p"), (1, "b", "p"), (2, "a", "p")], "e int, child string, parent string")
    new = spark.createDataFrame([(1, "a", "p"), (1, "c", "q"), (3, "z", "p")], "e int, child string, parent string")
    assert {tuple(r) for r in A.edition_replay(old, new, "e").collect()} == {(1, 1, 1, 0), (2, 0, 1, 0), (3, 1, 0, 0)}
    assert A.edition_replay(old.limit(0), new.limit(0), "e").count() == 0


def test_completeness_gaps_and_kinds(spark):
    need = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "q"), ("y", "q")], "act string, node string")
    edges = spark.createDataFrame([("x", "a", "b"), ("y", "a", "b")], "act string, child string, parent string")
    assert {tuple(r) for r in A.complete(need, edges, "act").collect()} == {("x", 0, "complete"), ("y", 1, "incomplete")}
    rows = spark.createDataFrame([(1, ["a", "a"], ["a", "b"], False), (2, ["a"], ["b"], True), (3, None, ["b"], None), (4, None, None, True)], "i int, k array<string>, r array<string>, h boolean")
    assert {r["i"]: r["g"] for r in rows.select("i", A.merge_gaps(F.col("k"), F.col("r"), F.col("h")).alias("g")).collect()} == {1: ["a", "a", "b"], 2: ["a"], 3: ["b"], 4: []}
    kinds = spark.createDataFrame([("Work",), ("NormativeBlob",), ("x",), (None,)], "k string")
    assert {r["k"]: r["e"] for r in kinds.select("k", A.node_kind_error(F.col("k")).alias("e")).collect()} == {"Work": "", "NormativeBlob": "forbidden kind", "x": "unknown kind", None: "unknown kind"}


def test_ladders_and_proposals(spark):
    texts = ["1.2. x", "1) x", "а) x", "Приложение", "Приложения к", "ПРИЛОЖЕНИЕ 1", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ladder = [{"token": "annex", "surface": "Приложение"}, {"token": "punkt", "suffix": ".", "compound": True}, {"token": "sub", "suffix": ")", "number_style": "letter_cyrillic"}, {"token": "plain", "suffix": ")"}]
    got = {r["t"]: (r["s"], r["p"]) for r in df.select("t", D.style_match(F.col("t"), ladder).alias("s"), D.surface_prefix(F.col("t"), "приложение").alias("p")).collect()}
    assert got == {"1.2. x": ("punkt", False), "1) x": ("plain", False), "а) x": ("sub", False), "Приложение": (None, True), "Приложения к": (None, False), "ПРИЛОЖЕНИЕ 1": (None, True), None: (None, False), "": (None, False)}
    rows = spark.createDataFrame([("g", "Statya", 3), ("g", "statya", 2), ("g", "glava", 1), ("h", "x", 9), (None, "x", 9)], "group string, token string, depth int")
    census = D.near_miss_census(D.near_misses(rows, {"g": 1}, {"g": ["statya"]}))
    assert {(r["kind"], r["group"], r["token"], r["n"], r["max_depth"]) for r in census.collect()} == {(D.DEPTH, "g", "statya", 2, 3), (D.TOKEN, "g", "glava", 1, None)}
    read = D.ranked_near_misses(census).select("fingerprint", D.parse_proposal(D.proposal_line()).alias("p")).collect()
    assert [r["p"]["error"] for r in read] == ["", ""] and all(r["p"]["fingerprint"] == r["fingerprint"] for r in read)
    bad = spark.createDataFrame([("- {kind: DepthOverflow, group: g, token: t, count: 1}",), ("x",)], "l string").select(D.parse_proposal(F.col("l")).alias("p")).collect()
    assert [r["p"]["error"] for r in bad] == ["malformed"] * 2
    assert D.near_miss_census(D.near_misses(rows, {"g": 1}, {"g": ["statya"]}), census).count() == 0


def test_hubs_are_bounded_and_claims_come_first(spark):
    hub = [("hub", f"d{i}") for i in range(300)] + [(f"s{i}", "hub") for i in range(50)] + [(f"d{i}", None) for i in range(300)] + [("ok", "d1"), ("loose", "gone"), ("loop", "loop")]
    edges = spark.createDataFrame(hub, "node string, dep string")
    seeds = spark.createDataFrame([("s1", False, "v"), ("ok", False, "v"), ("loose", False, "v"), ("nobody", False, "v"), ("d1", True, "v"), ("d2", False, "w"), ("loop", False, "v")], "seed string, claim boolean, rule_version string")
    got = {r["seed"]: r["outcome"] for r in M.bounded_closure(edges, seeds, 8, "v").collect()}
    assert got == {"s1": "unbounded", "ok": "complete", "loose": "incomplete", "nobody": "unknown", "d1": "incomplete", "d2": "incompatible", "loop": "complete"}


def test_admission_against_a_plain_walk(spark):
    import random

    rng = random.Random(4)
    rows = [("d", i, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for i in range(60)]
    up, want = {}, {}
    for _, o, c, p in rows:
        top, way = p, [p]
        while top in up and top != c:
            top = up[top]
            way.append(top)
        want[o] = "self_parent" if c == p else "duplicate" if up.get(c) == p else "second_parent" if c in up else "cycle" if c in way else "admitted"
        if want[o] == "admitted":
            up[c] = p
    got = {r["ord"]: r["outcome"] for r in M.admit(spark.createDataFrame(rows, "doc string, ord int, child string, parent string"), "doc").collect()}
    assert got == want


def test_as_of_join_of_hot_days_and_null_keys(spark):
    req = spark.createDataFrame([(1, "k", 5)] * 3 + [(2, "k", 1), (3, None, 5), (4, "z", 5), (5, "k", None)], "v int, key string, at int")
    ev = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 5, "c"), ("k", 6, "d"), (None, 1, "n"), ("k", 4, None)], "key string, day int, value string")
    got = sorted((r["v"], r["value"] or "") for r in T.as_of_join(req, ev, "key", "at", "day", "value").collect())
    assert got == [(1, "c")] * 3 + [(2, ""), (3, ""), (4, ""), (5, "")]
    assert T.as_of_join(req, ev.limit(0), "key", "at", "day", "value").count() == 7


def test_digests_measures_and_registry(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    refs = F.array(F.lit("e1"), F.lit("e2"))
    assert value(hashing.fnv_digest(F.lit("a"), F.lit("b"), more=refs)) == value(hashing.fnv1a64(F.lit("a|b|e1|e2"))) and value(hashing.fnv_digest(F.lit("a"))) == value(hashing.fnv1a64(F.lit("a")))
    pair = F.array(F.struct(F.lit("c").alias("id"), F.lit("f").alias("family")))
    assert value(hashing.pair_digest(F.lit("l"), F.lit("r"), pair)) == value(hashing.fnv1a64(F.lit("l|r|c:f")))
    none = spark.createDataFrame([], "hit boolean")
    assert tuple(K.measured(none, none, "hit").first()) == (0, 0, 0, 1.0, 1.0)
    items = spark.createDataFrame([("a", "validated", None, "proof_gate", " ", "v", []), ("b", "rejected", "unit-test", "x", "o", None, None), ("c", "active", "none", "proof_gate", None, "v", ["s"])], "item_id string, status string, proof_level string, item_type string, owner string, verification string, source_anchors array<string>")
    edges = spark.createDataFrame([("e", "b", "a", "proves", "active"), ("f", "b", "b", "other", "active"), ("g", None, "b", "proves", "active")], "edge_id string, from_id string, to_id string, edge_type string, status string")
    assert {tuple(r) for r in R.claim_lifecycle(items, edges, ["unit-test"], ["proves"], ["rejected"]).collect()} == {("a", "status", "unsafe-promotion"), ("e", "from", "proof-from-backlog"), ("g", "to", "proof-from-backlog")}
    assert {tuple(r) for r in R.gate_metadata(items).collect()} == {("c", "owner")}
    assert R.gate_metadata(items.limit(0)).count() == 0
    assert value(R.retryable(F.lit("timeout"))) and not value(R.retryable(F.lit(None).cast("string")))


def test_path_expressions_are_grounded_by_date(spark):
    works = [{"path_needle": "act-n-1", "authority": "federal", "act_number": "1-fz", "enactment_date": "2001-02-03", "edition_date": "2002-01-01"}]
    paths = ["X/act-N-1/a", "law_2001-02-03_1-fz/edition-1_rev-2003-01-01_x", "law_2001-02-03_1-fz", "law_2001-02-04_1-fz", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r["p"]: r["x"] for r in df.select("p", A.path_expression(F.col("p"), works).alias("x")).collect()}
    day = lambda x: spark.sql(f"select datediff(date'{x}', date'1800-01-01')").first()[0]
    stem = "expr:ru:federal:zakon:2001-02-03:1-fz:"
    assert got == {"X/act-N-1/a": f"{stem}{day('2002-01-01')}", paths[1]: f"{stem}{day('2003-01-01')}", paths[2]: f"{stem}{day('2001-02-03')}", paths[3]: None, "": None, None: None}
