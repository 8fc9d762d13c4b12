import random

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import links as K
from lexstrata.operators import membership as M
from lexstrata.operators import registry as R
from lexstrata.operators import temporal as T
from lexstrata.operators import vectors as X


def membership_brute(log, at):
    up, bad = {}, set()
    seen = sorted(((d, k, c, p) for k, p, c, d in log if d <= at))
    for day in {d for d, *_ in seen}:
        by = {}
        for d, k, c, p in seen:
            if d == day and k == "attach":
                by.setdefault(c, set()).add(p)
        bad |= {c for c, ps in by.items() if len(ps) > 1}
    for _, k, c, p in seen:
        if k == "attach":
            up[c] = p
        elif up.get(c) == p:
            del up[c]
    return {(c, p) for c, p in up.items() if c not in bad}


def test_membership_fold(spark):
    rng = random.Random(3)
    for _ in range(4):
        log = [(rng.choice(["attach", "attach", "detach"]), rng.choice("PQR"), rng.choice("abcdef"), rng.randrange(12)) for _ in range(25)]
        df = spark.createDataFrame(log, "kind string, parent string, child string, day int")
        assert {tuple(r) for r in T.membership(df, 8).collect()} == membership_brute(log, 8)


def test_status_ties_and_misses(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 2, "x"), ("b", 2, "x"), ("c", 9, "x"), (None, 1, "x")], "k string, d int, s string")
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {tuple(r) for r in T.status_as_of(df, "k", "d", "s", 5, want).collect()} == {("a", "unknown", "conflict"), ("b", "x", "resolved"), ("c", "unknown", "unknown")}
    texts = T.text_as_of(df.withColumn("o", F.monotonically_increasing_id()), ["k"], "d", "s", "o", 5).collect()
    assert {(r["k"], r["outcome"], tuple(r["texts"])) for r in texts if r["k"]} == {("a", "conflict", ("y", "z")), ("b", "conflict", ("x", "x"))}


def test_trees(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x"), ("x", "y"), ("z", "x")], "child string, parent string")
    t = T.tree(e)
    assert {(r["node"], r["depth"]) for r in t.collect()} == {("a", 0), ("b", 1), ("c", 2)}  # a pure cycle and what hangs below it vanish
    assert {r["node"] for r in T.prune(t, spark.createDataFrame([("b",)], "node string")).collect()} == {"a", "b"}


def stack_brute(rows):
    out, stack = {}, []
    for ix, node, rank in rows:
        while stack and stack[-1][1] >= rank:
            stack.pop()
        out[node] = stack[-1][0] if stack else None
        stack.append((node, rank))
    return out


def test_propose_equals_a_stack(spark):
    rng = random.Random(1)
    rows = [(i, f"n{i}", rng.randrange(5)) for i in range(80)]
    df = spark.createDataFrame([("d", *r) for r in rows] + [("d", 99, None, 1)], "doc string, ix int, node string, r int")
    got = {r["node"]: r["parent"] for r in M.propose(df, ["doc"], "ix", "node", F.col("r"), 5).collect()}
    assert got == stack_brute(rows)


def test_admission(spark):
    p = [("d", 1, "b", "a"), ("d", 2, "b", "a"), ("d", 3, "b", "c"), ("d", 4, "a", "a"), ("d", 5, "a", "b"), ("d", 6, "c", "b")]
    got = {r["ord"]: r["outcome"] for r in M.admit(spark.createDataFrame(p, "doc string, ord int, child string, parent string"), "doc").collect()}
    assert got == {1: "admitted", 2: "duplicate", 3: "second_parent", 4: "self_parent", 5: "cycle", 6: "admitted"}


def admission_brute(rows):
    up, out = {}, {}
    for o, c, p in sorted(rows):
        if c == p:
            out[o] = "self_parent"
        elif c in up:
            out[o] = "duplicate" if up[c] == p else "second_parent"
        else:
            top = p
            while top in up and top != c:
                top = up[top]
            out[o] = "cycle" if top == c else "admitted"
            if top != c:
                up[c] = p
    return out


def test_admission_after_a_rejected_cycle(spark):
    p = [("d", 1, "b", "a"), ("d", 2, "a", "b"), ("d", 3, "a", "b"), ("d", 4, "a", "c"), ("d", 5, "a", "b"), ("d", 6, "a", "c"), ("d", 7, "c", "b"), ("d", 8, "c", "e")]
    df = spark.createDataFrame(p + [(None, *r[1:]) for r in p], "doc string, ord int, child string, parent string")
    want = {1: "admitted", 2: "cycle", 3: "cycle", 4: "admitted", 5: "second_parent", 6: "duplicate", 7: "cycle", 8: "admitted"}
    assert {(r["doc"], r["ord"]): r["outcome"] for r in M.admit(df, "doc").collect()} == {(d, o): x for d in ("d", None) for o, x in want.items()}


def test_admission_equals_a_replay(spark):
    rng = random.Random(5)
    docs = {d: [(i, rng.choice("abcdefg"), rng.choice("abcdefg")) for i in range(60)] for d in range(6)}
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "doc int, ord int, child string, parent string")
    assert {(r["doc"], r["ord"]): r["outcome"] for r in M.admit(df, "doc").collect()} == {(d, o): x for d, rows in docs.items() for o, x in admission_brute(rows).items()}


def test_bounded_closure(spark):
    edges = [("a", "b"), ("b", "c"), ("c", None), ("x", "gone")] + [(f"k{i}", f"k{i + 1}") for i in range(12)] + [("k12", None)]
    e = spark.createDataFrame(edges, "node string, dep string")
    s = spark.createDataFrame([("a",), ("x",), ("nowhere",), ("k0",), ("k5",)], "seed string")
    assert {tuple(r) for r in M.bounded_closure(e, s).collect()} == {("a", "complete", 3), ("x", "incomplete", None), ("nowhere", "unknown", None), ("k0", "unbounded", None), ("k5", "complete", 8)}


def test_every_edition_is_compared_with_the_next_lower_one(spark):
    rows = [(1, "w", 3, "1", "a"), (2, "w", 3, "2", "b"), (3, "w", 7, "1", "A"), (4, "w", 7, "3", "c"), (5, "w", 9, "1", "A"), (6, "w", None, "1", "z"), (7, "v", 9, "1", "n")]
    a = spark.createDataFrame(rows, "i int, w string, e int, n string, t string")
    before, after = M.edition_pairs(a, "e", a)
    assert {tuple(r) for r in M.marker_diff(before, after, ["e", "w", "n"]).select("e", "i", "change").collect()} == {(7, 2, "removed"), (7, 4, "added"), (9, 4, "removed"), (9, 7, "added")}
    assert {tuple(r) for r in M.text_drafts(before, after, ["e", "w", "n"], "t").collect()} == {(7, "w", "1", "attach"), (7, "w", "2", "detach"), (7, "w", "3", "attach"), (9, "w", "3", "detach"), (9, "v", "1", "attach")}


def test_operations_and_guards(spark):
    e = spark.createDataFrame([("A", "s", "root"), ("A", "k", "s"), ("A", "t", "root"), ("B", "s", "r")], "act string, child string, parent string")
    ops = [("A", 1, "o1", "renumber", ["s"], ["s2"]), ("A", 2, "o1", "renumber", ["s2"], ["s3"]), ("A", 3, "o2", "move", ["k"], ["t"]), ("A", 4, "o3", "split", ["t"], ["t1", "t2"])]
    o = spark.createDataFrame(ops, "act string, ord int, op_id string, kind string, subjects array<string>, targets array<string>")
    assert {tuple(r) for r in M.apply_ops(e, o, "act").collect()} == {("A", "s2", "root"), ("A", "t1", "root"), ("A", "t2", "root"), ("B", "s", "r")}
    errors = o.select(M.industrial_op_error(F.col("kind"), F.col("subjects"), F.col("targets"))).collect()
    assert all(r[0] == "" for r in errors)
    g = spark.createDataFrame([(1, "b", "a"), (2, "b", "a"), (3, "a", "b"), (4, "b", "c")], "i int, child string, parent string")
    assert {r["i"]: r["guard"] for r in M.insert_guards(g, "i").collect()} == {1: "", 2: "duplicate", 3: "reverse", 4: "multiple_parents"}
    with pytest.raises(ValueError):
        M.write_set([(g, "Forbidden", "child")], [], ["Work"], [])


def test_healing_leaves_no_drift(spark):
    log = spark.createDataFrame([("attach", "p", "a", 1), ("detach", "p", "a", 2), ("attach", "p", "b", 1)], "kind string, parent string, child string, day int")
    want = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "child string, parent string")
    healed = M.heal(log, want, T.membership(log, 5), 6)
    assert tuple(M.drift(want, T.membership(healed, 9), "child").first()) == (0, 0, 0, 3)


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [1.0]), (6, None), (7, [])], "id bigint, e array<float>")
    got = [(r["id"], r["score"]) for r in X.top_k(v, "id", "e", [1.0, 0.0], 4).collect()]
    assert got == [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)]
    with pytest.raises(Exception, match="another length"):
        X.top_k(v, "id", "e", [1.0, 0.0], 4, strict=True).collect()
    with pytest.raises(ValueError):
        X.top_k(v, "id", "e", [1.0], 0)
    c = spark.createDataFrame([("a", "r", "s", 0.5)], "k string, record string, span string, score double")
    assert X.tampered(c, c.withColumn("score", F.lit(0.1)), "k").first()["tampered"] is False and X.tampered(c, c.withColumn("span", F.lit("t")), "k").first()["tampered"] is True


@pytest.mark.parametrize("block", [3, 256])
def test_batch_search_equals_single_searches(spark, block):
    rng = random.Random(block)
    rows = [(i, [float(rng.randrange(-2, 4)) for _ in range(3)]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, [1.0]), (42, None), (43, []), (44, [1.0, None, 2.0])]
    v = spark.createDataFrame(rows, "id bigint, e array<float>")
    asked = [0, 7, 14, 40, 41, 42, 43, 44]
    got = {}
    for r in X.top_k_batch(v, "id", "e", v.filter(F.col("id").isin(asked)), 4, block).collect():
        got.setdefault(r["query"], set()).add((r["id"], r["score"]))
    assert set(got) == {0, 7, 14, 40, 41}
    for i in (0, 7, 40, 41):
        assert got[i] == {tuple(r) for r in X.top_k(v.filter("id < 44"), "id", "e", rows[i][1], 4).collect()}


def test_link_rules(spark):
    df = spark.createDataFrame([("Закон в ред. от 2020 ФЗ согласно",), ("согласно статье",), ("ничего",), (None,)], "c string")
    k1, c1 = K.classify_first(F.col("c"))
    k2, c2 = K.classify_scored(F.col("c"))
    rows = df.select(k1.alias("k1"), c1.alias("c1"), k2.alias("k2"), F.round(c2, 3).alias("c2")).collect()
    assert [tuple(r) for r in rows] == [("amends", 0.9, "amends", 0.9), ("cites", 0.6, "cites", 0.14), ("unknown", 0.1, "unknown", 0.1), ("unknown", 0.1, "unknown", 0.1)]


def test_registry_rules(spark):
    a = spark.createDataFrame([("i", 0, "src/x.rs", 1, 9), ("i", 1, "../x", 1, 2), ("i", 2, "gone", None, None), ("i", 3, "src/x.rs", 1, None), ("i", 4, "src/x.rs", 5, 99)], "item_id string, pos int, path string, line_start int, line_end int")
    f = spark.createDataFrame([("src/x.rs", 10)], "path string, n_lines int")
    assert {r["pos"]: r["error"] for r in R.anchor_errors(a, f).collect()} == {0: "", 1: "path", 2: "no file", 3: "one bound", 4: "line range"}
    one = spark.createDataFrame([("It is proven. It is not proven! Done.", "bad", None)], "t string, status string, owner string")
    assert one.select(R.overclaims(F.col("t"), "proven")).first()[0] == ["It is proven."]
    assert one.select(R.record_errors(["owner"], {"status": ["ok"]}, {"t": "^x"})).first()[0] == ["required:owner", "enum:status", "pattern:t"]
    assert one.select(R.redact_block(F.col("t"), ["PROVEN"], F.lit(False), F.lit("log"), ["log"])).first()[0] == "blocked"
    assert tuple(one.select(R.run_outcome(F.lit("Error: timeout"), ["error", "timeout", "panic"])).first()[0]) == ("failure", ["error", "timeout"])
    ch = spark.createDataFrame([("src/a.rs",)], "path string")
    assert [tuple(r) for r in R.stale_companions(ch, [("^src/", "^doc/"), ("^doc/", "^src/")]).collect()] == [("^src/", "^doc/")]
    e = spark.createDataFrame([("a", "b"), ("c", "d"), ("x", "y")], "f string, t string")
    ok = spark.createDataFrame([("b", "a"), ("c", "d"), ("m", "n")], "f string, t string")
    assert {tuple(r) for r in R.allow_list_diff(e, ok, ["f", "t"]).collect()} == {("a", "b", "forbidden_direction"), ("x", "y", "extra"), ("b", "a", "missing"), ("m", "n", "missing")}
