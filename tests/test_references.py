import random
from datetime import datetime, timedelta

import pytest

from lexstrata.operators.references import orphans, orphans_as_of

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("match", ["simple", "full", "partial"])
def test_null_masks(spark, match):
    rng = random.Random(1)
    pick = lambda: rng.choice([None, "a", "b", "c"])
    refs = [(i, pick(), pick(), i) for i in range(60)] + [(0, "a", "b", 0)] * 2
    targets = [(pick(), pick(), "x") for _ in range(4)]
    r = spark.createDataFrame(refs, "id int, p string, q string, u int")
    t = spark.createDataFrame(targets, "u string, v string, id string")

    def orphan(p, q):
        if p is None and q is None or match == "simple" and None in (p, q):
            return False
        if match == "full" and None in (p, q):
            return True
        return not any((p is None or p == u) and (q is None or q == v) for u, v, _ in targets)

    got = sorted((tuple(x) for x in orphans(r, ["p", "q"], t, ["u", "v"], match).collect()), key=repr)
    assert got == sorted((x for x in refs if orphan(x[1], x[2])), key=repr)
    assert orphans(r, ["p", "q"], t.limit(0), ["u", "v"], "simple").count() == sum(p is not None and q is not None for _, p, q, _ in refs)
    assert orphans(r.limit(0), ["p", "q"], t, ["u", "v"], match).count() == 0


def test_unknown_semantics(spark):
    df = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError):
        orphans(df, ["k"], df, ["k"], "loose")


def test_as_of_against_brute_force(spark):
    rng = random.Random(2)
    when = lambda: None if rng.random() < 0.1 else T0 + timedelta(hours=rng.randrange(200))
    items = [(rng.choice("abcd"), when(), when() if rng.random() < 0.6 else None) for _ in range(25)] + [("hot", T0, T0 + timedelta(days=3))]
    refs = [(i, rng.choice("abcdez"), when(), "x") for i in range(200)] + [(1000 + i, "hot", T0 + timedelta(hours=i), "x") for i in range(100)] + [(5, None, T0, "x")]

    def judge(k, t):
        mine = [(r, x) for i, r, x in items if i == k]
        if any(r is not None and t is not None and r <= t and (x is None or x > t) for r, x in mine):
            return None
        return "missing" if not mine else "deleted" if t is not None and any(r is not None and r <= t for r, _ in mine) else "late"

    r = spark.createDataFrame(refs, "ref_id int, ref string, t timestamp_ntz, live string")
    it = spark.createDataFrame(items, "ref string, t timestamp_ntz, x timestamp_ntz")
    got = sorted((tuple(x) for x in orphans_as_of(r, ["ref"], "t", ["ref_id", "live"], it, ["ref"], "t", "x").collect()), key=repr)
    want = sorted(((i, s, judge(k, t)) for i, k, t, s in refs if k is not None and judge(k, t)), key=repr)
    assert got == want and {x[2] for x in got} == {"missing", "deleted", "late"}
    assert orphans_as_of(r, ["ref"], "t", ["ref_id"], it.limit(0), ["ref"], "t", "x").count() == 300


def test_keys_of_many_records_give_the_same(spark, monkeypatch):
    from lexstrata.operators import references as R

    rng = random.Random(8)
    day = lambda k: None if k is None else f"2024-01-{1 + k // 24:02d} {k % 24:02d}:00:00"
    refs = [(i, f"k{rng.randrange(5)}", day(rng.choice([None, *range(200)]))) for i in range(150)] + [(900 + i, "k0", day(50)) for i in range(30)]
    recs = [(f"k{rng.randrange(4)}", day(rng.choice([None, *range(200)])), day(rng.choice([None, None, *range(200)]))) for _ in range(40)]
    r = spark.createDataFrame(refs, "i bigint, k string, at string").selectExpr("i", "k", "cast(at as timestamp_ntz) at")
    t = spark.createDataFrame(recs, "k string, s string, e string").selectExpr("k", "cast(s as timestamp_ntz) s", "cast(e as timestamp_ntz) e")
    few = {tuple(x) for x in R.orphans_as_of(r, ["k"], "at", ["i"], t, ["k"], "s", "e").collect()}
    monkeypatch.setattr(R, "FEW", 2)
    assert {tuple(x) for x in R.orphans_as_of(r, ["k"], "at", ["i"], t, ["k"], "s", "e").collect()} == few

    def kind(k, at):
        own = [x for x in recs if x[0] == k]
        if not own:
            return "missing"
        started = [x for x in own if at is not None and x[1] is not None and x[1] <= at]
        if any(x[2] is None or x[2] > at for x in started):
            return None
        return "deleted" if started else "late"

    assert few == {(i, kind(k, at)) for i, k, at in refs if kind(k, at)}
