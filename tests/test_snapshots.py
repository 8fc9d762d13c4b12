import random
from datetime import datetime, timedelta

from lexstrata.operators.snapshots import changes

DDL = "edition int, work string, number string, text string, at timestamp_ntz, id bigint, snap int, h1 string, side int"
T0 = datetime(2024, 1, 1)


def brute(rows):
    latest = {}
    for e, w, n, t, at, i in rows:
        if None not in (e, w, n):
            k, rank = (e, w, n), (at is not None, at or T0, i)
            if k not in latest or rank > latest[k][0]:
                latest[k] = (rank, t)
    editions = sorted({r[0] for r in rows if r[0] is not None})
    out = set()
    for before, now in zip(editions, editions[1:]):
        a = {k[1:]: v[1] for k, v in latest.items() if k[0] == before}
        b = {k[1:]: v[1] for k, v in latest.items() if k[0] == now}
        out |= {(now, *k, "added") for k in b.keys() - a.keys()} | {(now, *k, "removed") for k in a.keys() - b.keys()}
        out |= {(now, *k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def run(spark, rows, chunk_rows=8):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DDL)
    return sorted(map(tuple, changes(df, "edition", ["work", "number"], "text", "at", "id", chunk_rows).collect()))


def test_random_snapshots(spark):
    rng = random.Random(4)
    for chunk_rows in (1, 8):
        rows, state = [], {}
        for e in (1, 2, 4, 7):
            for _ in range(60):
                k = (f"w{rng.randrange(3)}", str(rng.randrange(60)))
                state[k] = rng.choice([None, "", "a", "b", "c" * 5000])
            for k in rng.sample(sorted(state), 10):
                del state[k]
            rows += [(e, *k, t, T0 + timedelta(days=e), len(rows)) for k, t in state.items()]
        rows += [(r[0], r[1], r[2], "late", T0 + timedelta(days=90), 10_000 + i) for i, r in enumerate(rng.sample(rows, 30))]
        rows += [(r[0], r[1], r[2], "tie", r[4], 20_000 + i) for i, r in enumerate(rng.sample(rows, 20))]
        rows += [(r[0], r[1], r[2], "no time", None, 30_000 + i) for i, r in enumerate(rng.sample(rows, 20))]
        rows += [(None, "w0", "1", "x", T0, 1), (9, None, "1", "x", T0, 1), (9, "w0", None, "x", T0, 1)] + rows[:5]
        got = run(spark, rows, chunk_rows)
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "w", "1", "a", T0, 1)]) == []
    assert run(spark, [(1, "w", "1", None, T0, 1), (2, "w", "1", None, T0, 2), (3, "w", "1", "", T0, 3)]) == [(3, "w", "1", "changed")]
    # An edition whose rows have no number still counts as one with rows.
    assert run(spark, [(1, "w", "1", "a", T0, 1), (2, "w", None, "a", T0, 2), (3, "w", "1", "a", T0, 3)]) == [(2, "w", "1", "removed"), (3, "w", "1", "added")]
