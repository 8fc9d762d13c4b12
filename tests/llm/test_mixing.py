from collections import Counter

from lexstrata.llm.mixing import mix


def test_shares_and_caps(spark):
    rows = [(i, s, 50 + (i * 37) % 200) for s, n in (("a", 4000), ("b", 600), ("c", 80)) for i in range(n)]
    rows += [(1, None, 10), (2, "untargeted", 10), (99_999, "a", 0), (None, "a", 5)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mix(counts, targets)
    out = m.rows.collect()
    seen = Counter((r["source"], r["doc_id"]) for r in out)
    caps = {"a": 1, "b": 2, "c": 4}
    assert set(r["source"] for r in out) == set(caps) and all(k <= caps[s] for (s, _), k in seen.items())
    report = {r["source"]: r for r in m.report.collect()}
    total = sum(r["n_tokens"] for r in out)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s]["actual_share"] - share) < 0.02 and report[s]["tokens"] == sum(r["n_tokens"] for r in out if r["source"] == s)
        assert report[s]["most_repeats"] == max(k for (t, _), k in seen.items() if t == s)
    # The small source limits the mix: nearly all its passes are used.
    tokens_c = sum(n for _, s, n in rows if s == "c")
    assert report["c"]["tokens"] > 0.95 * 4 * tokens_c and report["none"]["tokens"] == 0
    # Every stretch has nearly the target shares.
    by_slot = sorted(out, key=lambda r: r["slot"])
    for q in range(4):
        part = by_slot[q * len(out) // 4 : (q + 1) * len(out) // 4]
        size = sum(r["n_tokens"] for r in part)
        assert abs(sum(r["n_tokens"] for r in part if r["source"] == "b") / size - 0.3) < 0.06
    assert total > 0 and m.rows.count() == len(out)


def test_a_smaller_mix_and_empty_tables(spark):
    counts = spark.createDataFrame([(i, s, 100) for s in "ab" for i in range(300)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    r = {x["source"]: x for x in mix(counts, targets, total_tokens=20_000).report.collect()}
    assert abs(r["a"]["tokens"] - 10_000) < 1500 and r["b"]["most_repeats"] == 1
    empty = mix(counts.limit(0), targets)
    assert empty.rows.count() == 0 and [x["tokens"] for x in empty.report.collect()] == [0, 0]
    assert mix(counts, targets.limit(0)).rows.count() == 0
