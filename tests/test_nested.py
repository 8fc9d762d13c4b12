import json
import random

import numpy as np

from lexstrata.functions.structure import OPEN_A, OPEN_O, JsonIndex
from lexstrata.operators.nested import TABLES, flatten


def value(rng, depth=0):
    r = rng.random()
    if depth > 4 or r < 0.35:
        return rng.choice([None, True, 0, -1.5e3, "a", 'b\\"c', "é\n{[,:]}", "", "\\"])
    if r < 0.65:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "é", 'q"x']): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def strict(text):
    def no(x):
        raise ValueError(x)

    try:
        return True, json.loads(text, parse_constant=no)
    except ValueError:
        return False, None


def test_index_agrees_with_a_parser():
    rng, texts = random.Random(7), []
    for _ in range(3000):
        t = json.dumps(value(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if rng.random() < 0.6:
            k = rng.randrange(len(t))
            t = t[:k] if rng.random() < 0.3 else t[:k] + rng.choice('{}[],:"\\ 1a\n') + t[k + rng.randrange(2) :]
        texts.append(t)
    ix = JsonIndex([t.encode() for t in texts])

    def build(v):
        if ix.kind[v] == OPEN_A:
            return [build(x) for x in ix.items(np.array([v]))[2]]
        if ix.kind[v] == OPEN_O:
            return {json.loads(ix.raw[ix.start[ix.key[x]] : ix.end[ix.key[x]]]): build(x) for x in np.flatnonzero(ix.holder == v) if ix.is_value[x]}
        return json.loads(ix.raw[ix.start[v] : ix.end[v]])

    for i, t in enumerate(texts):
        ok, want = strict(t)
        assert ok == bool(ix.valid[i]), t
        if ok and i % 10 == 0:
            assert build(ix.root[i]) == want


def brute_claims(text):
    while text is not None:
        try:
            v = json.loads(text.lstrip("﻿ \t\r\n"))
        except ValueError:
            return []
        if not isinstance(v, str):
            break
        text = v
    if text is None or not isinstance(v, dict):
        return []
    p = v["packet"] if isinstance(v.get("packet"), dict) else v
    e = v.get("envelope")
    if p is v and isinstance(e, dict) and isinstance(e.get("packet"), dict):
        p = e["packet"]

    def listed(x):
        return x if isinstance(x, list) else [] if x is None else [x]

    norm = p.get("normalization")
    status = (norm.get("status") if isinstance(norm, dict) else None) or ""
    out = [(-1, i, "", status) for i, c in enumerate(listed(p.get("non_claims"))) if c is not None]
    for f_pos, f in enumerate(listed(p.get("findings"))):
        if isinstance(f, dict):
            out += [(f_pos, i, f.get("finding_id") or "", status) for i, c in enumerate(listed(f.get("non_claims"))) if c is not None]
    return out


PACKET = {
    "packet_id": "RC-1",
    "normalization": {"status": "stäle"},
    "non_claims": ["a", None, {"x": 1}, 3],
    "findings": [None, {"finding_id": None, "non_claims": "one"}, {"finding_id": "F", "non_claims": [None, "b\"q"], "source_spans": [{"path": "p", "line_start": 3}], "candidate_targets": {"id": "T"}}, "odd"],
    "events": [{"event_id": "E", "payload": {"non_claims": ["of an event"]}}, None],
}
SHAPES = [
    json.dumps(PACKET),
    json.dumps({"packet": PACKET}),
    json.dumps({"envelope": {"packet": PACKET}, "packet": None}, indent=2),
    "﻿ \n" + json.dumps(json.dumps(PACKET)),
    json.dumps(PACKET)[:-1],
    json.dumps(PACKET) + "]",
    json.dumps({"findings": {"non_claims": ["x"]}, "normalization": None}),
    '{"non_claims": ["first"], "non_claims": ["last"], "normalization": {"status": null}}',
    '{"non_\\u0063laims": "escaped key"}',
    '{"non_claims": "\\ud800"}',
    "[]", "3", '""', "", " ", "not a packet", "{", None,
    '{"non_claims": [' + ", ".join(f'"{i}"' for i in range(5000)) + "]}",
]


def test_claims_agree_with_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SHAPES)], "record_id bigint, payload string, status int")
    got = {tuple(r) for r in flatten(df, "record_id", "payload", "non_claims", ["finding_pos", "claim_pos", "finding_id", "status"]).collect()}
    want = {(i, *x) for i, t in enumerate(SHAPES) for x in brute_claims(t)}
    assert got == want and len(want) > 5000


def test_all_tables_keep_links(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SHAPES)], "record_id bigint, payload string")
    rows = {n: [r.asDict() for r in flatten(df, "record_id", "payload", n).collect()] for n in TABLES}
    assert {r["record_id"] for r in rows["packets"]} == {0, 1, 2, 3, 6, 7, 8, 9, 18}
    spans = [r for r in rows["spans"] if r["record_id"] == 0]
    assert [(r["finding_pos"], r["span_pos"], r["finding_id"], r["line_start"]) for r in spans] == [(2, 0, "F", "3")]
    assert [r["target_id"] for r in rows["targets"] if r["record_id"] == 1] == ["T"]
    assert [(r["event_pos"], r["event_id"]) for r in rows["events"] if r["record_id"] == 2] == [(0, "E")]
    assert flatten(df.limit(0), "record_id", "payload", "findings").count() == 0
