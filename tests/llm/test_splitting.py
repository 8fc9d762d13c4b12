import random
import time

from lexstrata.llm.splitting import _sentence_ends, spans, split

SENTENCE = "Держатель перечня утверждает опись вложений в порядке, предусмотренном частью 5. "


def check(text, limit=2000, overlap=200):
    got = spans(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert all(z - a + (overlap if k else 0) <= limit for k, (a, z) in enumerate(got))
    return got


def test_random_texts():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice([SENTENCE, "слово ", "x" * rng.randrange(900), "\n", "\n\n", "é", "ст. 5 ", "a; "]) for _ in range(rng.randrange(1, 120)))
        check(text, rng.choice([2000, 500]), rng.choice([0, 200]))


def test_natural_boundaries_win():
    text = (SENTENCE * 5 + "\n") * 30
    assert all(text[z - 1] == "\n" for _, z in check(text)[:-1])
    text = SENTENCE * 100
    assert all(text[z - 2 : z] == ". " for _, z in check(text)[:-1])
    # A list number and an abbreviation end no sentence.
    text = ("слово " * 20 + "ст. 5 и п. 7 ") * 40
    assert all(text[z - 3 : z - 1] not in ("т.", "п.") for _, z in check(text)[:-1])


def test_one_long_word_and_exact_limit():
    assert check("x" * 2000) == [(0, 2000)]
    assert len(check("x" * 2001)) == 2
    assert len(check("я" * 50_000)) > 25


def test_long_texts_take_time_in_proportion():
    began = time.time()
    assert len(_sentence_ends(SENTENCE * 50_000)) == 50_000 - 1  # 4 M characters
    for run in (".", " ", ". ", "\n ", "!)"):
        _sentence_ends(run * 500_000)
    assert time.time() - began < 8


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 2000, "c"), (4, SENTENCE * 60, "d"), (4, SENTENCE * 60, "d"), (None, SENTENCE * 40, "e")]
    df = spark.createDataFrame(rows, "row_id bigint, t string, piece string")
    got = split(df, "row_id", "t").collect()
    assert {r["row_id"] for r in got} == {4, None}
    pieces = sorted((r["piece_no"], r["piece"]) for r in got if r["row_id"] is None)
    whole = pieces[0][1] + "".join(p[200:] for _, p in pieces[1:])
    assert whole == SENTENCE * 40 and all(len(p) <= 2000 for _, p in pieces)
    assert all(b.startswith(a[-200:]) for (_, a), (_, b) in zip(pieces, pieces[1:]))
    assert len([r for r in got if r["row_id"] == 4]) % 2 == 0
    assert split(df.limit(0), "row_id", "t").count() == 0
