import random

import numpy as np
import pytest

from lexstrata.llm.encoding import TOKENIZERS, ChunkEncoder, chunk_ends, encode, encoder


@pytest.fixture(scope="module")
def own():
    return encoder(TOKENIZERS, "byte_bpe_50k")


def plain(own, t):
    return own._bpe.encode_ordinary(t)


def test_exact_on_odd_texts(own):
    rng = random.Random(1)
    signs = " \n\r\t  ab1'.,st's'll é中文😀­​ \x1c<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.choice([1, 3, 50, 3000]))) for _ in range(300)]
    texts += ["a" * 20_000, " " * 5000 + "x", "\n" * 3000, "中" * 4000, "<|endoftext|> a", "слово " * 5000]
    made = ChunkEncoder(own)
    for t, ends in zip(texts, chunk_ends(texts)):
        assert np.frombuffer(made.ids(t, ends), np.int32).tolist() == plain(own, t)


def test_agrees_with_the_other_library(own):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for t in ("Порядок сверки  \n\n 12 <|endoftext|> it's", "  x\ty "):
        assert other.encode(t, add_special_tokens=False).ids == plain(own, t)


def test_chunks_depend_on_content():
    rng = random.Random(2)
    body = "".join(rng.choice("абвгдежз .") for _ in range(8000))
    a, b = chunk_ends([body, "Вставка. " + body])
    assert len(a) > 8 and len({int(x) + 9 for x in a} & set(map(int, b))) >= len(a) - 1


def test_rows(spark, own):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (4, "я" * 30_000, None), (None, "a", "x")] + [(10 + i, "стоковый текст", "y") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in encode(df, "doc_id", "text").collect()]
    want = [(i, plain(own, t) if t else []) for i, t, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    counts = {(r["doc_id"], r["ids"]): r["n_tokens"] for r in encode(df, "doc_id", "text", "count", keep=["ids"]).collect()}
    assert counts[2, "x"] == 0 and counts[4, None] == len(plain(own, "я" * 30_000))
    assert encode(df.limit(0), "doc_id", "text").count() == 0
