import random
import unicodedata

import pytest

from lexstrata.llm.lookalikes import SHAPES, consistent_form, form_keys, forms, lookalike_classes, lookalike_pairs

SAME = [
    ("орган", "opган"), ("сора", "copa"), ("Ведущий", "Bедущий"), ("ёлка", "ёлка"), ("ёлка", "ëлка"), ("ёлка", "ëлка"), ("район", "район"), ("ў", "y̆"),
    ("а б", "а б"), ("а б", "а　б"), ("а б", "а\tб"), ("аб", "а​б"), ("аб", "﻿а­б⁠"), ("ABC 12", "ＡＢＣ　１２"), ("é", "é"), ("Ον", "Ov"), ("ΧΜ", "XM"), ("Ѕtadt", "Stadt"),
]
DIFFERENT = [("е", "ё"), ("и", "й"), ("a", "A"), ("1", "¹"), ("1", "2"), ("a b", "a  b"), ("a\nb", "a b"), ("a.", "a;"), ("3", "З"), ("x", "𝑥"), ("º", "°"), ("і", "и")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert consistent_form(a) == consistent_form(b)
    assert consistent_form(f"Весь текст: {a}, дальше") == consistent_form(f"Весь текст: {b}, дальше")


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_other_look(a, b):
    assert consistent_form(a) != consistent_form(b)


@pytest.mark.parametrize("a,b", [("\u03f2\u03bf", "co"), ("\u03f9", "C"), ("\u03f3", "j"), ("\u0475", "v"), ("\u0474", "V"), ("\u04c0", "I"), ("\u04cf", "l"), ("\u050c", "G"), ("\u04ae", "Y"), ("\u04ae", "\u0423")])
def test_rarer_letters_of_one_shape(a, b):
    assert consistent_form(a) == consistent_form(b)


def test_mixed_and_whole_script_tokens_are_counted(spark):
    rows = [(1, "\u0414ep\u0436a\u0442\u0435\u043b\u044c \u0441\u043e\u0440\u0430 \u043b\u0438\u0441\u0442"), (2, "plain words 12"), (3, None)]
    got = {r["row_id"]: (r["n_mixed"], r["n_whole"]) for r in forms(spark.createDataFrame(rows, "i bigint, t string"), "i", "t").collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (0, 0)}


def test_copies_make_no_candidates_and_classes_have_the_size_of_the_rows(spark):
    rows = [(i, "w", "\u0441\u043e\u0440\u0430") for i in range(40)] + [(100, "w", "copa"), (101, "w", "\u0441opa"), (102, "w", "other")]
    keys = form_keys(spark.createDataFrame(rows, "i bigint, g string, t string"), "i", "g", "t")
    assert lookalike_pairs(keys, ["grp"]).count() == 40 * 2 + 1
    got = lookalike_classes(keys, ["grp"]).collect()
    assert len(got) == 42 and {(r["class_id"], r["n_rows"], r["n_spellings"]) for r in got} == {(0, 42, 3)}


def test_the_consistent_script_is_chosen():
    assert consistent_form("Держатель пepeчня") == "Держатель перечня"
    assert consistent_form("the сору of рареr") == "the copy of paper"
    assert consistent_form("Весь сор и copa") == "Весь сор и сора"  # a whole-script confusable follows the text
    assert consistent_form("All is cop and сора") == "All is cop and copa"


def test_against_a_plain_skeleton():
    rng = random.Random(5)
    base = {c: row[0] for row in SHAPES for c in row if c != "-"}
    members = {row[0]: [c for c in row if c != "-"] for row in SHAPES}

    def plain(t):
        return unicodedata.normalize("NFC", "".join(base.get(c, c) for c in unicodedata.normalize("NFD", t)))

    letters = "аеорсухiАВЕКМНОРСТХbdfgбвгдёйЙïї 12.\n"
    for _ in range(300):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 25)))
        u = "".join(rng.choice(members.get(base.get(c), [c])) if rng.random() < 0.5 else c for c in unicodedata.normalize("NFD", t))
        assert plain(t) == plain(u) and consistent_form(t) == consistent_form(u)
        v = t.replace("ё", "е", 1) if "ё" in t else t + "x"
        assert consistent_form(v) != consistent_form(t)


def test_rows_and_pairs(spark):
    rows = [(1, "w", "сора", "n"), (2, "w", "copa", "n"), (3, "w", "copa", "n"), (4, "v", "сора", "n"), (5, "w", None, "n"), (6, "w", "", "n"), (7, None, "copa", "n"), (8, "w", "Copa", "n"), (9, "w", "я" * 100_000, "n"), (None, "w", "copa", "n")]
    df = spark.createDataFrame(rows, "row_id bigint, grp string, form string, f1 string")
    keys = form_keys(df, "row_id", "grp", "form")
    assert sorted(map(tuple, lookalike_pairs(keys, ["grp"]).collect())) == [("w", 1, 2), ("w", 1, 3)]
    made = {r["row_id"]: r["form"] for r in forms(df, "row_id", "form").collect()}
    assert made[5] is None and made[6] == "" and made[9] == "я" * 100_000 and made[1] == made[2]
    assert forms(df.limit(0), "row_id", "form").count() == 0 and form_keys(df.limit(0), "row_id", "grp", "form").count() == 0
