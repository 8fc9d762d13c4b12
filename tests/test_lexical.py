import re

from pyspark.sql import functions as F

from lexstrata.functions import dates, hashing, ids
from lexstrata.functions import vocabulary as V
from lexstrata.operators import lexical as L


def test_tokens_have_byte_offsets(spark):
    texts = ["Статья 5. Не Ёлка-в лес", "", None, "x1y 中文 é😀z", "слово " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in L.tokens(df, ["id"], "text").collect():
        assert texts[r["id"]].encode()[r["start"] : r["end"]].decode().lower() == r["token"]
    got = [r["token"] for r in L.tokens(df.filter("id = 3"), ["id"], "text").orderBy("pos").collect()]
    assert got == ["x", "y", "中文", "é", "z"]


def test_sentences(spark):
    t = "Согласно ст. 5 и п. 1.2 закона. 1. Лица (см. ред. 3) вправе! «Да?» Нет"
    got = [t[a:z] for a, z in L.sentence_spans(t)]
    assert got == ["Согласно ст. 5 и п. 1.2 закона.", "1. Лица (см.", "ред. 3) вправе!", "«Да?»", "Нет"]
    df = spark.createDataFrame([(1, t), (2, None), (3, "  ")], "id int, text string")
    rows = L.sentences(df, ["id"], "text").collect()
    assert len(rows) == 5 and all(t.encode()[r["start"] : r["end"]].decode() == r["sentence"] for r in rows)


def test_mentions(spark):
    t = "Статьи 5 и пункта 1.2.3 статьёй  7а, статье 9_ пункт\t4.. статей 12.x пунктом 8. статьи97 подпункта 3"
    df = spark.createDataFrame([(1, t)], "id int, text string")
    got = [(r["kind"], r["number"]) for r in L.mentions(df, ["id"], "text").orderBy("ord").collect()]
    assert got == [("article", "5"), ("point", "1.2.3"), ("point", "8")]


def test_markers(spark):
    want = {
        "Статья 93. Закупка": ("statya", "93"), "ГЛАВА IV: Контроль": ("glava", "IV"), "\t Раздел 2.": ("razdel", "2"), "Раздел XD. Т": ("razdel", "XD"), "раздел iv) Т": ("razdel", "iv"), "§3. Сроки": ("paragraph", "3"), "1. Часть": ("chast", "1"), "2.1) Пункт": ("punkt", "2.1"),
        "а) подпункт": None, "Статья 5 Название": None, "Статья IV. Имя": None, "Статья 5.. Имя": None, "Глава": None, "7: Имя": None, "\u00a05.1.": ("chast", "5.1"), "Статья без номера": None, "Просто 5": None, "1.Слитно": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", L.marker(F.col("t")).alias("m"))
    assert {r["t"]: (r["m"]["level"], r["m"]["number"]) if r["m"] else None for r in df.collect()} == want


def test_morphology_and_phrases(spark):
    t = "Заказчик не вправе, обязан и запрещается; не  обязаны, не-обязана. Закон вступает в силу, утратил\tсилу, утратил в силу, вступает  не в силу. Нельзя; часть части"
    df = spark.createDataFrame([(1, t)], "id int, text string")
    tokens = L.tokens(df, ["id"], "text")
    got = {(r["token"], r["kind"], r["negated"]) for r in L.morphology(tokens, ["id"]).collect()}
    assert got == {("вправе", "vprave", True), ("обязан", "obyazan", False), ("запрещается", "zapret", False), ("обязаны", "obyazan", True), ("обязана", "obyazan", False)}
    assert {(r["token"], r["kind"], r["negated"]) for r in L.words(df, ["id"], "text", V.MARKER_WORDS).collect()} == got
    assert {r["kind"]: r["n"] for r in L.deontic(L.morphology(tokens, ["id"])).groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"permission": 1, "obligation": 3, "prohibition": 1}
    assert sorted(r["kind"] for r in L.phrases(df, ["id"], "text").collect()) == ["enters_into_force", "loses_force"]
    forms = L.unknown_forms(tokens)
    assert tuple(L.census(forms, ["id"]).first()) == (1, 0, 1, 2)
    assert forms.count() == 3 and L.ranked_census(forms, forms.filter("token = 'часть'")).count() == 2


def test_fnv(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % (1 << 64)
        return f"fnv1a64:{h:016x}"

    texts = ["", "a", "foobar", "утрата", "é😀" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(hashing.fnv1a64(F.col("t"))).collect()] == [fnv(t.encode()) for t in texts]
    assert re.fullmatch(r"fnv1a64-[0-9a-f]{16}", df.select(hashing.section_hash(F.array("t"))).first()[0])


def test_ids_and_dates(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(ids.id_error(F.lit(x))) for x in ("", "a" * 65, "é" * 40, "a b", "A-1_:.")] == ["empty", "too long", "too long", "unsupported character", ""]
    assert value(ids.path_error(F.lit("a//b"))) == "empty path segment"
    assert [value(dates.day_error(F.lit(x))) for x in ("2023-02-30", "2023-2-3", "1799-12-31", "2100-12-31")] == ["no such day", "shape", "out of bounds", ""]
    assert value(dates.day_ordinal(F.lit("1800-01-02"))) == 1 and value(dates.ordinal_day(F.lit(1))) == "1800-01-02" and value(dates.ordinal_day(F.lit(-1))) is None
    assert value(dates.iso_shape(F.lit("2023-99-99"))) is True
    assert value(dates.date_in_name(F.lit("Закон от 5 апреля 2013 N 44 ред. 01-02-2020"))) == "2013-04-05" and value(dates.date_in_name(F.lit("ред. 01.02.2020"))) == "2020-02-01"
    assert value(dates.act_number_in_name(F.lit("PP_60_27-01-2022.odt"))) == "60" and value(dates.act_number_in_name(F.lit("Приказ № 126н"))) == "126"
    assert tuple(value(dates.law_path(F.lit("x/law_2013-04-05_44-fz/e.xml")))) == ("2013-04-05", "44-fz")
    assert [value(dates.revision_path(F.lit(x))) for x in ("e/a_rev-2020-01-01_from-x.xml", "e_rev-2020-01-01", "a_rev-2020-01-01.xml", "rev-initial_b")] == ["2020-01-01", "2020-01-01", None, None]
    assert tuple(value(dates.edition_file(F.lit("d/edition-0012_rev-2020-01-01_from-2021-02-03_ab.xml")))) == (12, "2020-01-01")
    assert tuple(value(dates.edition_file(F.lit("edition-3_rev-initial_from-unknown_9d.xml")))) == (3, "initial")
    assert [value(dates.edition_file(F.lit(x))) for x in ("x.xml", "edition-3.xml", "edition-3_2020.xml", "edition-x_rev-a_.xml")] == [None] * 4
