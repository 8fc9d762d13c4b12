from itertools import combinations

import numpy as np

from lexstrata.llm import plans
from lexstrata.llm.language import LANGS, codewords, fit, label_language, line_languages, train

LINES = {
    "ru": "Держатель перечня утверждает опись вложений в порядке, предусмотренном частью пятой настоящего раздела.",
    "en": "The registry keeper forwards the inventory of annexes to storage and enters the outcome in the catalogue.",
    "de": "Die Sachbearbeitung übermittelt das Verzeichnis der Fassungen und bestätigt es spätestens am Ende des Monats.",
    "fr": "Le dépositaire des actes transmet la liste consolidée des éditions et en informe l'intéressé sans délai.",
    "es": "La oficina del registro remite la lista consolidada de ediciones y guarda una copia en otro soporte.",
    "pt": "A comissão de revisão certifica a ficha do documento no prazo de dez dias úteis e comunica-o ao interessado.",
    "uk": "Архівне бюро оприлюднює звіт про розбіжності не пізніше кінця звітного місяця та зберігає його копію.",
    "bg": "Отделът за сверка заверява картона на документа не по-късно от края на месеца и вписва резултата.",
}


def test_codewords_are_far_apart():
    assert min(int((a != b).sum()) for a, b in combinations(codewords(), 2)) == 8


def test_seeds_alone_tell_sentences():
    m = fit([], [])
    best, confidence, _ = m.decode(m.margins(list(LINES.values())))
    assert [LANGS[i] for i in best] == list(LINES) and (confidence > 0).all()


def test_wrong_labels_do_no_harm():
    lines = [x for lang in LANGS for x in [LINES[lang]] * 9]
    labels = [LANGS.index(lang) for lang in LANGS for _ in range(9)]
    labels[0:2] = [LANGS.index("fr")] * 2  # Russian lines labelled French
    m = fit(lines, labels)
    best, _, _ = m.decode(m.margins(list(LINES.values())))
    assert [LANGS[i] for i in best] == list(LINES)


def test_rows(spark):
    mixed = LINES["ru"] + "\r\n" + LINES["de"] + "\n" + "480,78 | 220,24 | 704,45 | 533,97 | 374,09 | 1232,79 | 251,08 | 235,29" + "\nShort line"
    quoted = LINES["fr"] + " («Архивное бюро»)"
    rows = [(1, mixed, "ru", 1), (2, quoted, "xx", 1), (3, None, "en", 1), (4, "", None, 1), (5, LINES["en"] * 3000, "English", 1), (5, LINES["en"], "eng", 1), (None, LINES["en"], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, line_no int")
    model = train(df, "doc_id", "text", "lang")
    got = sorted((r["doc_id"], r["line_no"], r["lang"]) for r in line_languages(df, "doc_id", "text", model).collect())
    assert got == [(1, 0, "ru"), (1, 1, "de"), (2, 0, "fr"), (5, 0, "en"), (5, 0, "en")]
    empty = df.limit(0)
    assert line_languages(empty, "doc_id", "text", train(empty, "doc_id", "text", "lang")).count() == 0


def test_short_lines_and_headings(spark, tmp_path):
    headings = "The registry keeper\r\nforwards the annexes\nand the outcome"
    rows = [(1, LINES["en"] + "\nDie Sachbearbeitung bestätigt das Verzeichnis.", "en"), (2, headings, None), (3, "480,78 | 220,24\n12", None), (4, None, "ru"), (5, LINES["de"], "de")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["doc_id"], r["line_no"], r["lang"]) for r in plans.p9_segments(spark, str(tmp_path)).collect()} == {(1, 0, "en"), (1, 1, "de"), (2, 0, "none"), (2, 1, "none"), (2, 2, "none"), (3, 0, "none"), (3, 1, "none"), (5, 0, "de")}
    assert {(r["doc_id"], r["lang"], r["label"]) for r in plans.p9_documents(spark, str(tmp_path)).collect()} == {(1, "en", "en"), (2, "en", ""), (3, "none", ""), (4, "none", "ru"), (5, "de", "de")}


def test_unclear_texts_are_flagged(spark):
    lines = [x for lang in LANGS for x in [LINES[lang]] * 3]
    m = fit(lines, [LANGS.index(lang) for lang in LANGS for _ in range(3)])
    words = {lang: LINES[lang].split() for lang in LANGS}
    rows = [(k, " ".join(words[a][:k] + words[b][: 16 - k])) for k in range(4, 13) for a, b in (("es", "pt"),)]
    got = line_languages(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", m, 1).collect()
    unclear = [r for r in got if r["ambiguous"]]
    assert unclear and all(r["confidence"] < 0.7 for r in unclear) and len(unclear) < len(got)
    _, confidence, unsure = m.decode(np.zeros((1, 15)))
    assert unsure[0] and confidence[0] < 0.2


def test_copies_of_one_id_are_one_document(spark):
    rows = [(1, LINES["en"], "en")] * 60 + [(2, LINES["de"], "de"), (3, LINES["fr"] * 400, "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = train(df, "doc_id", "text", "lang", sample_docs=2)
    assert {r["lang"] for r in line_languages(df, "doc_id", "text", model).collect()} == {"en", "de", "fr"}


def test_labels(spark):
    want = {"ru": "ru", "RUS": "ru", "ru-RU": "ru", "en_US": "en", " German ": "de", "fre": "fr", "deu": "de", "xx": None, "und": None, "": None, "n/a": None, "Russian": "ru", "-": None, "por": "pt", None: None}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    assert {r["l"]: r["x"] for r in df.select("l", label_language("l").alias("x")).collect()} == want


def test_margins_of_lines_without_words():
    m = fit([], [])
    assert np.abs(m.margins(["123", ""])).sum() == 0
