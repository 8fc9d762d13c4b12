import io
import json
import zipfile

from pyspark.sql import functions as F

from lexstrata.functions.hashing import fnv1a64
from lexstrata.operators.links import extract_links
from lexstrata.sources import odt, records, wordml

W = '<w:wordDocument xmlns:w="urn:w"><w:body>{}</w:body></w:wordDocument>'
P = '<w:p><w:pPr><w:pStyle w:val="{}"/></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>'


def test_wordml(spark):
    xml = W.format(P.format("2", "Закон &amp; право") + "<w:p><w:r><w:t>  </w:t></w:r></w:p>" + "<w:p><w:r><w:t>Тело</w:t><w:binData><w:t>нет</w:t></w:binData></w:r></w:p>" + P.format("99", "?"))
    df = spark.createDataFrame([("ok", xml.encode()), ("cut", xml[:-9].encode()), ("empty", b"")], "doc string, content binary")
    rows = wordml.blocks(df).collect()
    ok = sorted((r for r in rows if r["doc"] == "ok"), key=lambda r: r["block_ix"])
    assert [(r["text"], r["style"]) for r in ok] == [("Закон & право", "Title"), ("Тело", "BodyText"), ("?", "Unknown")]
    for r in ok:
        part = xml.encode()[r["src_start"] : r["src_end"]]
        assert part.startswith(b"<w:p>") and part.endswith(b"</w:p>")
    bad = [r for r in rows if r["doc"] != "ok"]
    assert len(bad) == 2 and all(r["decode_error"] and r["text"] is None for r in bad)
    assert [r["candidate"] for r in wordml.candidates(wordml.blocks(df)).orderBy("candidate").collect()] == ["cand:1", "cand:2"]


def package(content, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in {"content.xml": content, **more}.items():
            z.writestr(n, c)
    return out.getvalue()


def test_odt(spark):
    head = f'<o:document-content xmlns:o="{odt.OFFICE}" xmlns:t="{odt.TEXT}"><o:body><o:text>'
    good = head + '<t:h t:style-name="h1">Глава</t:h><t:p t:style-name="Standard">a<t:s t:c="3"/><t:span>b</t:span></t:p><t:p/><t:p t:style-name="s9">c</t:p></o:text></o:body></o:document-content>'
    docs = {"good": package(good), "doctype": package('<!DOCTYPE x []>' + good), "spaces": package(good.replace('"3"', '"65"')), "unsafe": package(good, **{"../x": "1"}), "none": package("x")[:10], "many": package(good, **{f"f{i}": "" for i in range(16)})}
    df = spark.createDataFrame(list(docs.items()), "doc string, content binary")
    rows = odt.blocks(df).collect()
    assert [(r["kind"], r["text"], r["style"]) for r in rows if r["doc"] == "good"] == [("heading", "Глава", "Heading"), ("paragraph", "a   b", "BodyText"), ("paragraph", "c", "ProviderComment")]
    assert {r["doc"] for r in rows if r["decode_error"]} == set(docs) - {"good"}
    prof = odt.smoke_profile(odt.blocks(df.filter("doc = 'good'"), keep_empty=True), ["глава"]).collect()
    assert sum(r["n_blocks"] for r in prof) == 4 and sum(r["n_empty"] for r in prof) == 1 and sum(r["n_marker_0"] for r in prof) == 1


def test_links(spark):
    para = '<w:p><w:r><w:t>в ред. </w:t></w:r><w:hlink w:dest="x:1"><w:r><w:t>закона</w:t></w:r></w:hlink><w:hlink><w:t>no</w:t></w:hlink></w:p>'
    df = spark.createDataFrame([("d", W.format(para + para))], "doc string, xml string")
    got = [tuple(r) for r in extract_links(df, ["doc"], "xml").orderBy("ord").collect()]
    assert [(o, d, t) for _, o, d, t, _ in got] == [(0, "x:1", "закона"), (1, "x:1", "закона")] and got[0][4].startswith("в ред. закона")


def test_registry_lines(spark, tmp_path):
    lines = ['{"id": "A", "record_kind": "item"}', "", '{"id": "A"}', "[1]", "{oops", '{"x": 1}', '{"id": "B", "record_kind": "edge"}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    got = {r["line"]: r["diagnostic"] for r in records.registry_lines(spark, str(tmp_path), "item").collect()}
    assert got == {1: "", 3: "duplicate id", 4: "not an object", 5: "malformed", 6: "missing id", 7: "wrong record_kind"}


def test_folders_and_sinks(spark, tmp_path):
    for name in ("edition-1_rev-2020-01-01_ab.xml", "edition-2_rev-initial_from-x.xml", "edition-3.xml", "other.xml", "edition-x.xml"):
        (tmp_path / name).write_text("<x/>")
    assert sorted((r["edition_number"], r["revision"]) for r in records.edition_files(spark, str(tmp_path)).collect()) == [(1, "2020-01-01"), (2, "initial")]
    packets = tmp_path / "p"
    packets.mkdir()
    (packets / "a.json").write_text(json.dumps({"packet_id": "x"}, indent=1))
    assert json.loads(records.packets(spark, str(packets)).first()["payload"])["packet_id"] == "x"
    df = spark.createDataFrame([("temporal", "утрата", 3)], "kind string, token string, n int")
    line = df.select(records.patch_lines(F.col("kind"), fnv1a64(F.col("token")), F.col("token"), F.col("n")).alias("l"))
    back = line.select(records.parse_patch(F.col("l")).alias("p")).first()["p"]
    assert (back["kind"], back["token"], back["count"], back["error"]) == ("temporal", "утрата", 3, "")
    assert spark.createDataFrame([("- x",)], "l string").select(records.parse_patch(F.col("l"))["error"]).first()[0] == "malformed"
    obs = spark.createDataFrame([(f"t{i}", i, 1) for i in range(60)], "link_text string, n bigint, n_dests bigint")
    report = [r[0] for r in records.observations_report(obs).collect()]
    assert len(report) == 51 and report[-1] == "omitted: 10"
    assert json.loads(df.select(records.json_report("kind", "n")).first()[0]) == {"kind": "temporal", "n": 3}
    ledger = str(tmp_path / "ledger")
    records.append_ledger(df, ledger)
    records.append_ledger(df, ledger)
    assert spark.read.parquet(ledger).count() == 2
