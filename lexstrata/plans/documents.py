"""Queries that decode documents: the blocks of each package are written as a document of a format and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import links as K
from ..session import shared_dir, ship, table
from ..sources import odt, records, wordml

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def _escaped(c: Column) -> Column:
    """Text as XML holds it, without what XML can't hold."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return F.regexp_replace(c, _CONTROL, "")


def _joined(spark: SparkSession, d: str, element: Column, head: str, tail: str) -> DataFrame:
    """(doc, xml): one document a package, its blocks in order."""
    b = table(spark, d, "open_blocks").filter("package_id is not null and order_index is not null and text is not null").withColumn("x", element)
    g = b.groupBy(F.col("package_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("order_index", "block_id", "x"))).alias("r"))
    return g.select("doc", F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["x"]), ""), F.lit(tail)).alias("xml"))


def _wordml(spark: SparkSession, d: str) -> DataFrame:
    link = F.when(F.col("order_index") % 3 == 0, F.concat(F.lit('<w:hlink w:dest="consultantplus://'), F.col("block_id"), F.lit('"><w:r><w:t>'), F.coalesce("kind", F.lit("")), F.lit("</w:t></w:r></w:hlink>"))).otherwise("")
    element = F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), F.col("order_index") % 10, F.lit('"/></w:pPr><w:r><w:t>'), _escaped(F.col("text")), F.lit("</w:t></w:r>"), link, F.lit("</w:p>"))
    return _joined(spark, d, element, '<w:wordDocument xmlns:w="urn:w"><w:body>', "</w:body></w:wordDocument>")


def _odt(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("kind") == "heading", "t:h").otherwise("t:p")
    style = F.when(F.col("provider_style_id").isNotNull(), F.concat(F.lit(' t:style-name="'), _escaped(F.col("provider_style_id")), F.lit('"'))).otherwise("")
    element = F.concat(F.lit("<"), tag, style, F.lit(">"), _escaped(F.col("text")), F.lit("</"), tag, F.lit(">"))
    xml = _joined(spark, d, element, f'<o:document-content xmlns:o="{odt.OFFICE}" xmlns:t="{odt.TEXT}"><o:body><o:text>', "</o:text></o:body></o:document-content>")
    ship(spark)

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["xml"]:
                package = io.BytesIO()
                with zipfile.ZipFile(package, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("content.xml", text.encode("utf-8", "replace"))
                out.append(package.getvalue())
            yield pd.DataFrame({"doc": batch["doc"], "content": out})

    return xml.mapInPandas(zipped, "doc string, content binary")


def wordml_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = _wordml(spark, d).select("doc", F.encode("xml", "utf-8").alias("content"))
    b = wordml.blocks(docs)
    return b.select(F.col("doc").alias("package_id"), "block_ix", F.md5("text").alias("text_md5"), "style", F.coalesce("decode_error", F.lit("")).alias("decode_error"))


def wordml_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = wordml.candidates(wordml.blocks(_wordml(spark, d).select("doc", F.encode("xml", "utf-8").alias("content"))))
    return c.groupBy(F.col("doc").alias("package_id")).agg(F.count("*").alias("n"), F.max(F.regexp_extract("candidate", "([0-9]+)$", 1).cast("int")).alias("last"))


def wordml_links(spark: SparkSession, d: str) -> DataFrame:
    found = K.extract_links(_wordml(spark, d), ["doc"], "xml")
    return found.select(F.col("doc").alias("package_id"), "ord", "dest", "link_text", F.md5("context").alias("context_md5"), K.link_kind(F.col("dest")).alias("kind"))


def odt_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = odt.blocks(_odt(spark, d))
    return b.select(F.col("doc").alias("package_id"), "block_ix", "kind", F.md5("text").alias("text_md5"), "style", F.coalesce("decode_error", F.lit("")).alias("decode_error"))


def odt_profile(spark: SparkSession, d: str) -> DataFrame:
    return odt.smoke_profile(odt.blocks(_odt(spark, d), keep_empty=True), ["дел"]).select(F.col("doc").alias("package_id"), "style_id", "n_blocks", F.col("n_marker_0").alias("n_marker"))


def _edition_names(spark: SparkSession, d: str) -> DataFrame:
    """File names of the editions, some of other forms."""
    e = table(spark, d, "edition_summaries").select("edition_number", F.coalesce("revision_date", F.lit("initial")).alias("r")).filter("edition_number is not null").distinct()
    plain = F.concat(F.lit("acts/law_2013-04-05_44-fz/edition-"), F.lpad(F.col("edition_number").cast("string"), 4, "0"), F.lit("_rev-"), "r", F.lit("_from-x_1f.xml"))
    return e.select("edition_number", F.when(F.col("edition_number") % 5 == 4, F.replace(plain, F.lit("_rev-"), F.lit("_"))).otherwise(plain).alias("path"))


def edition_names(spark: SparkSession, d: str) -> DataFrame:
    n = _edition_names(spark, d)
    e, law = dates.edition_file(F.col("path")), dates.law_path(F.col("path"))
    return n.select("path", F.coalesce(e["edition_number"], F.lit(-1)).alias("edition_number"), F.coalesce(e["revision"], F.lit("")).alias("revision"), F.coalesce(law["number"], F.lit("")).alias("act"), F.coalesce(dates.revision_path(F.col("path")), F.lit("")).alias("day"))


def registry_file(spark: SparkSession, d: str) -> DataFrame:
    """Registry items written as lines and read with their diagnostics."""
    i = table(spark, d, "valid_items").select("id", F.when(F.col("layer") == "review", "edge").otherwise("item").alias("record_kind"), "title")
    folder = f"{shared_dir(spark).rstrip('/')}/lexstrata-lines-{abs(hash((spark.sparkContext.applicationId, d)))}"
    i.select(F.to_json(F.struct("id", "record_kind", "title"))).write.mode("overwrite").text(folder)
    lines = records.registry_lines(spark, folder, "item")
    return lines.groupBy("diagnostic").agg(F.count("*").alias("n"), F.count_if(F.col("line") > 0).alias("numbered"))


QUERIES = {f.__name__: f for f in (wordml_blocks, wordml_candidates, wordml_links, odt_blocks, odt_profile, edition_names, registry_file)}

_SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
_PLAIN = f"regexp_replace(text, '{_CONTROL}', '', 'g')"
_BLOCKS = f"b AS (SELECT *, {_PLAIN} AS t FROM open_blocks WHERE package_id IS NOT NULL AND order_index IS NOT NULL AND text IS NOT NULL)"
_RAW = "replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;')"
_WSTYLE = "CASE WHEN order_index % 10 IN (0, 1, 4, 7, 8) THEN 'BodyText' WHEN order_index % 10 IN (2, 5) THEN 'Title' WHEN order_index % 10 = 3 THEN 'TableCell' WHEN order_index % 10 = 6 THEN 'JurTerm' ELSE 'Unknown' END"
_FULL = f"trim(t, {_SPACES}) <> ''"
#: In the WordML documents a link's text belongs to its paragraph.
_WTEXT = "t || CASE WHEN order_index % 3 = 0 THEN coalesce(kind, '') ELSE '' END"

ORACLES: dict[str, str] = {
    "wordml_blocks": f"WITH {_BLOCKS} SELECT package_id, (row_number() OVER (PARTITION BY package_id ORDER BY order_index, block_id) - 1)::int AS block_ix, md5({_WTEXT}) AS text_md5, {_WSTYLE} AS style, '' AS decode_error FROM b WHERE trim({_WTEXT}, {_SPACES}) <> ''",
    "wordml_candidates": f"WITH {_BLOCKS} SELECT package_id, count(*) AS n, count(*)::int AS last FROM b WHERE trim({_WTEXT}, {_SPACES}) <> '' AND {_WSTYLE} IN ('Title', 'BodyText', 'JurTerm') GROUP BY 1",
    "wordml_links": f"WITH {_BLOCKS} SELECT package_id, (row_number() OVER (PARTITION BY package_id ORDER BY order_index, block_id) - 1)::int AS ord, 'consultantplus://' || block_id AS dest, coalesce(kind, '') AS link_text, md5({_RAW} || coalesce(kind, '')) AS context_md5, 'internal' AS kind FROM b WHERE order_index % 3 = 0",
    "odt_blocks": f"""WITH {_BLOCKS} SELECT package_id, (row_number() OVER (PARTITION BY package_id ORDER BY order_index, block_id) - 1)::int AS block_ix, CASE WHEN kind = 'heading' THEN 'heading' ELSE 'paragraph' END AS kind, md5(t) AS text_md5,
      CASE WHEN kind = 'heading' THEN 'Heading' WHEN provider_style_id IN ('s9', 's9header') THEN 'ProviderComment' WHEN coalesce(provider_style_id, 'Standard') = 'Standard' THEN 'BodyText' ELSE 'Unknown' END AS style, '' AS decode_error FROM b WHERE {_FULL}""",
    "odt_profile": f"WITH {_BLOCKS} SELECT package_id, coalesce(provider_style_id, '') AS style_id, count(*) AS n_blocks, sum((length(lower(t)) - length(replace(lower(t), 'дел', ''))) // 3)::bigint AS n_marker FROM b GROUP BY 1, 2",
    "edition_names": """WITH e AS (SELECT DISTINCT edition_number AS n, coalesce(revision_date, 'initial') AS r FROM edition_summaries WHERE edition_number IS NOT NULL),
      p AS (SELECT *, 'acts/law_2013-04-05_44-fz/edition-' || lpad(n::varchar, 4, '0') || CASE WHEN n % 5 = 4 THEN '_' ELSE '_rev-' END || r || '_from-x_1f.xml' AS path FROM e)
      SELECT path, CASE WHEN n % 5 = 4 OR contains(r, '/') THEN -1 ELSE n END::bigint AS edition_number, CASE WHEN n % 5 = 4 OR contains(r, '/') THEN '' ELSE r END AS revision, '44-fz' AS act, CASE WHEN n % 5 <> 4 AND regexp_full_match(r, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN r ELSE '' END AS day FROM p""",
    "registry_file": """WITH r AS (SELECT CASE WHEN trim(coalesce(id, ''), ' ') = '' THEN 'missing id' WHEN layer = 'review' THEN 'wrong record_kind' ELSE 'ok' END AS x, id, layer FROM valid_items),
      g AS (SELECT id, count(*) AS k, count(*) FILTER (x = 'wrong record_kind') AS w FROM r WHERE x <> 'missing id' GROUP BY 1)
      SELECT 'missing id' AS diagnostic, count(*) AS n, count(*) AS numbered FROM r WHERE x = 'missing id' HAVING count(*) > 0 UNION ALL SELECT 'duplicate id', sum(k - 1), sum(k - 1) FROM g HAVING sum(k - 1) > 0 UNION ALL SELECT '', count(*), count(*) FROM g HAVING count(*) > 0""",
}
