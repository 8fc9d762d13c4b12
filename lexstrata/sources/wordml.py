"""WordML documents: paragraphs with styles and byte spans, and their hyperlinks.

A document is read whole by one streaming XML parser inside a task. Any XML error fails the document: it gives one row with
``decode_error`` and no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import fnv1a64
from ..session import ship

BLOCKS = "doc string, block_ix int, text string, provider_style_id string, style string, src_start bigint, src_end bigint, decode_error string"
STYLES = {**dict.fromkeys(("0", "1", "4", "7", "8"), "BodyText"), "2": "Title", "5": "Title", "3": "TableCell", "6": "JurTerm"}


def paragraph_style(style_id: Column) -> Column:
    return F.when(style_id.isNull(), "BodyText").otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv]), style_id), F.lit("Unknown")))


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def parse(content: bytes) -> list[tuple[int, str, str | None, int, int]]:
    """(index, text, style id, start, end) of paragraphs that aren't blank; raises on malformed XML."""
    out: list[tuple[int, str, str | None, int, int]] = []
    stack: list[str] = []
    state: dict = {"p": None}
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def begin(name: str, attrs: dict[str, str]) -> None:
        tag = _local(name)
        stack.append(tag)
        if tag == "p" and state["p"] is None:
            state["p"] = {"start": parser.CurrentByteIndex, "text": [], "style": None, "depth": len(stack)}
        elif tag == "pStyle" and state["p"] is not None:
            state["p"]["style"] = next((v for k, v in attrs.items() if _local(k) == "val"), None)

    def data(text: str) -> None:
        if state["p"] is not None and stack and stack[-1] == "t" and "binData" not in stack:
            state["p"]["text"].append(text)

    def finish(name: str) -> None:
        p = state["p"]
        if p is not None and len(stack) == p["depth"]:
            close = content.index(b">", parser.CurrentByteIndex) + 1
            text = "".join(p["text"])
            if text.strip():
                out.append((len(out), text, p["style"], p["start"], close))
            state["p"] = None
        stack.pop()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, finish, data
    parser.Parse(content, True)
    return out


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    for batch in batches:
        for doc, content in zip(batch["doc"], batch["content"]):
            try:
                rows = [(doc, i, t, s, "", a, z, None) for i, t, s, a, z in parse(bytes(content))]
            except Exception as e:  # noqa: BLE001 - the outcome is a row
                rows = [(doc, -1, None, None, "", None, None, f"malformed: {e}"[:240])]
            yield pd.DataFrame(rows, columns=names)


def blocks(documents: DataFrame) -> DataFrame:
    """Blocks of documents (doc, content binary)."""
    ship(documents.sparkSession)
    out = documents.select("doc", "content").mapInPandas(_decode, BLOCKS)
    return out.withColumn("style", F.when(F.col("decode_error").isNull(), paragraph_style(F.col("provider_style_id"))))


def read(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Documents of a folder as (doc, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("doc"), "content")


def candidates(blocks_df: DataFrame) -> DataFrame:
    """Structural blocks as (doc, candidate, anchor, fingerprint), numbered in document order."""
    n = F.row_number().over(W.partitionBy("doc").orderBy("block_ix")).cast("string")
    return blocks_df.filter("decode_error is null and style in ('Title', 'BodyText', 'JurTerm')").select("doc", F.concat(F.lit("cand:"), n).alias("candidate"), F.concat(F.lit("anchor:"), n).alias("anchor"), fnv1a64(F.col("text")).alias("fingerprint"))
