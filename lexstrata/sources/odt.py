"""ODT packages: bounded intake, then headings and paragraphs of content.xml.

Limits are parameters. A package that breaks one, or whose content is malformed, gives one row with ``decode_error``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

BLOCKS = "doc string, block_ix int, kind string, text string, provider_style_id string, decode_error string"
TEXT, OFFICE = "urn:oasis:names:tc:opendocument:xmlns:text:1.0", "urn:oasis:names:tc:opendocument:xmlns:office:1.0"


@dataclass(frozen=True)
class Limits:
    package: int = 16 << 20
    entries: int = 16
    content: int = 8 << 20
    block: int = 1 << 20
    spaces: int = 64


def content_xml(package: bytes, limits: Limits) -> bytes:
    if len(package) > limits.package:
        raise ValueError("package too large")
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        infos = z.infolist()
        names = [i.filename for i in infos]
        if len(names) > limits.entries:
            raise ValueError("too many entries")
        if len(set(names)) < len(names):
            raise ValueError("duplicate entry")
        if any(n.startswith("/") or "\\" in n or ".." in n.split("/") for n in names):
            raise ValueError("unsafe name")
        if any(i.volume for i in infos):
            raise ValueError("more than one disk")
        info = next((i for i in infos if i.filename == "content.xml"), None)
        if info is None:
            raise ValueError("no content.xml")
        with z.open(info) as f:  # the stated size isn't trusted
            data = f.read(limits.content + 1)
        if len(data) > limits.content:
            raise ValueError("content too large")
        return data


def parse(xml: bytes, limits: Limits, keep_empty: bool = False) -> list[tuple[str, str, str | None]]:
    """(kind, text, style) of p and h elements inside the document's text body."""
    out: list[tuple[str, str, str | None]] = []
    stack: list[str] = []
    block: dict = {}
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def refuse(*_: object) -> None:
        raise ValueError("DOCTYPE or CDATA")

    def body() -> bool:
        return stack[:3] == [f"{OFFICE} document-content", f"{OFFICE} body", f"{OFFICE} text"]

    def begin(name: str, attrs: dict[str, str]) -> None:
        if body() and name in (f"{TEXT} p", f"{TEXT} h") and not block:
            block.update(kind="heading" if name.endswith(" h") else "paragraph", text=[], style=attrs.get(f"{TEXT} style-name"), depth=len(stack) + 1)
        elif block and name == f"{TEXT} s":
            n = int(attrs.get(f"{TEXT} c", "1"))
            if not 1 <= n <= limits.spaces:
                raise ValueError("space count")
            block["text"].append(" " * n)
        stack.append(name)

    def data(text: str) -> None:
        if block:
            block["text"].append(text)

    def finish(name: str) -> None:
        if block and len(stack) == block["depth"]:
            text = "".join(block["text"])
            if len(text.encode()) > limits.block:
                raise ValueError("block too large")
            if keep_empty or text.strip():
                out.append((block["kind"], text, block["style"]))
            block.clear()
        stack.pop()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, finish, data
    parser.StartDoctypeDeclHandler = parser.StartCdataSectionHandler = refuse
    parser.Parse(xml, True)
    return out


def style(kind: Column, style_id: Column) -> Column:
    return F.when(kind == "heading", "Heading").when(style_id.isin("s9", "s9header"), "ProviderComment").when(style_id.isNull() | (style_id == "Standard"), "BodyText").otherwise("Unknown")


def blocks(packages: DataFrame, limits: Limits = Limits(), keep_empty: bool = False) -> DataFrame:
    """Blocks of packages (doc, content binary) with their style."""
    ship(packages.sparkSession)
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc"], batch["content"]):
                try:
                    rows = [(doc, i, k, t, s, None) for i, (k, t, s) in enumerate(parse(content_xml(bytes(content), limits), limits, keep_empty))]
                except Exception as e:  # noqa: BLE001 - the outcome is a row
                    rows = [(doc, -1, None, None, None, f"{type(e).__name__}: {e}"[:240])]
                yield pd.DataFrame(rows, columns=names)

    return packages.select("doc", "content").mapInPandas(run, BLOCKS).withColumn("style", F.when(F.col("decode_error").isNull(), style(F.col("kind"), F.col("provider_style_id"))))


def smoke_profile(block_rows: DataFrame, markers: list[str]) -> DataFrame:
    """(doc, style, n_blocks, n_empty, counts of markers): lower-cased, not overlapping occurrences."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    count = {f"n_marker_{i}": ((F.length(low) - F.length(F.replace(low, F.lit(m.lower()), F.lit("")))) / len(m)).cast("bigint") for i, m in enumerate(markers)}
    cols = block_rows.withColumns(count)
    return cols.groupBy("doc", F.coalesce("provider_style_id", F.lit("")).alias("style_id")).agg(F.count("*").alias("n_blocks"), F.count_if(F.trim("text") == "").alias("n_empty"), *[F.sum(c).alias(c) for c in count])
