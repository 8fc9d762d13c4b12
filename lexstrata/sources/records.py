"""Registry lines, packet and ledger folders, catalogs, and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dates import edition_file


def registry_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, line, id, record, diagnostic): JSON lines with blank ones left out; malformed, no object, no id, wrong
    record_kind, or duplicate id, whose record is kept."""
    text = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("record"))
    # Numbers in two levels, the blocks of a file and the lines of a block, so that a large file stays many tasks.
    blocks = text.groupBy("path", "b").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("path").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = text.withColumn("i", F.row_number().over(W.partitionBy("path", "b").orderBy("m")))
    lines = inside.join(blocks.select("path", "b", before.alias("base")), ["path", "b"]).select("path", (F.col("base") + F.col("i")).cast("int").alias("line"), "record").filter(F.trim("record") != "")
    v = F.try_parse_json("record")
    rows = lines.withColumns({"id": F.try_variant_get(v, "$.id", "string"), "k": F.try_variant_get(v, "$.record_kind", "string"), "t": F.schema_of_variant(v)})
    firsts = rows.groupBy("id").agg(F.min(F.struct("path", "line")).alias("first"))
    rows = rows.join(firsts.filter("id is not null"), "id", "left")
    again = F.struct("path", "line") > F.col("first")
    why = (
        F.when(v.isNull(), "malformed").when(~F.col("t").startswith("OBJECT"), "not an object").when(F.coalesce(F.trim("id"), F.lit("")) == "", "missing id")
        .when(F.col("k").isNotNull() & (F.col("k") != kind), "wrong record_kind").when(again, "duplicate id").otherwise("")
    )
    return rows.select("path", "line", "id", "record", why.alias("diagnostic"))


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON text a file, as (path, payload) for operators.nested.flatten."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def edition_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, edition_number, revision, content) of edition files in order; other names are skipped."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "edition-*.xml").load(folder).withColumn("e", edition_file(F.col("path")))
    return f.filter("e is not null").select("path", "e.*", "content")


def catalog_table(spark: SparkSession, url: str, name: str, driver: str | None = None) -> DataFrame:
    """A table of a catalog database over JDBC, read only."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    return (reader.option("driver", driver) if driver else reader).load()


def append_ledger(batch: DataFrame, path: str) -> None:
    """Single-writer append, for foreachBatch: parquet gives no atomicity between writers."""
    batch.write.mode("append").parquet(path)


def json_report(*columns: str) -> Column:
    """One compact object a row."""
    return F.to_json(F.struct(*columns))


def patch_lines(kind: Column, fingerprint: Column, token: Column, n: Column) -> Column:
    """One line of a patch file."""
    return F.format_string("- {kind: %s, fingerprint: %s, token: %s, count: %d}", kind, fingerprint, token, n)


def parse_patch(line: Column) -> Column:
    """Struct (kind, fingerprint, token, count, error) of such a line."""
    p = r"^- \{kind: (\w+), fingerprint: (fnv1a64:[0-9a-f]{16}), token: ([^,}]+), count: (\d{1,18})\}$"
    ok = F.coalesce(line.rlike(p), F.lit(False))
    part = [F.when(ok, F.regexp_extract(line, p, k)) for k in range(1, 5)]
    return F.struct(part[0].alias("kind"), part[1].alias("fingerprint"), part[2].alias("token"), part[3].cast("bigint").alias("count"), F.when(ok, "").otherwise("malformed").alias("error"))


def observations_report(observations: DataFrame, most: int = 50) -> DataFrame:
    """(line): the most frequent groups as lines, and a line with the number of those left out. The limit is the report's."""
    line = F.format_string("- {text: %s, count: %d, dests: %d}", "link_text", "n", "n_dests")
    top = observations.orderBy(F.desc("n"), "link_text").limit(most).select(line.alias("line"))
    rest = observations.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("k")).select(F.format_string("omitted: %d", "k").alias("line"))
    return top.unionByName(rest)
