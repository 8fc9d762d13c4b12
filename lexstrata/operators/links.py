"""Links: extraction, classification, profiles, edges, observations, catalog lookups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V
from ..session import ship


def extract_links(df: DataFrame, keys: list[str], xml: str, tag: str = "w:hlink", attribute: str = "w:dest", paragraph: str = "w:p", run: str = "w:t") -> DataFrame:
    """(keys, ord, dest, link_text, context): each link element with its text and the text from the last opening of a paragraph
    before it to the next end of one, so that links outside a paragraph have a context too. Entities stay undecoded;
    elements without the attribute are left out."""
    ship(df.sparkSession)
    source = df.select(*keys, F.col(xml).alias("__x")).filter("__x <> ''")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", ord int, dest string, link_text string, context string"
    link = re.compile(rf"<{tag}\b([^>]*)>(.*?)</{tag}>", re.S)
    target, runs = re.compile(rf'{attribute}="([^"]*)"'), re.compile(rf"<{run}(?: [^>]*)?>(.*?)</{run}>", re.S)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for r, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                n = 0
                for m in link.finditer(text):
                    if dest := target.search(m.group(1)):
                        begin, end = text.rfind(f"<{paragraph}", 0, m.start()), text.find(f"</{paragraph}>", m.start())
                        context = text[max(begin, 0) : end if end >= 0 else len(text)]
                        rows.append(r)
                        for c, v in zip(cols, (n, dest.group(1), "".join(runs.findall(m.group(2))), "".join(runs.findall(context)))):
                            c.append(v)
                        n += 1
            keyed = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keyed, pa.array(cols[0], pa.int32()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=[*batch.schema.names[:-1], "ord", "dest", "link_text", "context"])

    return source.mapInArrow(find, ddl)


def link_kind(dest: Column, scheme: str = "consultantplus://") -> Column:
    return F.when(dest.startswith(scheme), "internal").when(dest.startswith("http"), "external").otherwise("other")


def _bound(c: Column, use) -> Column:
    """``use(c)`` with c computed once a row; as an ordinary expression it would be computed anew for every needle."""
    return F.transform(F.array(c), use)[0]


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def classify_first(context: Column, rules: list[tuple[str, str, float]] | None = None) -> tuple[Column, Column]:
    """(kind, confidence) by the first rule in order whose needle occurs in the lower-cased context; else unknown, 0.1.
    A generated CASE, no join."""
    rules = rules or V.LINK_RULES

    def first(low: Column) -> Column:
        at = F.lit(0)
        for i in range(len(rules), 0, -1):
            at = F.when(F.contains(low, F.lit(rules[i - 1][1].lower())), i).otherwise(at)
        return at

    found = _bound(_low(context), first)
    return F.element_at(F.array(F.lit("unknown"), *[F.lit(r[0]) for r in rules]), found + 1), F.element_at(F.array(F.lit(0.1), *[F.lit(r[2]) for r in rules]), found + 1)


def template_score(context: Column, template: tuple[str, str, float, str, list[str], list[str]]) -> Column:
    """'all': every signal must occur for the full confidence; 'any': confidence times the share of matched signals. The
    morphological variants are one signal."""
    return _template_score(_low(context), template)


def _template_score(low: Column, template: tuple[str, str, float, str, list[str], list[str]]) -> Column:
    _, _, confidence, match, needles, variants = template
    signals = [F.contains(low, F.lit(n.lower())) for n in needles]
    if variants:
        one = F.lit(False)
        for v in variants:
            one = one | F.contains(low, F.lit(v.lower()))
        signals.append(one)
    hits = sum((s.cast("int") for s in signals), F.lit(0))
    return F.when(hits == len(signals), confidence).otherwise(0.0) if match == "all" else hits / F.lit(float(len(signals))) * F.lit(confidence)


def classify_scored(context: Column, templates: list | None = None, baseline: float = 0.1) -> tuple[Column, Column]:
    """(kind, confidence) of the best template; it must beat the baseline strictly and ties keep the earlier one."""
    templates = templates or V.LINK_TEMPLATES
    # The greatest of (score, -place): the baseline has place 0, so a template must beat it and ties keep the earlier one.
    scores = _bound(_low(context), lambda low: F.array(*[_template_score(low, t) for t in templates]))
    ranked = F.transform(scores, lambda x, i: F.struct(x.alias("score"), (-i - 1).alias("place")))
    best = F.array_max(F.concat(F.array(F.struct(F.lit(float(baseline)).alias("score"), F.lit(0).alias("place"))), ranked))
    return F.element_at(F.array(F.lit("unknown"), *[F.lit(t[1]) for t in templates]), 1 - best["place"]), best["score"]


def profile(path: Column, profiles: list | None = None) -> tuple[Column, Column]:
    """(name, boost) of the first profile with a needle in the lower-cased path; the last one is the default."""
    profiles = profiles or V.PROFILES
    low = F.lower(F.coalesce(path, F.lit("")))
    name, boost = F.lit(profiles[-1][0]), F.lit(profiles[-1][2])
    for n, needles, b in reversed(profiles[:-1]):
        hit = F.lit(False)
        for x in needles:
            hit = hit | F.contains(low, F.lit(x))
        name, boost = F.when(hit, n).otherwise(name), F.when(hit, b).otherwise(boost)
    return name, boost


def boosted(kind: Column, confidence: Column, boost: Column) -> Column:
    return F.when(kind == "unknown", confidence).otherwise(confidence * boost)


def derive_edges(links: DataFrame, source: str, dest: str, kind: str, provenance: str) -> DataFrame:
    """(edge_from, edge_to, kind, provenance): unknown links drop out, an amendment runs from the linked act to the source."""
    turned = F.col(kind) == "amends"
    return links.filter(F.col(kind) != "unknown").select(
        F.when(turned, F.col(dest)).otherwise(F.col(source)).alias("edge_from"), F.when(turned, F.col(source)).otherwise(F.col(dest)).alias("edge_to"), F.col(kind).alias("kind"), F.col(provenance).alias("provenance")
    )


def observations(unknown: DataFrame, text: str, context: str, dest: str, order: str) -> DataFrame:
    """(link_text, n, first_context, n_dests) by count downwards, then text: null texts are left out."""
    g = unknown.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("link_text"))
    return g.agg(F.count("*").alias("n"), F.min_by(context, order).alias("first_context"), F.count_distinct(dest).alias("n_dests")).orderBy(F.desc("n"), "link_text")


def edition_counts(classified: DataFrame, by: list[str], kinds: list[str] | None = None) -> DataFrame:
    kinds = kinds or ["amends", "cites", "implements", "specifies", "unknown"]
    return classified.groupBy(*by).agg(F.count("*").alias("n_links"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def edition_deltas(counts: DataFrame, by: list[str], edition: str, columns: list[str]) -> DataFrame:
    """Difference of each count to the edition before, null for the first."""
    order = W.partitionBy(*by).orderBy(edition)
    return counts.select(*by, edition, *[(F.col(c) - F.lag(c).over(order)).alias(f"d_{c}") for c in columns])


def catalog_lookup(locators: DataFrame, documents: DataFrame, editions: DataFrame) -> DataFrame:
    """(uri, outcome, title, edition_id): locators (uri, source_id), documents (source_id, title), editions (source_id,
    edition_id, edition_number, revision_date). The latest edition by number (null as 0), then date, then id; a document
    without title is an error, an unknown source a miss. One aggregation by source instead of a sort."""
    rank = F.struct(F.coalesce("edition_number", F.lit(0)).alias("a"), F.coalesce(F.col("revision_date").cast("string"), F.lit("")).alias("b"), F.col("edition_id").alias("c"))
    latest = editions.groupBy("source_id").agg(F.max_by("edition_id", rank).alias("edition_id"))
    docs = documents.select("source_id", "title", F.lit(True).alias("known"))
    joined = locators.join(docs, "source_id", "left").join(latest, "source_id", "left")
    outcome = F.when(F.col("known").isNull(), "missing").when(F.coalesce(F.trim("title"), F.lit("")) == "", "error: no title").otherwise("found")
    return joined.select("uri", outcome.alias("outcome"), "title", "edition_id")


def marked_lookup(requested: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Left outer join with a miss marker: every requested row with in_catalog; a blank id is an error."""
    known = catalog.select(key).na.drop().distinct().withColumn("__in", F.lit(True))
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    return requested.join(known, key, "left").select(*requested.columns, F.coalesce("__in", F.lit(False)).alias("in_catalog"), F.when(blank, "empty id").otherwise("").alias("error"))


def coverage_summary(looked_up: DataFrame) -> DataFrame:
    """(resolved, total) of marked_lookup's rows."""
    return looked_up.agg(F.count_if("in_catalog").alias("resolved"), F.count("*").alias("total"))


def golden_relations(items: DataFrame) -> DataFrame:
    """Explicit amendments with a text: items (item_id, relation_type, raw_tooltip, normalization_status)."""
    return items.filter("relation_type = 'amends' and normalization_status = 'explicit' and length(raw_tooltip) > 0").select("item_id", "relation_type", "raw_tooltip")


def plain_titles(documents: DataFrame, most: int) -> DataFrame:
    """(source_id, title) of normative documents that amend nothing by their title, the first ``most`` by source_id: the limit
    is the sample's."""
    amending = "внесении изменений|внесении изменения|внести изменения|внести изменение"
    return documents.filter((F.col("kind") == "normative") & F.col("title").isNotNull() & ~F.col("title").rlike(amending)).select("source_id", "title").orderBy("source_id").limit(most)


def measured(golden: DataFrame, negatives: DataFrame, hit: str) -> DataFrame:
    """(hits, misses, false_positives, recall, precision) of a rule's boolean column over positives and negatives."""
    g = golden.agg(F.count_if(hit).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
    n = negatives.agg(F.count_if(hit).alias("false_positives"))
    total, found = F.col("hits") + F.col("misses"), F.col("hits") + F.col("false_positives")
    return g.join(n, F.lit(True)).withColumns({"recall": F.when(total > 0, F.col("hits") / total).otherwise(F.lit(1.0)), "precision": F.when(found > 0, F.col("hits") / found).otherwise(F.lit(1.0))})


def ranked_needles(fields: dict[str, Column], needles: list[tuple[str, str, str, int]]) -> Column:
    """Struct (outcome, value, conflicts): the group of the lowest rank whose needle occurs in its field, case ignored; several
    groups of that rank are a conflict, none is unknown. All expressions: the needles are a fixed list, no join."""
    hits = [F.when(F.contains(F.lower(F.coalesce(fields[f], F.lit(""))), F.lit(n.lower())), F.struct(F.lit(r).alias("rank"), F.lit(g).alias("value"))) for g, f, n, r in needles if f in fields]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    lowest = F.array_min(F.transform(found, lambda x: x["rank"]))
    best = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["rank"] == lowest), lambda x: x["value"])))
    none = F.array().cast("array<string>")
    return (
        F.when(F.size(found) == 0, F.struct(F.lit("unknown").alias("outcome"), F.lit("").alias("value"), none.alias("conflicts")))
        .when(F.size(best) > 1, F.struct(F.lit("conflict").alias("outcome"), F.lit("").alias("value"), best.alias("conflicts")))
        .otherwise(F.struct(F.lit("found").alias("outcome"), best[0].alias("value"), none.alias("conflicts")))
    )
