"""Exact vector retrieval with citations, and answers bounded by evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ids import citation_error
from ..session import ship

TINY = 1e-12
#: Vectors in a block of rows or queries, and hits a task holds before it cuts them to k a query.
BLOCK, HELD = 256, 200_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1], summed in double; 0 if a vector has norm below 1e-12; null for empty or unequal lengths."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    small = (F.sqrt(dot(a, a)) < TINY) | (F.sqrt(dot(b, b)) < TINY)
    value = F.when(small, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm)))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), value)


def top_k(vectors: DataFrame, vec_id: str, embedding: str, query: list[float], k: int, strict: bool = False) -> DataFrame:
    """(id, score): the k best by score, ties by the smaller id. Vectors of another length are left out, or an error if
    ``strict``. One pass: each task keeps k rows."""
    if k < 1 or not query:
        raise ValueError("k and the query must not be empty")
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.col(embedding).isNotNull())
    if strict:
        rows = rows.filter(F.when(F.size(embedding) == len(query), True).otherwise(F.raise_error(F.lit("vector of another length"))))
    scored = rows.select(F.col(vec_id).alias("id"), cosine(F.col(embedding), q).alias("score")).filter("score is not null")
    return scored.orderBy(F.desc("score"), "id").limit(k)


def _blocks(vectors: DataFrame, vec_id: str, embedding: str, block: int, side: str) -> DataFrame:
    """(ids, width, flat) of blocks of about ``block`` vectors of one width; a vector that is null, empty or holds a null is in none."""
    v = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    n = max(1, -(-v.count() // block))
    g = v.groupBy(F.size("v").alias("width"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return g.select(F.col("r.id").alias(f"{side}_ids"), F.col("width").alias(f"{side}_width"), F.flatten("r.v").alias(f"{side}_flat"))


def top_k_batch(vectors: DataFrame, vec_id: str, embedding: str, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, id, score): for each row of ``queries`` (same columns, ids unique) the k best of all ``vectors`` as in top_k.
    Blocks of queries meet blocks of rows, each task keeps k rows a query, and these are merged by query. Sums run in the
    order of the elements, so scores equal those of ``cosine``."""
    if k < 1:
        raise ValueError("k must not be less than 1")
    ship(vectors.sparkSession)
    left, right = _blocks(vectors, vec_id, embedding, block, "r"), _blocks(queries, vec_id, embedding, block, "q")

    def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
        for j in range(a.shape[-1]):
            out += a[..., j] * b[..., j]
        return out

    def best(hits: pd.DataFrame) -> pd.DataFrame:
        return hits.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query", sort=False).head(k)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            for r_ids, rw, r_flat, q_ids, qw, q_flat in pdf[["r_ids", "r_width", "r_flat", "q_ids", "q_width", "q_flat"]].itertuples(index=False):
                if rw != qw:
                    continue
                x, q = np.asarray(r_flat, float).reshape(-1, rw), np.asarray(q_flat, float).reshape(-1, rw)
                with np.errstate(all="ignore"):
                    nx, nq = np.sqrt(dots(x, x)), np.sqrt(dots(q, q))
                    s = np.fmax(0.0, np.fmin(1.0, dots(x[None], q[:, None]) / (nx[None] * nq[:, None])))
                    s[(nx[None] < TINY) | (nq[:, None] < TINY)] = 0.0
                held.append(best(pd.DataFrame({"query": np.repeat(np.asarray(q_ids), len(x)), "id": np.tile(np.asarray(r_ids), len(q)), "score": s.ravel()})))
                size += len(held[-1])
                if size > HELD:
                    held = [best(pd.concat(held))]
                    size = len(held[0])
                    if size > HELD // 2:  # many queries: these leave as they are
                        yield held.pop()
                        size = 0
        if held:
            yield best(pd.concat(held))

    partial = left.crossJoin(right).mapInPandas(score, "query bigint, id bigint, score double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return partial.withColumn("__n", place).filter(F.col("__n") <= k).drop("__n")


def with_labels(hits: DataFrame, nodes: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Append to each hit the labels of nodes whose id stands in its metadata under 'label' (duplicates kept, sorted); hits
    without a match keep an empty list."""
    pairs = hits.select("id", F.explode(metadata).alias("m")).filter("m.k = 'label'").select("id", F.col("m.v").alias("node"))
    labels = pairs.join(nodes.select(F.col("id").alias("node"), "label"), "node").groupBy("id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return hits.join(labels, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def citations(hits: DataFrame, source: str = "vector-store") -> DataFrame:
    """Hits with their citation and its validity."""
    cite = F.concat(F.lit(f"{source}:"), F.col("id").cast("string"))
    return hits.withColumns({"citation": cite, "citation_error": citation_error(F.col("id").cast("string"), cite, F.col("score"))})


def tampered(original: DataFrame, presented: DataFrame, key: str) -> DataFrame:
    """(key, tampered): id or span of the presented citation differs from the original; the score is ignored."""
    o = original.select(key, F.col("record").alias("o_r"), F.col("span").alias("o_s"))
    return o.join(presented.select(key, "record", "span"), key).select(key, (~(F.col("o_r").eqNullSafe(F.col("record")) & F.col("o_s").eqNullSafe(F.col("span")))).alias("tampered"))


def evidence_outcome(requested: DataFrame, evidence: DataFrame, request: str, item: str) -> DataFrame:
    """(request, requested, found, outcome): all items found is answered, some partial, none or an empty request no_answer.
    Items are joined as a set; a null item is an empty request."""
    known = evidence.select(F.col(item).alias("__i")).na.drop().distinct().withColumn("__hit", F.lit(1))
    joined = requested.select(request, F.col(item).alias("__i")).join(known, "__i", "left")
    sums = joined.groupBy(request).agg(F.count("__i").alias("requested"), F.count("__hit").alias("found"))
    return sums.withColumn("outcome", F.when((F.col("requested") == 0) | (F.col("found") == 0), "no_answer").when(F.col("found") == F.col("requested"), "answered").otherwise("partial"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert view of an append-only log: the last row of each key by ``order``. Keys of edges are (source, target): a new
    label overwrites the old one."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*key, "__r.*")


def by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.col("label") == label)


def embedding_outcome(model: Column, wanted_model: str, width: Column, wanted_width: int, vector: Column, transport_ok: Column) -> Column:
    """Checks of an embedding response in order: model, dimension, transport, response dimension, finite values."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(model != wanted_model, "model drift").when(width != wanted_width, "dimension").when(~transport_ok, "transport")
        .when(vector.isNull() | (F.size(vector) != wanted_width), "response dimension").when(odd, "not finite").otherwise("ok")
    )
