"""Fielded BM25, rank fusion, features, and the reranking cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import index_terms
from quarry.operators.index import idf, saturated

WEIGHTS = {"body": 1.0, "title": 3.0, "anchor": 2.0, "url": 1.5}
K1, B = 1.2, 0.75
FEATURES = ("bm25", "dense", "proximity", "exact", "length", "pagerank", "authority", "spam", "freshness", "click_rate", "dwell")
SCHEMA_VERSION = 1


def field_postings(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """doc_id, field, term, tf of text columns named after their fields."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in fields]))
    rows = docs.select(F.col(key).alias("doc_id"), each.alias("x")).select("doc_id", "x.field", F.explode(index_terms(F.col("x.text"))).alias("term"))
    return rows.groupBy("doc_id", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def field_lengths(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """doc_id, field, len: every document has every field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(index_terms(F.coalesce(F.col(f), F.lit("")))).alias("len")) for f in fields]))
    return docs.select(F.col(key).alias("doc_id"), each.alias("x")).select("doc_id", "x.field", "x.len")


def _by_field(values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in values.items():
        out = F.when(F.col("field") == name, F.lit(value)).otherwise(out)
    return out


def pseudo_frequencies(posts: DataFrame, lengths: DataFrame, weights: dict[str, float] = WEIGHTS, b: float = B) -> DataFrame:
    """doc_id, term, eff: weighted frequencies, normalised by each field's length, summed over fields.

    Average lengths are one row for each field, broadcast. A zero average or norm becomes 1.
    """
    mean = lengths.groupBy("field").agg(F.avg("len").alias("mean"))
    joined = posts.join(lengths, ["doc_id", "field"]).join(F.broadcast(mean), "field")  # as many rows as fields
    norm = (1 - b) + b * F.col("len") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    part = _by_field(weights) * F.col("tf") / F.when(norm > 0, norm).otherwise(1.0)
    return joined.groupBy("doc_id", "term").agg(F.sum(part).alias("eff"))


def bm25f(pseudo: DataFrame, terms: DataFrame, df: DataFrame, n_docs: int, k1: float = K1) -> DataFrame:
    """doc_id, score over the query's terms (rows of `term`; a repeated one counts twice)."""
    weighed = terms.join(df, "term").withColumn("idf", idf(n_docs, F.col("df")))
    return pseudo.join(weighed, "term").groupBy("doc_id").agg(F.sum(saturated(F.col("idf"), F.col("eff"), k1)).alias("score"))


def rrf(lists: DataFrame, k: int = 60, keys: tuple[str, ...] = ("segment", "local")) -> DataFrame:
    """Sum over lists of 1 / (k + rank0 + 1); a k of 0 or less is 60."""
    k = k if k > 0 else 60
    return lists.groupBy(*keys).agg(F.sum(F.lit(1.0) / (F.lit(float(k + 1)) + F.col("rank0"))).alias("score"))


def linear_fusion(lists: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("segment", "local")) -> DataFrame:
    """Scores scaled to [0, 1] in each list (a list of equal scores has 1), weighed and summed; lists of weight 0 or none are left out."""
    spans = lists.groupBy("list_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    used = lists.join(spans, "list_id").join(weights.where("weight <> 0"), "list_id")
    scaled = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    return used.groupBy(*keys).agg(F.sum(scaled * F.col("weight")).alias("score"))


def ranks(results: DataFrame, by: list, group: str = "list_id", out: str = "rank0") -> DataFrame:
    """Places from 0 in each query's list, which is short; ordered.places is for lists of a whole corpus."""
    return results.withColumn(out, (F.row_number().over(Window.partitionBy(group).orderBy(*by)) - 1).cast("long"))


def feature_vector(rows: DataFrame) -> DataFrame:
    """doc_id and the eleven features in their fixed order; what is missing is 0."""
    return rows.select("doc_id", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def linear_model(features: Column, weights: list[float], bias: float) -> Column:
    """bias plus the dot product over the overlap of lengths."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    n = F.least(F.size(features), F.size(w))
    return F.aggregate(F.zip_with(F.slice(features, 1, n), F.slice(w, 1, n), lambda x, y: x * y), F.lit(float(bias)), lambda s, x: s + x)


def check_model(dimension: int) -> bool:
    return dimension == len(FEATURES)


def rerank(cands: DataFrame, k: int, least: int = 50, group: str = "query_id") -> DataFrame:
    """Top k of each query by model score, if its pool has `least` candidates; else in first-stage order with score 0."""
    pool = cands.groupBy(group).agg(F.count(F.lit(1)).alias("_pool"))
    sized = cands.join(pool, group).withColumn("reranked", F.col("_pool") >= least)
    order = Window.partitionBy(group).orderBy(F.when(F.col("reranked"), -F.col("model_score")).otherwise(F.col("stage_rank").cast("double")), "segment", "local")
    placed = sized.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.withColumn("score", F.when(F.col("reranked"), F.col("model_score")).otherwise(0.0)).drop("_pool")
