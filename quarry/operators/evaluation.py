"""Relevance and answer metrics, and the gates that hold them against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import total_before


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """ranked (query_id, doc_id, rank from 1) with each row's grade, 0 where none is given."""
    return ranked.join(qrels, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _gain(grade: Column, rank: Column) -> Column:
    return F.when(grade > 0, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)).otherwise(F.lit(0.0))


def relevance(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, dcg, ndcg, mrr, recall, ap of every query in ranked or qrels, from one pass over each."""
    rows = judged(ranked, qrels).withColumn("hit", (F.col("grade") > 0).cast("int"))
    rows = rows.withColumn("hits", F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.col("rank") <= k
    got = rows.groupBy("query_id").agg(
        F.sum(F.when(inside, _gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"), F.min(F.when(inside & (F.col("hit") == 1), F.col("rank"))).alias("first"),
        F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias("found"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(inside & (F.col("hit") == 1), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions_k"),
    )
    ideal = qrels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, _gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias("ideal"), F.sum((F.col("grade") > 0).cast("int")).alias("relevant"))
    both = got.join(ideal, "query_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id", zero(F.col("dcg")).alias("dcg"), zero(F.try_divide("dcg", "ideal")).alias("ndcg"), zero(F.lit(1.0) / F.col("first")).alias("mrr"),
        zero(F.try_divide("found", "relevant")).alias("recall"), zero(F.try_divide("precisions", "relevant")).alias("ap"), zero(F.try_divide("precisions_k", "found")).alias("context_precision"),
    )


def fractions(flags: dict[str, Column]) -> list[Column]:
    """Shares of true flags in a group; 1 where there are none."""
    return [F.coalesce(F.avg(c.cast("int")), F.lit(1.0)).alias(name) for name, c in flags.items()]


def f1(recall: Column, precision: Column) -> Column:
    return F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))


def gate(report: DataFrame, baseline: dict[str, float], tolerance: float) -> DataFrame:
    """metric, baseline, got, message of what is below its baseline by more than the tolerance, in the baseline's order."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric"), F.lit(b).alias("baseline"), F.col(m).alias("got")) for i, (m, b) in enumerate(baseline.items())]))
    rows = report.select(each.alias("x")).select("x.*").where(F.col("got") < F.col("baseline") - tolerance)
    return rows.select("metric", "baseline", "got", F.format_string("%s fell from %.4f to %.4f", "metric", "baseline", "got").alias("message"))


def nearest_rank(values: DataFrame, q: float, value: str = "x") -> DataFrame:
    """x at place floor(q (n - 1) + 0.5) of the sorted values; q outside [0, 1] is the nearer end, an empty table gives 0.

    A value and its count are one row; their running count is by range.
    """
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    place = int(min(max(q, 0.0), 1.0) * (total - 1) + 0.5) if total else 0
    running = total_before(counts, [value], "n", "before")
    return running.where(F.col("before") + F.col("n") > place).agg(F.coalesce(F.min(value), F.lit(0)).alias(value))
