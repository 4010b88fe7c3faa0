"""Rates, errors and durations; spans."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import mix64
from quarry.operators.ordered import shared_table

BOUNDS = (2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)
OTHER, MOST = "_OTHER", 512


def bucket(ms: Column) -> Column:
    """The first bound that is ms or more; the number of bounds for those above all."""
    out = F.lit(len(BOUNDS))
    for i in reversed(range(len(BOUNDS))):
        out = F.when(ms <= BOUNDS[i], i).otherwise(out)
    return out


def status(error: Column) -> Column:
    return F.when(error.isNull(), "OK").when(error.isin("deadline_exceeded", "canceled"), error).otherwise("error")


def histogram(calls: DataFrame) -> DataFrame:
    """method, status, bucket, n, total of (method, ms, error)."""
    return calls.groupBy("method", status(F.col("error")).alias("status"), bucket(F.col("ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total"))


def capped(calls: DataFrame, allowed: list[str], most: int = MOST) -> DataFrame:
    """method of each call, folded: off the list, or of a series (method, status) that arrives (seq) when most - 4 are there."""
    named = calls.withColumn("m", F.when(F.col("method").isin(*allowed), F.col("method")).otherwise(OTHER)).withColumn("status", status(F.col("error")))
    series = named.groupBy("m", "status").agg(F.min("seq").alias("since"))  # few beside calls
    series = series.withColumn("n", F.row_number().over(Window.orderBy("since"))).withColumn("kept", F.when(F.col("n") <= max(most - 4, 0), F.col("m")).otherwise(OTHER))
    return named.join(series.select("m", "status", "kept"), ["m", "status"]).select("seq", F.col("kept").alias("method"), "status")


def error_rates(calls: DataFrame) -> DataFrame:
    return calls.groupBy("method").agg(F.avg((status(F.col("error")) != "OK").cast("int")).alias("rate"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """method, x: linear inside the bucket where the running count reaches q of all; the last bound for those above all."""
    rows = hist.groupBy("method", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("method")
    rows = rows.withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("target", F.sum("n").over(by) * F.lit(q))
    hit = rows.where(F.col("upto") >= F.col("target")).groupBy("method").agg(F.min_by(F.struct("bucket", "n", "upto", "target"), "bucket").alias("h")).select("method", "h.*")
    bounds = F.array(*[F.lit(b) for b in (0.0, *BOUNDS)])
    low, high = F.element_at(bounds, F.least(F.col("bucket"), F.lit(len(BOUNDS) - 1)) + 1), F.element_at(bounds, F.least(F.col("bucket"), F.lit(len(BOUNDS) - 1)) + 2)
    inside = low + (high - low) * (F.col("target") - (F.col("upto") - F.col("n"))) / F.col("n")
    return hit.select("method", F.when(F.col("bucket") >= len(BOUNDS), F.lit(BOUNDS[-1])).otherwise(inside).alias("x"))


def depths(spans: DataFrame) -> DataFrame:
    """span, depth of (span, parent): 0 for roots, whose parent is null. Spans join to the level above them until a level is empty.

    A level is a table in the shared folder, so there is no limit on rows or levels, as there is on recursive SQL.
    Spans that no root leads to have no depth.
    """
    level, out = shared_table(spans.where("parent IS NULL").select("span"), "spans"), []
    while not level.isEmpty():
        out.append(level.withColumn("depth", F.lit(len(out))))
        level = shared_table(spans.join(level.withColumnRenamed("span", "parent"), "parent").select("span"), "spans")
    return reduce(DataFrame.unionByName, out, level.withColumn("depth", F.lit(0)))


def tail_kept(spans: DataFrame, slow: float) -> DataFrame:
    """Spans that are sampled, failed, or slow if slow is above 0."""
    return spans.where(F.col("sampled") | F.col("failed") | ((F.col("ms") >= slow) & F.lit(slow > 0)))


def ratio_sampled(spans: DataFrame, ratio: float, key: str = "trace_id") -> DataFrame:
    def keep(batches):
        for batch in batches:
            share = mix64(batch[key].to_numpy().astype(np.int64).view(np.uint64)).astype(float) / float(2**64 - 1)
            yield pd.DataFrame({key: batch[key], "sampled": (share < ratio) if 0 < ratio < 1 else np.full(len(batch), ratio >= 1)})

    return spans.select(key).mapInPandas(keep, f"{key} long, sampled boolean")


def injected(trace: Column, span: Column, sampled: Column) -> Column:
    return F.map_from_arrays(F.array(F.lit("trace"), F.lit("span"), F.lit("sampled")), F.array(trace.cast("string"), span.cast("string"), sampled.cast("string")))


def extracted(carrier: Column) -> Column:
    """struct(trace, span, sampled, valid); ids that are absent, bad or 0 make it invalid."""
    number = lambda k: F.try_element_at(carrier, F.lit(k)).try_cast("long")
    trace, span = number("trace"), number("span")
    valid = F.coalesce((trace != 0) & (span != 0), F.lit(False))
    flag = F.coalesce(F.try_element_at(carrier, F.lit("sampled")).isin("true", "1"), F.lit(False))
    return F.struct(F.when(valid, trace).alias("trace"), F.when(valid, span).alias("span"), (valid & flag).alias("sampled"), valid.alias("valid"))
