"""Running totals and folds over an order, without bringing all rows into one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, in the session or the application. A temporary one only where all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="quarry-"))
        found = _fallback[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the folder the cluster shares and read it back: lineage ends there, and a lost executor costs one step."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. Results that weren't written elsewhere can't be read after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def total_before(df: DataFrame, order: list[str], value: str | None, out: str) -> DataFrame:
    """The sum of `value` (of ones if None) over all rows before each in the order.

    Rows are dealt by range; each range's total and the sums inside it are found apart, and only the totals, a row
    for each range, meet in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    add = F.col(value) if value else F.lit(1).cast("long")
    dealt = shared_table(shared_table(df.withColumn("_add", add), "ordered").repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum("_add").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_sum", F.coalesce(F.sum("_add").over(inside), F.lit(0))).join(F.broadcast(starts), "_range")  # a row for each range
    return summed.withColumn(out, F.col("_start") + F.col("_sum")).drop("_add", "_range", "_sum", "_start")


def places(df: DataFrame, group: str, by: list, out: str) -> DataFrame:
    """Places from 0 within each group in the order of `by`, for groups that may hold most of the rows.

    Rows are dealt by range over (group, by), so a large group is spread over many tasks; each numbers what it has,
    and a count for each group and range says where it begins.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared_table(shared_table(df, "placed").repartitionByRange(n, group, *by).withColumn("_range", F.spark_partition_id()), "placed")
    counts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*by)) - 1)
    joined = numbered.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(out, (F.col("_before") + F.col("_at")).cast("long")).drop("_range", "_at", "_g", "_r", "_before")


def fold_sorted(df: DataFrame, group: str, order: str, start: Callable[[], object], step: Callable[[object, tuple], tuple], names: list[str], schema: str) -> DataFrame:
    """step(state, row) -> a row, over each group's rows in order, with a fresh state for each group.

    Partitions are sorted and streamed, so a task holds one state and one batch, however long a group is.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = names.index(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, first = None, None, True
        for batch in batches:
            rows = []
            for row in batch[names].itertuples(index=False, name=None):
                if first or row[place] != held:
                    held, state, first = row[place], start(), False
                rows.append(step(state, row))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return df.select(*names).repartition(n, group).sortWithinPartitions(group, order).mapInPandas(run, schema)
