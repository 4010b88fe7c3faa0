"""What the operators of this subpackage share: column picking, shared-folder tables, ordered slots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import new_path, shared_table

def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by exact name, renamed; whatever else the table holds, clashing names included, is left out.

    A name that appears twice takes its first position; an absent one raises KeyError.
    """
    places = {}
    for i, name in enumerate(df.columns):
        places.setdefault(name, i)
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{places[source]}").alias(name) for name, source in wanted.items()])


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    return shared_table(df, tag)


def let(value: Column, body) -> Column:
    """Bind a value once for use several times in an expression; a plain alias may be inlined and evaluated per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slots_in_order(df: DataFrame, group: str, order: list[str], out: str, tag: str, written: Callable[[DataFrame], None] = lambda rows: None) -> DataFrame:
    """Gapless places from 0 within each group, by `order`, without putting a group into one task.

    Rows are dealt by range over the whole order, counted by (range, group), and numbered inside each pair;
    a group that holds a third of all rows is spread over every range. Rows equal in `order` are told apart by
    a row number taken when they are read, so even copies of one row split. Nulls sort first.
    written() is given the rows once they are written, before they are dealt.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written first: finding the ranges reads the rows once more
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), f"{tag}-rows")
    written(rows)
    dealt = rows.repartitionByRange(n, *order, "_row")
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), tag)
    counts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_range").orderBy(*order, "_row")
    numbered = dealt.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    offsets = offsets.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_before")
    joined = numbered.join(offsets, numbered[group].eqNullSafe(offsets["_g"]) & (numbered["_range"] == offsets["_r"]))
    return joined.withColumn(out, F.col("_before") + F.col("_at")).drop("_row", "_range", "_g", "_r", "_before", "_at")
