"""Structured Streaming forms of the operators that live on streams. Each gives what its batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import control, index
from quarry.operators.ordered import new_path


def folder(spark: SparkSession, tag: str) -> str:
    return new_path(spark, tag)


def stream_of(spark: SparkSession, folder_: str, name: str) -> DataFrame:
    """A Parquet table in a folder, one file or a folder of files, as a stream of its files."""
    table = spark.read.parquet(f"{folder_}/{name}")
    files = table.inputFiles()
    stream = spark.readStream.schema(table.schema)
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # a file source lists folders
        return stream.option("pathGlobFilter", name).parquet(folder_)
    return stream.parquet(f"{folder_}/{name}")


def ingest(spark: SparkSession, docs: DataFrame, target: str) -> None:
    """Append each batch of a stream of documents to a postings table, under its batch number, so that a batch run again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        index.postings(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    docs.writeStream.foreachBatch(add).option("checkpointLocation", folder(spark, "ingest")).trigger(availableNow=True).start().awaitTermination()


def watched(spark: SparkSession, log: DataFrame, prefix: str, target: str) -> None:
    """Changes whose key begins with a prefix, appended to a table as they come; none is dropped."""
    query = log.where(F.col("key").startswith(prefix)).writeStream.format("parquet").option("path", target).option("checkpointLocation", folder(spark, "watch"))
    query.trigger(availableNow=True).start().awaitTermination()


def reconciled(spark: SparkSession, membership: DataFrame, shards: DataFrame, replicas: int, target: str, offsets: str | None = None) -> None:
    """On each batch of (seq, op, node) place the shards on the nodes that are left and publish those that changed.

    The nodes after each batch are written beside the table, so a stream that starts again, or runs a batch again, goes on from them.
    """

    def apply(batch: DataFrame, number: int) -> None:
        nodes = {r.node for r in spark.read.schema("node string").parquet(f"{target}-members/batch={number - 1}").collect()} if number else set()
        for r in batch.orderBy("seq").collect():  # membership is small
            (nodes.add if r.op == "join" else nodes.discard)(r.node)
        spark.createDataFrame([(n,) for n in sorted(nodes)], "node string").coalesce(1).write.mode("overwrite").parquet(f"{target}-members/batch={number}")
        desired = control.assignment(control.placed(shards, sorted(nodes), replicas))
        if number:
            earlier = spark.read.parquet(target).where(F.col("batch") < number)
            desired = control.changed(desired, earlier.groupBy("shard").agg(F.max_by("nodes", "batch").alias("nodes")))
        desired.write.mode("overwrite").parquet(f"{target}/batch={number}")

    membership.writeStream.foreachBatch(apply).option("checkpointLocation", offsets or folder(spark, "reconcile")).trigger(availableNow=True).start().awaitTermination()


def deduplicated(events: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """The first of each key within a watermark: the live seen-set. A timestamp without zone is cast first."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed(events: DataFrame, time: str, delay: str, width: str, *keys: str) -> DataFrame:
    """Counts and sums of `value` in windows; what comes later than the delay is left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
