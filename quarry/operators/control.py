"""Placement, routing, membership and health, folded from logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import GOLDEN, fnv1a_many, jump, mix64
from quarry.operators.ordered import fold_sorted


def jump_buckets(rows: DataFrame, buckets: int, key: str = "key") -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "bucket": jump(batch[key].to_numpy().astype(np.int64).view(np.uint64), buckets)})

    return rows.select(key).mapInPandas(place, f"{key} long, bucket long")


def placed(shards: DataFrame, nodes: list[str], replicas: int) -> DataFrame:
    """shard, rank, node: the nodes of the highest weights for each shard, unsigned; ties to the lesser name. Nodes are a bounded list."""
    names = sorted(nodes)
    seeds = fnv1a_many([n.encode() for n in names])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = batch["shard"].to_numpy().astype(np.int64).view(np.uint64)
            w = mix64(seeds[None, :] ^ (s[:, None] * np.uint64(GOLDEN)), golden=False)
            best = np.argsort(~w, axis=1, kind="stable")[:, :replicas]
            k = best.shape[1]
            yield pd.DataFrame({"shard": np.repeat(batch["shard"].to_numpy(), k), "rank": np.tile(np.arange(k), len(batch)), "node": np.asarray(names, dtype=object)[best].ravel()})

    return shards.select("shard").mapInPandas(choose, "shard long, rank long, node string")


def assignment(placed_: DataFrame) -> DataFrame:
    """shard, nodes: names in rank order, joined by commas."""
    return placed_.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("x")).select("shard", F.array_join(F.transform("x", lambda y: y["node"]), ",").alias("nodes"))


def changed(desired: DataFrame, current: DataFrame) -> DataFrame:
    """Shards whose ordered nodes differ from the current ones, or that have none."""
    now = current.select("shard", F.col("nodes").alias("now"))
    return desired.join(now, "shard", "left").where(~F.col("nodes").eqNullSafe(F.col("now"))).select("shard", "nodes")


def folded(log: DataFrame, key: str = "key") -> DataFrame:
    """key, value after a log of (seq, op, key, value): put sets, delete drops, create only sets an absent key.

    A key's log is a run of epochs, each ended by a delete; in the last the newest put wins, else the first create.
    """
    by = Window.partitionBy(key).orderBy("seq")
    epochs = log.withColumn("epoch", F.sum((F.col("op") == "delete").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    last = epochs.groupBy(key).agg(F.max("epoch").alias("epoch"))
    live = epochs.join(last, [key, "epoch"]).where("op <> 'delete'")
    puts = live.groupBy(key).agg(F.max_by(F.when(F.col("op") == "put", F.col("value")), F.when(F.col("op") == "put", F.col("seq"))).alias("p"), F.min_by(F.when(F.col("op") == "create", F.col("value")), F.when(F.col("op") == "create", F.col("seq"))).alias("c"))
    return puts.select(key, F.coalesce("p", "c").alias("value"))


def unexpired(keys: DataFrame, expired: DataFrame) -> DataFrame:
    return keys.join(expired.select("lease"), "lease", "left_anti")


def health(samples: DataFrame, alpha: float = 0.2, enter: float = 200.0, leave: float = 120.0) -> DataFrame:
    """node, seq, ewma, probation after each sample of (node, seq, ms): a node goes on probation above enter and leaves it below leave."""

    def step(state: dict, row: tuple) -> tuple:
        node, seq, ms = row
        value = alpha * ms + (1 - alpha) * state["value"] if state else ms
        held = value >= leave if state.get("held") else value > enter
        state.update(value=value, held=held)
        return node, seq, value, held

    return fold_sorted(samples, "node", "seq", dict, step, ["node", "seq", "ms"], "node string, seq long, ewma double, probation boolean")


def elected(campaigns: DataFrame) -> DataFrame:
    """leader of each (role, epoch): the first to campaign."""
    return campaigns.groupBy("role", "epoch").agg(F.min_by("node", "seq").alias("leader"))
