"""The serving tree as plans: merges, partial answers, hedging, cache replay and federation."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Hashable
from concurrent.futures import Future

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import fold_sorted

TIES = ("segment", "local")


def merged(results: DataFrame, k: int) -> DataFrame:
    """The best k over all shards: score descending, then segment and local id; nothing is deduplicated."""
    return results.orderBy(F.desc("score"), *TIES).limit(max(k, 0))


def gathered(status: DataFrame, timeout: float) -> DataFrame:
    """responded for each (query, shard): within the timeout and without failure."""
    return status.withColumn("responded", F.col("ok") & (F.col("latency") <= timeout))


def good_enough(replies: DataFrame, fraction: float = 1.0) -> DataFrame:
    """answered for each query: as many shards responded as the fraction asks, one at least; outside (0, 1] it is 1."""
    fraction = fraction if 0 < fraction <= 1 else 1.0
    counts = replies.groupBy("query_id").agg(F.count(F.lit(1)).alias("shards"), F.sum(F.col("responded").cast("long")).alias("responded"))
    return counts.withColumn("needed", F.greatest(F.ceil(F.lit(fraction) * F.col("shards")), F.lit(1))).withColumn("answered", F.col("responded") >= F.col("needed"))


def hedged(attempts: DataFrame, delay: float) -> DataFrame:
    """latency of each request over replicas in order: the next starts after the delay, or at once when one fails; the first success wins.

    The replicas of a request are few; they are folded in an array.
    """
    rows = attempts.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("replica", "latency", "ok"))).alias("a"))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("best"))

    def step(s, x):
        end = s["at"] + x["latency"]
        won = F.when(x["ok"], end)
        after = F.when(x["ok"], s["at"] + delay).otherwise(F.least(end, s["at"] + delay))
        running = s["best"].isNull() | (s["best"] > s["at"])
        return F.struct(F.when(running, after).otherwise(s["at"]).cast("double").alias("at"), F.when(running, F.least(s["best"], won)).otherwise(s["best"]).alias("best"))

    return rows.select("request", F.aggregate("a", start, step, lambda s: s["best"]).alias("latency"))


def lru_hits(requests: DataFrame, capacity: int) -> DataFrame:
    """hit of each request (stream, seq, key) in a cache of the stream's own that drops the least recently used; none below 1."""

    def step(cache: OrderedDict, row: tuple) -> tuple:
        hit = row[2] in cache
        cache[row[2]] = True
        cache.move_to_end(row[2])
        if len(cache) > max(capacity, 0):
            cache.popitem(last=False)
        return (*row, hit)

    kinds = dict(requests.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in ("stream", "seq", "key")) + ", hit boolean"
    return fold_sorted(requests, "stream", "seq", OrderedDict, step, ["stream", "seq", "key"], schema)


def trusted(partitions: DataFrame, keys: DataFrame, reputation: DataFrame, floor: float) -> DataFrame:
    """Partitions whose operator has a key and a reputation of the floor or more; an unset one is 0."""
    return partitions.join(keys.select("operator"), "operator", "left_semi").join(reputation, "operator", "left").where(F.coalesce("reputation", F.lit(0.0)) >= floor)


class SharedLoads:
    """The driver's memo of small results by key, for many threads that ask the same: one load for a key at a time.

    Whoever asks while a load runs waits for it, at most `timeout` seconds, and a wait that ends early leaves the load
    to the others. What a load raises goes to all who wait and isn't kept. The least recently used key goes first
    beyond capacity; a capacity below 1 keeps nothing.
    """

    def __init__(self, capacity: int):
        self.capacity, self.kept, self.running, self.lock = capacity, OrderedDict(), {}, threading.Lock()

    def get(self, key: Hashable, load: Callable[[], object], timeout: float | None = None) -> object:
        with self.lock:
            if key in self.kept:
                self.kept.move_to_end(key)
                return self.kept[key]
            shared = self.running.get(key)
            if shared is None:
                shared = self.running[key] = Future()
                threading.Thread(target=self._run, args=(key, load, shared), daemon=True).start()
        return shared.result(timeout)

    def _run(self, key: Hashable, load: Callable[[], object], shared: Future) -> None:
        try:
            value = load()
        except BaseException as e:  # noqa: BLE001  it is raised where the result is asked for
            with self.lock:
                del self.running[key]
            shared.set_exception(e)
            return
        with self.lock:
            del self.running[key]
            if self.capacity > 0:
                self.kept[key] = value
                self.kept.move_to_end(key)
                while len(self.kept) > self.capacity:
                    self.kept.popitem(last=False)
        shared.set_result(value)
