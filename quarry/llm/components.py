"""Connected components of links held in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


SALTS = 16


def _with_least(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the least v of their u. A node's links are dealt over SALTS by a hash of v, so no task has all of a hub's."""
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = dealt.groupBy("u", "salt").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    spread = least.select(F.col("u").alias("w"), "m", F.explode("salts").alias("z"))  # the salts that a node has, 16 at most
    return dealt.join(spread, (F.col("u") == F.col("w")) & (F.col("salt") == F.col("z"))).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in links (a, b: longs, not null, any order, repeats allowed).

    Each round joins links with the least neighbour of their nodes and writes the new links to the shared folder,
    so a lost executor costs one round. Only a count and a checksum of each round come to the driver.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, seen = materialize(both, "links"), None
    while True:
        near = _with_least(stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        stars = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
