"""PageRank and its trust variants over an edge table, with duplicate edges kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import shared_table, total_before


def dense_vertices(edges: DataFrame) -> DataFrame:
    """name, v: dense ids from 0 in the order of names."""
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    return total_before(names, ["name"], None, "v")


def out_degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """v, degree, counting duplicates; 0 for a vertex without edges."""
    counts = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("v").join(counts, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def teleport(vertices: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """v, t: uniform, or over seeds in proportion to how often each is named."""
    n = vertices.count()
    if seeds is None or seeds.isEmpty():
        return vertices.select("v", F.lit(1.0 / n if n else 0.0).alias("t"))
    total = seeds.count()
    counts = seeds.groupBy("v").agg((F.count(F.lit(1)) / F.lit(float(total))).alias("s"))
    return vertices.select("v").join(counts, "v", "left").select("v", F.coalesce("s", F.lit(0.0)).alias("t"))


def power_iteration(edges: DataFrame, vertices: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, fixed: bool = False) -> tuple[DataFrame, int, bool]:
    """(v, rank), rounds taken, converged: (1 - d) T + d (inflow + dangling T), from T, until the L1 change is below tolerance.

    Parallel edges are one row with their number, so a pair of pages linked a thousand times is one message.
    Only the dangling mass and the residual come to the driver; ranks go to the shared folder every few rounds.
    """
    weighed = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
    degrees = out_degrees(edges, vertices)
    links = shared_table(weighed.join(degrees.select(F.col("v").alias("src"), "degree"), "src").select("src", "dst", (F.col("times") / F.col("degree")).alias("share")), "links")
    base = shared_table(teleport(vertices, seeds).join(degrees, "v"), "vertices")
    state, converged, done = base.select("v", "t", "degree", F.col("t").alias("rank")), base.isEmpty(), 0
    while done < rounds and not converged:
        lost = state.where("degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        inflow = links.join(state.select(F.col("v").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") * F.col("share")).alias("inflow"))
        new = (1 - damping) * F.col("t") + damping * (F.coalesce("inflow", F.lit(0.0)) + F.lit(float(lost)) * F.col("t"))
        after = shared_table(state.join(inflow, "v", "left").select("v", "t", "degree", F.col("rank").alias("before"), new.alias("rank")), "ranks")
        done += 1
        if not fixed:
            converged = after.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("before"))), F.lit(0.0))).first()[0] < tolerance
        state = after.drop("before")
    return state.select("v", "rank"), done, converged
