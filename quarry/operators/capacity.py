"""Cost and memory arithmetic, and the build plan as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost_per_million(price_per_hour: Column, tokens_per_second: Column) -> Column:
    """Infinite where nothing is produced."""
    return F.when(tokens_per_second > 0, F.try_divide(price_per_hour, tokens_per_second) / 3600 * 1e6).otherwise(F.lit(float("inf")))


def blended(shares: Column, costs: Column) -> Column:
    """0 for lists of different lengths, or none."""
    total = F.aggregate(F.zip_with(shares, costs, lambda s, c: s * c), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(shares) == F.size(costs)) & (F.size(shares) > 0), total).otherwise(F.lit(0.0))


def vector_bytes(n: Column, dim: Column, width: Column) -> Column:
    return F.when((n > 0) & (dim > 0) & (width > 0), n.cast("long") * dim * width).otherwise(F.lit(0).cast("long"))


def saving(base: Column, other: Column) -> Column:
    return F.when(base > 0, F.try_divide(base - other, base)).otherwise(F.lit(0.0))


def memory_limit(cgroup: Column, fraction: Column) -> Column:
    return F.floor(cgroup * F.greatest(F.lit(0.85), F.least(F.lit(0.9), fraction))).cast("long")


STEPS = [
    ("M0", "one-node index"), ("M1", "serving over shards"), ("M2", "open artifact"), ("M3", "ranking"), ("M4", "vectors and hybrid search"),
    ("M5", "answers"), ("M6", "behaviour signals"), ("M7", "crawling at scale"), ("M8", "federation"), ("M9", "growth and verticals"),
]
RISKS = [
    ("poisoned shards and false operators", True, 4), ("cost of a model for each query", False, 5), ("relevance before any signal", False, 3),
    ("rights in the corpus", False, 3), ("standing with crawled sites", False, 3), ("drift between own and bound code", False, 2),
]


def plan_rows() -> list[tuple[str, str, str, bool, int]]:
    """kind, id, title, primary, measures."""
    return [("step", i, t, False, 0) for i, t in STEPS] + [("risk", f"R{k}", t, p, n) for k, (t, p, n) in enumerate(RISKS)]
