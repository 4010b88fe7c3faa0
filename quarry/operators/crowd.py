"""Private crowd signals: reports squashed by session, bits flipped at random, tallies freed of the bias."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = ("good", "last_longest", "pogo")
#: Where secret_of() looks.
SECRET_SETTING = "spark.quarry.crowd.secret"


def squashed(reports: DataFrame) -> DataFrame:
    """One row for each session, query and document: its bits together, and when it was first seen."""
    return reports.groupBy("session", "query", "doc").agg(*[F.bool_or(b).alias(b) for b in BITS], F.min("pos").alias("pos"))


def keep_chance(epsilon: float) -> float:
    return exp(epsilon) / (1 + exp(epsilon))


def uniform(secret: str, *parts: Column) -> Column:
    """A number in [0, 1) from the secret's digest of these: it doesn't hang on partitions, and nobody without the secret can redo it."""
    inner = F.sha2(F.concat_ws("|", F.lit(secret), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), inner), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def secret_of(spark: SparkSession) -> str:
    """The secret that the session or the cluster holds in SECRET_SETTING; raises if there is none."""
    found = spark.conf.get(SECRET_SETTING, None)
    if not found:
        raise ValueError(f"set {SECRET_SETTING} to a secret")
    return found


def privatized(reports: DataFrame, epsilon: float, secret: str, key: str = "report") -> DataFrame:
    """Each bit kept with chance e^eps / (1 + e^eps), else flipped, as the secret decides for this report and bit.

    Whoever reports needs the secret, whoever tallies must not have it; reports with one id are flipped alike.
    """
    if not secret:
        raise ValueError("flips that anyone can redo hide nothing: a secret is needed")
    p = keep_chance(epsilon)
    return reports.withColumns({b: F.when(uniform(secret, F.col(key), F.lit(b)) < p, F.col(b)).otherwise(~F.col(b)) for b in BITS})


def tallied(reports: DataFrame) -> DataFrame:
    return reports.groupBy("query", "doc").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(b).cast("long")).alias(b) for b in BITS])


def debiased(tallies: DataFrame, epsilon: float) -> DataFrame:
    if epsilon <= 0:
        raise ValueError("without a positive epsilon nothing can be told")
    p = keep_chance(epsilon)
    return tallies.select("query", "doc", "n", *[F.greatest((F.col(b) - (1 - p) * F.col("n")) / (2 * p - 1), F.lit(0.0)).alias(b) for b in BITS])
