"""Rounding of doubles as DuckDB does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_round(x: Column | str, places: int) -> Column:
    """x times a power of ten, to the nearest whole number (halves away from zero), divided by it; what isn't finite stays.

    Spark's round() goes through the shortest decimal that gives the double, so 0.285 becomes 0.29; DuckDB's round(),
    which this equals, gives 0.28, as 28.499999999999996 is below the half. An expression is evaluated once.
    """
    power = F.lit(float(10**places))

    def made(v: Column) -> Column:
        y = v * power
        size = F.abs(y)
        down = F.floor(size).cast("double")
        whole = down + F.when(size - down >= 0.5, 1.0).otherwise(0.0)
        small = F.when(y < 0, -whole).otherwise(whole) / power
        return F.when(size < F.lit(2.0**52), small).when(size < F.lit(float("inf")), y / power).otherwise(v)

    if isinstance(x, str):
        return made(F.col(x).cast("double"))
    return F.element_at(F.transform(F.array(x.cast("double")), made), 1)
