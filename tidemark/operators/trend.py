"""Trends of each user's drift: slopes over the row number, not over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Settings


def _extremes(name: str, part: Column) -> list[Column]:
    """Least, largest and first value of a part of the rows."""
    y = F.when(part, F.col("y"))
    return [F.min(y).alias(f"{name}_lo"), F.max(y).alias(f"{name}_hi"), F.min_by(y, F.when(part, F.col("x"))).alias(f"{name}_y0")]


def _flat(name: str) -> Column:
    """Whether all values of the part are as near to its first as rounding allows: noise of that size has no slope."""
    lo, hi, y0 = (F.col(f"{name}_{k}") for k in ("lo", "hi", "y0"))
    near = F.lit(1e-8) + F.lit(1e-5) * F.abs(y0)
    return F.coalesce((hi - y0 <= near) & (y0 - lo <= near), F.lit(True))


def trajectory(scored: DataFrame, settings: Settings | None = None, order: tuple[str, ...] = ("date", "id"), last_n: int | None = None) -> DataFrame:
    """Slope, acceleration (slope of the second half less that of the first) and whether the rise gets steeper."""
    s = settings or Settings()
    w = Window.partitionBy("user").orderBy(*order)
    rows = scored.select("user", *order, F.col("drift_score").alias("y"), (F.row_number().over(w) - 1).alias("x"), F.count("*").over(Window.partitionBy("user")).alias("n"))
    if last_n is not None:
        rows = rows.filter(F.col("x") >= F.col("n") - last_n).withColumn("x", F.col("x") - F.greatest(F.col("n") - last_n, F.lit(0))).withColumn("n", F.least("n", F.lit(last_n)))
    half = F.expr("n div 2")
    first, second = F.col("x") < half, F.col("x") >= half
    x, y = F.col("x").cast("double"), F.col("y")
    sums = rows.groupBy("user").agg(
        F.count("*").alias("n_points"),
        F.regr_slope(y, x).alias("whole"),
        F.regr_slope(F.when(first, y), F.when(first, x)).alias("early"),
        F.regr_slope(F.when(second, y), F.when(second, x)).alias("late"),
        *[x for name, part in (("whole", F.lit(True)), ("early", first), ("late", second)) for x in _extremes(name, part)],
    )
    flat = (F.col("n_points") < s.least_points) | _flat("whole")
    slope = F.when(flat, 0.0).otherwise(F.coalesce("whole", F.lit(0.0)))
    half_slope = lambda name: F.when(_flat(name), 0.0).otherwise(F.coalesce(name, F.lit(0.0)))
    rise = F.when(flat, 0.0).otherwise(half_slope("late") - half_slope("early"))
    out = sums.withColumns({"slope": slope, "rise": rise})
    return out.select("user", F.round("slope", 5).alias("trend_slope"), F.round("rise", 5).alias("acceleration"), ((F.col("slope") >= s.slope_at) & (F.col("rise") > 0)).alias("accelerating"), "n_points")
