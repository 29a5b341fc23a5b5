"""Rolling baselines over each user's strictly prior rows. One window spec serves all features: one exchange, one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def prior(window: int, order: tuple[str, ...] = ("date", "id"), user: str = "user") -> WindowSpec:
    return Window.partitionBy(user).orderBy(*order).rowsBetween(-window, -1)


def rolling_stats(df: DataFrame, feature: str, window: int, order: tuple[str, ...] = ("date", "id")) -> DataFrame:
    """Mean and population deviation over the last `window` rows, this one included."""
    w = Window.partitionBy("user").orderBy(*order).rowsBetween(-(window - 1), 0)
    return df.withColumns({"rolling_mean": F.avg(feature).over(w), "rolling_std": F.stddev_pop(feature).over(w), "rolling_n": F.count(feature).over(w)})


#: Windows of fewer rows are added up row after row, as DuckDB does with frames of under 16 rows, so that both agree to the last bit: coarse features often have a
#: z of exactly a threshold. Of larger ones DuckDB joins parts that depend on where a row lies.
IN_ORDER = 16


def in_order(values: Column) -> tuple[Column, Column]:
    """Mean and population deviation (by Welford's steps in DuckDB's form) of an array, in its order."""

    def step(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["m2"] + (x - mean) * (x - a["mean"])).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values), F.sqrt(F.aggregate(values, start, step)["m2"] / F.size(values))


def z_score(feature: str, w: WindowSpec, window: int) -> Column:
    """Null until the window is full; 0 where it is constant, decided exactly by its extremes."""
    x = F.col(feature)
    if window < IN_ORDER:
        values = F.collect_list(x.cast("double")).over(w)
        mean, deviation = in_order(values)
        z = F.when(F.array_min(values) == F.array_max(values), F.lit(0.0)).otherwise((x - mean) / F.nullif(deviation, F.lit(0.0)))
        return F.when(F.size(values) == window, z)
    z = F.when(F.min(x).over(w) == F.max(x).over(w), F.lit(0.0)).otherwise((x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)))
    return F.when(F.count(x).over(w) == window, z)


def with_z(df: DataFrame, features: tuple[str, ...], window: int, order: tuple[str, ...] = ("date", "id")) -> DataFrame:
    w = prior(window, order)
    return df.withColumns({f"z_{f}": z_score(f, w, window) for f in features})


def snapshot(df: DataFrame, feature: str, window: int, order: tuple[str, ...] = ("date", "id")) -> DataFrame:
    """Count, mean and deviation of each user's last rows."""
    w = Window.partitionBy("user").orderBy(*[F.desc(c) for c in order])
    last = df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= window)
    return last.groupBy("user").agg(F.count(feature).alias("n"), F.round(F.avg(feature), 4).alias("mean"), F.round(F.stddev_pop(feature), 4).alias("std"))
