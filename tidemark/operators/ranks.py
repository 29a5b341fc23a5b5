"""Ranks and running sums over whole tables in two steps: sums per bucket first, then rows within their bucket. No task orders a
whole table, and a bucket holds about the square root of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import checkpointed


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where the table has columns of those names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def root_of(rows: Column) -> Column:
    """How many buckets a group of so many rows is cut into: their square root, so that the rows of a bucket and the buckets
    of a group, each ordered by one task, are as few as they can be together."""
    return F.greatest(F.ceil(F.sqrt(rows)), F.lit(1)).cast("long")


def ahead(rows: DataFrame, group: list[str], bucket: str, order: list, name: str, each: str | None = None) -> DataFrame:
    """The rows, or the sum of a column, before each row in its group (all rows if none), by the bucket and then the order."""
    keys, before = [*group, bucket], (Window.unboundedPreceding, -1)
    inner, head, total, *own = fresh(rows, "_inner", "_head", "_sum", *[f"_{k}" for k in keys])
    n = F.sum(each) if each else F.count("*")
    sums = rows.groupBy(*keys).agg(n.alias(total))
    over = Window.partitionBy(*(group or [F.lit(1)])).orderBy(bucket).rowsBetween(*before)
    sums = sums.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.coalesce(F.sum(total).over(over), F.lit(0)).alias(head))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
    numbers = rows.withColumn(inner, F.coalesce(n.over(within), F.lit(0)))
    on = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(o))
    return numbers.join(sums, on).withColumn(name, F.col(head) + F.col(inner)).drop(head, inner, *own)


def uniform(marked: Column) -> Column:
    """A double in [0, 1) from the first 48 bits of a hexadecimal digest."""
    return F.conv(F.substring(marked, 1, 12), 16, 10).cast("double") / float(1 << 48)


def in_ranges(df: DataFrame, *values: str) -> DataFrame:
    """df dealt out by ranges of a value (or several), and _part, the number of the range: ranges of a lower number hold lower values, equal values share one."""
    return checkpointed(df.repartitionByRange(*values)).withColumn("_part", F.spark_partition_id())


def exact_quantiles(df: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """One row of q0, q1, ...: quantiles with linear interpolation of the values that are not null; null without any. Values are counted per distinct
    one, dealt out by range, and only the ranges that hold a wanted rank are put in order."""
    counts = in_ranges(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")), "v")
    per = counts.groupBy("_part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("head", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("all", F.sum("rows").over(Window.partitionBy(F.lit(1))))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(s)) * (F.col("all") - 1)).alias("place")) for k, s in enumerate(shares)])).alias("x")
    ranks = per.select("_part", "head", "rows", at).select("_part", "head", "rows", "x.*")
    ranks = ranks.select("_part", "head", "rows", "k", "place", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank"))
    # A row for each quantile and end: a few.
    ranks = ranks.filter((F.col("rank") >= F.col("head")) & (F.col("rank") < F.col("head") + F.col("rows"))).withColumnRenamed("_part", "_of")
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = counts.join(F.broadcast(ranks.select("_of").distinct()), F.col("_part") == F.col("_of"), "left_semi").withColumn("inner", inner)
    found = held.join(F.broadcast(ranks), F.col("_part") == F.col("_of")).filter((F.col("rank") - F.col("head") >= F.col("inner")) & (F.col("rank") - F.col("head") < F.col("inner") + F.col("n")))
    ends = found.groupBy("k").agg(F.max("place").alias("place"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    value_at = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("place") - F.floor("place"))
    return ends.agg(*[F.max(F.when(F.col("k") == k, value_at)).alias(f"q{k}") for k in range(len(shares))])
