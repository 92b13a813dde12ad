"""Ranks within few large groups: each group's values are cut into ranges that are sorted apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, key: str, value: str, parts: int = 64) -> DataFrame:
    """``rows`` with place (from 1, ties in any order), average (the mean place of equal values) and total (rows of the key).

    ``parts`` approximate quantiles of each key bound its ranges; equal values share one. A range knows its place from the
    counts of those below it, of which there are at most ``parts`` + 1 rows per key.
    """
    bounds = rows.groupBy(key).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)]).alias("_bounds"))
    cut = rows.join(bounds, key).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    below = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(key, "_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(key)).alias("total"))
    inside = Window.partitionBy(key, "_range").orderBy(value)
    equal = F.count(F.lit(1)).over(Window.partitionBy(key, "_range", value))
    placed = cut.withColumn("place", F.row_number().over(inside)).withColumn("average", F.rank().over(inside) + (equal - 1) / 2).join(base, [key, "_range"])
    return placed.withColumn("place", F.col("place") + F.col("_base")).withColumn("average", F.col("average") + F.col("_base")).drop("_range", "_base")


def average_ranks(counts: DataFrame, key: str, value: str, n: str, parts: int = 64) -> DataFrame:
    """key, value, average (the mean place, from 1, of the ``n`` rows of that value, null last) and total (rows of the key).

    ``counts`` has every value of a key once, so that no rows of equal value meet; values are cut into ranges as by ``ranked``.
    """
    bounds = counts.groupBy(key).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)]).alias("_bounds"))
    place = F.when(F.col(value).isNull(), parts).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col(value))))
    cut = counts.select(key, value, n).join(bounds, key).withColumn("_range", place).drop("_bounds")
    below = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(key, "_range").agg(F.sum(n).alias("_n"))
    base = sizes.select(key, "_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(key)).alias("total"))
    upto = F.sum(n).over(Window.partitionBy(key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = cut.withColumn("_upto", upto).join(base, [key, "_range"])
    return placed.select(key, value, (F.col("_base") + F.col("_upto") - (F.col(n) - 1) / 2).alias("average"), "total")


def quantiles(rows: DataFrame, key: str, value: str, levels: dict[str, float], parts: int = 64) -> DataFrame:
    """key and, under each name of ``levels``, the linearly interpolated quantile of the key's values; nulls do not count.

    Only the one or two rows at each quantile's place are kept of what ``ranked`` places, so no group's values meet in a buffer.
    """
    placed = ranked(rows.where(F.col(value).isNotNull()).select(key, value), key, value, parts)
    at = {n: F.lit(q) * (F.col("total") - 1) + 1 for n, q in levels.items()}
    share = lambda p: F.when(F.col("place") == F.floor(p), 1 - (p - F.floor(p))).when(F.col("place") == F.floor(p) + 1, p - F.floor(p))
    near = placed.where(reduce(lambda a, b: a | b, ((F.col("place") - p > -1) & (F.col("place") - p < 1) for p in at.values())))
    return near.groupBy(key).agg(*(F.sum(share(p) * F.col(value)).alias(n) for n, p in at.items()))
