"""Metrics of forecasts: point errors, probabilities, events, resampled intervals, and weighted order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_metrics(y: str, pred: str, ref: str, big: float = 20.0) -> list[Column]:
    """n, mae, rmse, bias, persistence mae, skill, and mae on rows whose true change is at least ``big``."""
    e, base = F.col(pred) - F.col(y), F.abs(F.col(ref) - F.col(y))
    return [
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(base).alias("ref_mae"),
        (1 - F.try_divide(F.avg(F.abs(e)), F.avg(base))).alias("skill"), F.avg(F.when(base >= big, F.abs(e))).alias("big_mae"),
    ]


def pinball(y: Column, q: Column, tau: float) -> Column:
    d = y - q
    return F.avg(F.greatest(tau * d, (tau - 1) * d))


def binary_scores(p: str, y: str) -> list[Column]:
    """n, Brier score, log loss (clipped at 1e-15), base rate."""
    c = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col(y) == 1, F.log(c)).otherwise(F.log(1 - c))
    return [F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(loss).alias("log_loss"), F.avg(y).alias("base_rate")]


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of the rows that hold both; NaN if either does not vary among them, where ``corr`` would divide by zero."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b)), F.when(F.count(a) > 0, F.lit(float("nan"))))


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def weighted_quantile(rows: DataFrame, keys: list[str], v: str, w: str, q: float, name: str) -> DataFrame:
    """Per key the first value whose cumulative share of the positive weights reaches ``q``; null if all weights are zero."""
    order = Window.partitionBy(*keys).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    reached = rows.where(F.col(w) > 0).withColumn("_c", F.sum(w).over(order)).withColumn("_t", F.sum(w).over(whole))
    return reached.where(F.col("_c") >= q * F.col("_t")).groupBy(*keys).agg(F.min(v).alias(name))


def draws(days: DataFrame, n_days: str, count: int, seed: int = 12345) -> DataFrame:
    """For every series ``count`` resamples of its days (``at``: 0 to n_days - 1): draw, at. Integers only, the same on every engine."""
    spread = days.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_days) - 1)))
    x = (F.col("draw") * 7919 + F.col("place") * 104_729 + seed) % 2_147_483_647
    return spread.withColumn("at", (x * 48_271 % 2_147_483_647 * 48_271 % 2_147_483_647) % F.col(n_days))


def day_bootstrap(sums: DataFrame, count: int) -> DataFrame:
    """Per series the 5 and 95 % points of sum(a) / sum(n) - sum(b) / sum(n) over resampled days, and the share below 0.

    ``sums``: series, day, a, b, n. The rows are few: days, not issues, are resampled.
    """
    order = Window.partitionBy("series").orderBy("day")
    days = sums.withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    picked = draws(days.groupBy("series").agg(F.count(F.lit(1)).alias("days")), "days", count).join(days, ["series", "at"])
    diff = picked.groupBy("series", "draw").agg(((F.sum("a") - F.sum("b")) / F.sum("n")).alias("diff"))
    return diff.groupBy("series").agg(F.percentile("diff", 0.05).alias("low"), F.percentile("diff", 0.95).alias("high"), F.avg((F.col("diff") < 0).cast("int")).alias("below"))


def islands(rows: DataFrame, gap: int, ts: str, on: str, key: str) -> DataFrame:
    """``island``: runs of rows of equal ``key`` whose distance is at most ``gap``."""
    order = Window.partitionBy(on).orderBy(ts)
    fresh = (F.col(ts) - F.lag(ts).over(order) > gap) | (F.col(key) != F.lag(key).over(order))
    return rows.withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(0))).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
