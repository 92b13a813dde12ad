"""Models refitted per series and cutoff: each evaluation day trains on its own trailing rows whose targets had closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuetime.schemas import DAY, STANDARD, Clocks


def _day(clock: Column) -> Column:
    """The day of a clock as a number, rounded down on either side of 1970."""
    return ((clock - F.pmod(clock, F.lit(DAY))) / DAY).cast("long")


def training_spans(rows: DataFrame, clocks: Clocks = STANDARD) -> DataFrame:
    """Every labelled row with ``first`` and ``last``: the evaluation days that may train on it, which follow one another.

    A row serves the days after its embargo and within the lookback, provided its target closed before the day began.
    Needs series, issue_us, target, complete; rows without one of the last three serve no day.
    """
    first = _day(F.greatest(F.col("issue_us") + clocks.embargo, F.col("complete"))) + 1
    known = F.col("target").isNotNull() & F.col("issue_us").isNotNull() & F.col("complete").isNotNull()
    spans = rows.where(known).withColumn("first", first).withColumn("last", _day(F.col("issue_us") + clocks.lookback - 1))
    return spans.where("first <= last")


def training_rows(rows: DataFrame, clocks: Clocks = STANDARD) -> DataFrame:
    """Every labelled row once for each evaluation day that may train on it, as ``day``: a bounded number of times (days of lookback).

    For what needs the rows themselves, such as medians; sums go by ``training_sums``.
    """
    return training_spans(rows, clocks).withColumn("day", F.explode(F.sequence("first", "last"))).drop("first", "last")


def training_sums(rows: DataFrame, parts: list[Column], totals: list[Column], by: tuple[str, ...] = (), clocks: Clocks = STANDARD) -> DataFrame:
    """series, day, ``by`` and ``totals`` over each evaluation day's training rows, merged from ``parts``.

    Rows that serve the same days are aggregated first; only those few partial results per series and day are repeated.
    """
    spans = training_spans(rows, clocks).groupBy("series", "first", "last", *by).agg(*parts)
    return spans.withColumn("day", F.explode(F.sequence("first", "last"))).groupBy("series", "day", *by).agg(*totals)


def walk_forward(rows: DataFrame, fit_predict: Callable, schema: str, clocks: Clocks = STANDARD) -> DataFrame:
    """``fit_predict(train, test) -> predictions`` for every (series, day) in one job; test rows come without labels.

    ``fit_predict`` gets two pandas frames, of one series' trailing window and of its day: both bounded by the window.
    """
    train = training_rows(rows, clocks)
    test = rows.drop("target", "complete").select(*(F.col(c).alias(c) for c in rows.columns if c not in ("target", "complete")), F.expr(f"issue_us div {DAY}").alias("day"))
    return train.groupBy("series", "day").cogroup(test.groupBy("series", "day")).applyInPandas(fit_predict, schema)


def line_fit(y: str, x: str) -> list[Column]:
    """Slope and intercept of least squares as aggregates: no rows are gathered."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n_train")]


def fit_sums(rows: DataFrame, y: str, x: str, clocks: Clocks = STANDARD) -> DataFrame:
    """Per series and day n, mx, my, sxy, sxx of the training rows: what any one-feature least squares of y on x needs."""
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    parts = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("cxx")]
    mean = lambda v: F.sum(n * v) / F.sum(n)
    # sums of products about the mean: within the parts, and of the parts' means about the whole mean
    sxy, sxx = F.sum(n * F.col("cxy")) + F.sum(n * mx * my) - F.sum(n) * mean(mx) * mean(my), F.sum(n * F.col("cxx")) + F.sum(n * mx * mx) - F.sum(n) * mean(mx) * mean(mx)
    return training_sums(rows.where(F.col(x).isNotNull()), parts, [F.sum("n").alias("n"), mean(mx).alias("mx"), mean(my).alias("my"), sxy.alias("sxy"), sxx.alias("sxx")], clocks=clocks)


def ridge_days(rows: DataFrame, y: str, x: str, alpha: float, clocks: Clocks = STANDARD) -> DataFrame:
    """Per series and day the one-feature ridge fit of y on x from sums over the training rows with both, unpenalised intercept."""
    t = fit_sums(rows, y, x, clocks)
    slope = F.col("sxy") / (F.col("sxx") + alpha)
    return t.select("series", "day", "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def cumulative_incidence(hazards: Column) -> Column:
    """Per step the probability that a cause has come by then, from the hazards (array of struct fall, rise) of each step."""
    start = F.struct(F.lit(1.0).alias("alive"), F.lit(0.0).alias("fall"), F.lit(0.0).alias("rise"))
    step = lambda s, h: F.struct((s["alive"] * (1 - h["fall"] - h["rise"])).alias("alive"), (s["fall"] + s["alive"] * h["fall"]).alias("fall"), (s["rise"] + s["alive"] * h["rise"]).alias("rise"))
    return F.aggregate(hazards, start, step)
