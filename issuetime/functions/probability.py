"""Distributions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cdf(x: Column, knots: tuple[float, ...], levels: tuple[float, ...], tail: float) -> Column:
    """P(X <= x) from quantiles: linear between sorted knots, exponential beyond the outer ones with scale ``tail``."""
    out = F.when(x <= knots[0], levels[0] * F.exp((x - knots[0]) / tail))
    for (a, b), (p, q) in zip(zip(knots, knots[1:], strict=False), zip(levels, levels[1:], strict=False), strict=True):
        out = out.when(x <= b, p + (x - a) / (b - a) * (q - p))
    return out.otherwise(1 - (1 - levels[-1]) * F.exp(-(x - knots[-1]) / tail))


def masses(edges: list[Column]) -> list[Column]:
    """Class masses from the distribution function at ascending edges."""
    ends = [F.lit(0.0), *edges, F.lit(1.0)]
    return [F.greatest(b - a, F.lit(0.0)) for a, b in zip(ends, ends[1:], strict=False)]


def tails(p: list[Column]) -> tuple[Column, Column, Column, Column]:
    """Large fall, any fall, any rise, large rise from five ordered classes."""
    return p[0], p[0] + p[1], p[3] + p[4], p[4]


def array_weighted_median(pairs: Column) -> Column:
    """First value of an array of (v, w) whose cumulative weight reaches half; null if all weights are zero."""
    ordered = F.array_sort(F.filter(pairs, lambda x: x["w"] > 0))
    total = F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x["w"])
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v"))
    step = lambda s, x: F.struct((s["c"] + x["w"]).alias("c"), F.when(s["v"].isNull() & (s["c"] + x["w"] >= total / 2), x["v"]).otherwise(s["v"]).alias("v"))
    return F.aggregate(ordered, start, step, lambda s: s["v"])
