"""Right-closed buckets, their coverage, and targets over them (exact offsets only: gaps are never filled or compressed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuetime.schemas import STANDARD, Clocks


def bucket_label(us: Column, bucket: int) -> Column:
    """Right end of the bucket (label - bucket, label] that holds the clock."""
    return us + (bucket - 1) - F.pmod(us + (bucket - 1), F.lit(bucket))


def anchor(us: Column, bucket: int) -> Column:
    """Label of the last bucket closed at the clock."""
    return us - F.pmod(us, F.lit(bucket))


def bucket_summary(readings: DataFrame, clocks: Clocks = STANDARD) -> DataFrame:
    """series, label, med, n, head, tail, gap: the median of each bucket and the distances that decide its coverage."""
    labelled = readings.withColumn("label", bucket_label(F.col("us"), clocks.bucket))
    order = Window.partitionBy("series", "label").orderBy("us")
    return (
        labelled.withColumn("gap", F.col("us") - F.lag("us").over(order))
        .groupBy("series", "label")
        .agg(F.median("v").alias("med"), F.count(F.lit(1)).alias("n"), F.min("us").alias("_first"), F.max("us").alias("_last"), F.max("gap").alias("gap"))
        .select("series", "label", "med", "n", (F.col("_first") - F.col("label") + clocks.bucket).alias("head"), (F.col("label") - F.col("_last")).alias("tail"), "gap")
    )


def eligible(clocks: Clocks = STANDARD) -> Column:
    return (F.col("n") >= clocks.least) & (F.col("head") <= clocks.edge) & (F.col("tail") <= clocks.edge) & (F.col("gap") <= 2 * clocks.edge)


def closed_series(readings: DataFrame, clocks: Clocks = STANDARD, cutoff: int | None = None) -> DataFrame:
    """series, label, med of the eligible buckets, those closed at ``cutoff`` only if given."""
    out = bucket_summary(readings, clocks).where(eligible(clocks))
    if cutoff is not None:
        out = out.where(F.col("label") <= cutoff - cutoff % clocks.bucket)
    return out.select("series", "label", "med")


def at_offset(buckets: DataFrame, steps: int, bucket: int, name: str, value: str = "med") -> DataFrame:
    """``buckets`` with the value exactly ``steps`` buckets away, null if that bucket is missing."""
    frame = Window.partitionBy("series").orderBy("label").rangeBetween(steps * bucket, steps * bucket)
    return buckets.withColumn(name, F.max(value).over(frame))


def window_values(buckets: DataFrame, first: int, last: int, bucket: int) -> DataFrame:
    """n, mean, low, high over the buckets ``first`` to ``last`` steps ahead; all null unless every one is there."""
    frame = Window.partitionBy("series").orderBy("label").rangeBetween(first * bucket, last * bucket)
    whole = F.count("med").over(frame) == last - first + 1
    return buckets.select(
        "*", *(F.when(whole, f("med").over(frame)).alias(n) for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))), (F.col("label") + last * bucket).alias("complete")
    )


def point_target(issues: DataFrame, buckets: DataFrame, lead: int, bucket: int, clock: str = "issue_us") -> DataFrame:
    """``issues`` with target and complete: the bucket medians interpolated at exactly clock + lead.

    The target weighs the labels on both sides (one label if aligned); null if one of them is missing. complete is the label at
    which the last touched bucket closes.
    """
    at = F.col(clock) + lead
    low = at - F.pmod(at, F.lit(bucket))
    share = F.pmod(at, F.lit(bucket)) / bucket
    side = lambda n: buckets.select(F.col("series").alias(f"s{n}"), F.col("label").alias(f"l{n}"), F.col("med").alias(f"m{n}"))
    keyed = issues.withColumn("_low", low).withColumn("_high", F.when(share > 0, low + bucket).otherwise(low)).withColumn("_share", share)
    out = keyed.join(side(0), (F.col("series") == F.col("s0")) & (F.col("_low") == F.col("l0")), "left").join(side(1), (F.col("series") == F.col("s1")) & (F.col("_high") == F.col("l1")), "left")
    value = F.when(F.col("_share") > 0, F.col("m0") * (1 - F.col("_share")) + F.col("m1") * F.col("_share")).otherwise(F.col("m0"))
    return out.select(*issues.columns, value.alias("target"), F.col("_high").alias("complete"))


def change_class(delta: Column, small: float = 20.0, large: float = 40.0) -> Column:
    """0 large fall, 1 fall, 2 neither, 3 rise, 4 large rise, edges inclusive; null without a change."""
    return F.when(delta <= -large, 0).when(delta <= -small, 1).when(delta < small, 2).when(delta < large, 3).when(delta >= large, 4)


def direction(delta: Column, least: float = 20.0) -> Column:
    """Sign of a change of at least ``least``, else 0."""
    return F.when(F.abs(delta) >= least, F.signum(delta).cast("int")).when(delta.isNotNull(), 0)
