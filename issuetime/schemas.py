"""Canonical inputs of the operators, projected from the event and order tables.

All clocks are integer microseconds of UTC; buckets are right-closed and named by their right end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND


class Clocks(NamedTuple):
    """The bucket length, coverage limits and leads of one cadence, in microseconds."""

    bucket: int
    edge: int
    least: int
    span: int
    max_age: int
    lead: int
    window: int
    lookback: int
    embargo: int


#: Readings every few hours; the sparse smoke data needs day-long buckets.
STANDARD = Clocks(2 * HOUR, 1920 * SECOND, 3, 2400 * SECOND, 1920 * SECOND, 12 * HOUR, 16 * HOUR, 14 * DAY, 44 * HOUR)
SMOKE = Clocks(DAY, 23_040 * SECOND, 3, 28_800 * SECOND, 23_040 * SECOND, 6 * DAY, 8 * DAY, 14 * DAY, 7 * DAY)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_by(rows: DataFrame, keys: list[str], share: int) -> DataFrame:
    """``rows`` dealt by ``keys`` before each becomes many: two shares for each core at least, of about ``share`` rows at most."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // share)), *keys)


def once(c: Column) -> Column:
    """The column, worked out once for each row and where it stands: what is filtered by it is neither worked out again nor moved to before a shuffle."""
    return F.when(F.spark_partition_id() >= 0, c)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, us, obs_id, v, k, visible_us: irregular readings with the clock at which each became visible."""
    return readings_of(table(spark, sf_dir, "events"))


def readings_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_type").alias("series"), micros(F.col("ts")).alias("us"), F.col("event_id").alias("obs_id"), F.col("value").alias("v"), k.alias("k")
    ).withColumn("visible_us", F.col("us") + F.col("k") * MINUTE)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, obs_id, us, receipt_id, available, confirmed, v: every receipt of a tracked reading, corrections included."""
    return receipts_of(readings(spark, sf_dir))


def receipts_of(readings: DataFrame) -> DataFrame:
    r = readings.where("obs_id % 13 <> 0")
    first = r.select("series", "obs_id", "us", (2 * F.col("obs_id")).alias("receipt_id"), F.col("visible_us").alias("available"), "v")
    again = r.where("obs_id % 7 = 0").select(
        "series", "obs_id", "us", (2 * F.col("obs_id") + 1).alias("receipt_id"), (F.col("visible_us") + 30 * MINUTE).alias("available"), (F.col("v") * 1.1).alias("v")
    )
    wait = F.when(F.col("obs_id") % 11 == 0, F.lit(3 * HOUR)).otherwise(F.lit(SECOND))
    return first.unionByName(again).withColumn("confirmed", F.col("available") + wait)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, fetched, source, cust: one issued forecast run per order."""
    return runs_of(table(spark, sf_dir, "orders"))


def runs_of(orders: DataFrame) -> DataFrame:
    day = F.dayofyear("o_orderdate") % 30
    start = 1_704_067_200 * SECOND
    return orders.select(
        F.col("o_orderkey").alias("run_id"), (F.lit(start) + day * DAY + F.col("o_orderkey") % 1440 * MINUTE).cast("long").alias("fetched"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("cust")
    )


def run_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs' 48 hourly points: run_id, fetched, h, valid, speed, direction, temp, precip, pprob; some points are null."""
    return run_hours_of(runs(spark, sf_dir))


def run_point(h: Column) -> dict[str, Column]:
    """valid, speed, direction, temp, precip, pprob: a run's point ``h`` hours ahead, by its columns run_id, fetched and cust."""
    o = F.col("run_id")
    point = lambda c: F.when((o + h) % 97 != 0, c)
    return {
        "valid": F.col("fetched") - F.col("fetched") % HOUR + h * HOUR,
        "speed": point(5.0 + (o * 7 + h * 3) % 20), "direction": point(((o * 37 + h * 15) % 360).cast("double")), "temp": point(25.0 + (F.col("cust") + h) % 10),
        "precip": point(F.when((o + h) % 5 == 0, (o + h) % 30 / 10.0).otherwise(0.0)), "pprob": point(((o * 13 + h * 11) % 101).cast("double")),
    }


def run_hours_of(runs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The hourly points of some runs. Joins sort and merge them: Spark's size of an exploded table is that of its runs, for which it would broadcast it."""
    base = runs.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(47))))
    return base.select("run_id", "fetched", "source", "h", *(c.alias(n) for n, c in run_point(F.col("h")).items()), *keep).hint("merge")


def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the runs fetched at one clock the last: run_id, fetched, source, cust, and ``all``, one key for all of them."""
    newest = runs(spark, sf_dir).groupBy("fetched").agg(F.max(F.struct("run_id", "source", "cust")).alias("run"))
    return newest.select("run.run_id", "fetched", "run.source", "run.cust", F.lit("all").alias("all"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issue ledger: series, issue_id, issue_us, recorded_us, version, ref, pred, p_fall, p_rise, p_none."""
    r = readings(spark, sf_dir).where("obs_id % 3 = 0")
    k = F.col("k")
    return r.select(
        "series", F.col("obs_id").alias("issue_id"), F.col("us").alias("issue_us"), (F.col("us") + k % 4 * MINUTE).alias("recorded_us"),
        F.when(F.col("obs_id") % 2 == 0, "a").otherwise("b").alias("version"), F.col("v").alias("ref"), (0.8 * F.col("v") + 10).alias("pred"),
        (k / 300.0).alias("p_fall"), ((99 - k) / 300.0).alias("p_rise"), (1 - 99 / 300.0 + 0 * k).alias("p_none"),
    )


#: The same inputs as DuckDB common table expressions.
SQL_INPUTS = """
readings AS (
  SELECT event_type AS series, epoch_us(ts) AS us, event_id AS obs_id, value AS v, regexp_extract(props, '[0-9]+')::BIGINT AS k,
         epoch_us(ts) + regexp_extract(props, '[0-9]+')::BIGINT * 60000000 AS visible_us FROM events),
receipts AS (
  SELECT *, available + CASE WHEN obs_id % 11 = 0 THEN 10800000000 ELSE 1000000 END AS confirmed FROM (
    SELECT series, obs_id, us, 2 * obs_id AS receipt_id, visible_us AS available, v FROM readings WHERE obs_id % 13 <> 0
    UNION ALL
    SELECT series, obs_id, us, 2 * obs_id + 1, visible_us + 1800000000, v * 1.1::DOUBLE FROM readings WHERE obs_id % 13 <> 0 AND obs_id % 7 = 0)),
runs AS (
  SELECT o_orderkey AS run_id, 1704067200000000 + (dayofyear(o_orderdate) % 30) * 86400000000 + (o_orderkey % 1440) * 60000000 AS fetched,
         o_orderpriority AS source, o_custkey AS cust FROM orders),
run_hours AS (
  SELECT run_id, fetched, source, h, fetched - fetched % 3600000000 + h * 3600000000 AS valid,
         CASE WHEN w THEN 5.0::DOUBLE + (run_id * 7 + h * 3) % 20 END AS speed, CASE WHEN w THEN ((run_id * 37 + h * 15) % 360)::DOUBLE END AS direction,
         CASE WHEN w THEN 25.0::DOUBLE + (cust + h) % 10 END AS temp,
         CASE WHEN w THEN CASE WHEN (run_id + h) % 5 = 0 THEN ((run_id + h) % 30) / 10.0::DOUBLE ELSE 0.0::DOUBLE END END AS precip,
         CASE WHEN w THEN ((run_id * 13 + h * 11) % 101)::DOUBLE END AS pprob
  FROM (SELECT *, (run_id + h) % 97 <> 0 AS w FROM (SELECT *, unnest(range(48)) AS h FROM runs))),
issues AS (
  SELECT series, obs_id AS issue_id, us AS issue_us, us + (k % 4) * 60000000 AS recorded_us, CASE WHEN obs_id % 2 = 0 THEN 'a' ELSE 'b' END AS version,
         v AS ref, 0.8::DOUBLE * v + 10 AS pred, k / 300.0::DOUBLE AS p_fall, (99 - k) / 300.0::DOUBLE AS p_rise, 1 - 99 / 300.0::DOUBLE AS p_none
  FROM readings WHERE obs_id % 3 = 0),
gaps AS (
  SELECT *, (us + 7199999999) // 7200000000 * 7200000000 AS label FROM readings),
buckets AS (
  SELECT series, label, median(v) AS med, count(*) AS n, min(us) - (label - 7200000000) AS head, label - max(us) AS tail, max(gap) AS gap
  FROM (SELECT *, us - lag(us) OVER (PARTITION BY series, label ORDER BY us) AS gap FROM gaps) GROUP BY series, label),
closed AS (
  SELECT series, label, med FROM buckets WHERE n >= 3 AND head <= 1920000000 AND tail <= 1920000000 AND gap <= 3840000000)
"""


def sql(body: str, recursive: bool = False) -> str:
    """A DuckDB query over the inputs above; ``body`` may start with further table expressions and a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL_INPUTS.strip()}{body}"
