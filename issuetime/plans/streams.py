"""Streams run to their end over the event files; each must equal its batch operator on what the watermark has closed."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuetime.plans.targets import r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, MINUTE, readings, readings_of, receipts_of, runs_of, table
from issuetime.sources.ingest import existing
from issuetime.streaming import buckets as st
from issuetime.streaming import detector


def work_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; a machine-local one only in local mode with that setting unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-')}/stream-{uuid4().hex}"


def reading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("obs_id"), F.col("value").alias("v"))


def finished(stream: DataFrame) -> DataFrame:
    spark, at = stream.sparkSession, work_dir(stream.sparkSession)
    st.run_to_end(stream, f"{at}/out", f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("t03_stream_buckets", " SELECT series, label, round(med, 6) AS med FROM closed WHERE label <= (SELECT max(us) - 1 - 3600000000 FROM readings)")
def stream_buckets(spark, sf_dir):
    return finished(st.closed_buckets(reading_stream(spark, sf_dir), "1 hour")).select("series", "label", r6("med").alias("med"))


@query("t05_stream_sessions", """, j AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 3600000000 THEN 1 ELSE 0 END AS j FROM readings WINDOW w AS (PARTITION BY series ORDER BY us)), s AS (SELECT *, sum(j) OVER (PARTITION BY series ORDER BY us) AS g FROM j)
  SELECT series, min(us) AS start, max(us) + 3600000000 AS "end", count(*) AS n FROM s GROUP BY series, g HAVING max(us) + 3600000000 <= (SELECT max(us) - 3600000000 FROM readings)""")
def stream_sessions(spark, sf_dir):
    return finished(st.sessions(reading_stream(spark, sf_dir), "1 hour", "1 hour"))


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("t01_stream_readings", " SELECT series, us, obs_id, v FROM readings")
def stream_readings(spark, sf_dir):
    """Every reading delivered twice and kept once."""
    twice = reading_stream(spark, sf_dir).unionByName(reading_stream(spark, sf_dir))
    return finished(st.deduplicated(twice, "1 hour").select("series", F.unix_micros("ts").alias("us"), "obs_id", "v"))


@query("t02_stream_runs", " SELECT source, fetched, min(run_id) AS run_id FROM runs GROUP BY source, fetched")
def stream_runs(spark, sf_dir):
    """Immutable run snapshots: the first of each source and clock is kept, whatever is delivered later."""
    at = work_dir(spark)
    st.publish(runs_of(file_stream(spark, sf_dir, "orders")).select("source", "fetched", "run_id"), f"{at}/runs", f"{at}/state", ["source", "fetched"], "run_id", f"fetched div {DAY}")
    return spark.read.parquet(f"{at}/runs").select("source", "fetched", "run_id")


@query("t04_stream_trailing", f""", w AS (SELECT *, unnest([us // {30 * MINUTE} * {30 * MINUTE} - k * {30 * MINUTE} for k in range(4)]) AS start FROM readings) SELECT series, start, start + {2 * HOUR} AS "end", count(*) AS n, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM w GROUP BY series, start HAVING start + {2 * HOUR} <= (SELECT max(us) - {HOUR} FROM readings)""")
def stream_trailing(spark, sf_dir):
    return finished(st.trailing(reading_stream(spark, sf_dir), "2 hours", "30 minutes", "1 hour")).withColumn("mean", r6("mean"))


LEDGER_CLOCK = 1_705_536_000_000_000


@query("t06_stream_ledger", f""" SELECT series, obs_id, receipt_id, round(v, 6) AS v FROM receipts WHERE greatest(available, confirmed) <= {LEDGER_CLOCK}
  QUALIFY row_number() OVER (PARTITION BY series, obs_id ORDER BY greatest(available, confirmed) DESC, receipt_id DESC) = 1""")
def stream_ledger(spark, sf_dir):
    """Late and corrected values are appended with their own clocks; an earlier clock reads the ledger as it was then."""
    from issuetime.operators.joins import revision_asof

    ledger = finished(receipts_of(readings_of(file_stream(spark, sf_dir, "events"))))
    return revision_asof(ledger, LEDGER_CLOCK).select("series", "obs_id", "receipt_id", r6("v").alias("v"))


DELIVERIES = 10 * DAY
#: Every so many readings come with the delivery after their own.
WITHHELD = 50


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the readings in deliveries of ten days each, oldest first, some of them one delivery late."""
    r = readings(spark, sf_dir).select("series", "us", "obs_id", "v")
    dated = r.withColumn("delivery", F.expr(f"us div {DELIVERIES}") + (F.col("obs_id") % WITHHELD == 0).cast("int"))
    path = f"{work_dir(spark)}/deliveries"
    for d in sorted(x[0] for x in dated.select("delivery").distinct().collect()):  # a number a delivery
        dated.where(F.col("delivery") == d).drop("delivery").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("t06_late_rows", f""", d AS (SELECT *, us // {DELIVERIES} + (obs_id % {WITHHELD} = 0)::INT AS delivery FROM readings), c AS (SELECT delivery, max(us) AS newest FROM d GROUP BY delivery),
  w AS (SELECT delivery, max(newest) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
  SELECT obs_id, coalesce(us <= before - {HOUR}, FALSE) AS late FROM d JOIN w USING (delivery)""")
def late_rows(spark, sf_dir):
    """Readings that come a delivery late are set aside; the ledger holds the others."""
    at = work_dir(spark)
    detector.set_late_aside(deliveries(spark, sf_dir), at, f"{at}/state", HOUR)
    kept, late = (existing(spark, f"{at}/{part}") for part in ("ledger", "late"))
    return kept.select("obs_id", F.lit(False).alias("late")).unionByName(late.select("obs_id", F.lit(True).alias("late")))


@query("t07_stream_detector")
def stream_detector(spark, sf_dir):
    """Falls of 60 below the highest level since the detector was armed, and the clocks at which a hold of six hours had passed and it armed again."""
    with detector.timer_states(spark):
        return finished(detector.detected(reading_stream(spark, sf_dir), 60.0, 6 * HOUR, "1 hour"))


@query("t08_stream_publication", f" SELECT event_type AS series, slot, min_by(event_id, (us, event_id)) AS issue_id FROM (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // {4 * HOUR} AS slot FROM events WHERE event_id % 3 = 0) GROUP BY event_type, slot".replace("min_by", "arg_min"), inputs=False)
def stream_publication(spark, sf_dir):
    """One issue per series and slot; the stream runs twice, and the second run finds everything published."""
    at = work_dir(spark)
    for turn in range(2):
        rows = reading_stream(spark, sf_dir).where("obs_id % 3 = 0").select("series", F.expr(f"unix_micros(ts) div {4 * HOUR}").alias("slot"), F.col("obs_id").alias("issue_id"), F.struct(F.unix_micros("ts").alias("us"), "obs_id").alias("place"))
        st.publish(rows, f"{at}/issues", f"{at}/state", ["series", "slot"], "place", f"slot * {4 * HOUR} div {DAY}")
        st.publish(rows, f"{at}/issues", f"{at}/again", ["series", "slot"], "place", f"slot * {4 * HOUR} div {DAY}")
    return existing(spark, f"{at}/issues").select("series", "slot", "issue_id")


@query("t09_stream_outcomes", f" SELECT i.issue_id, r.obs_id FROM issues i JOIN readings r ON r.series = i.series AND r.us >= i.issue_us + {12 * HOUR} AND r.us < i.issue_us + {12 * HOUR + 20 * MINUTE}")
def stream_outcomes(spark, sf_dir):
    """Issues joined with their outcomes, twelve hours on, as both arrive."""
    issued = reading_stream(spark, sf_dir).where("obs_id % 3 = 0").select("series", F.col("obs_id").alias("issue_id"), F.col("ts").alias("at"))
    return finished(st.matched(issued, reading_stream(spark, sf_dir), "12 hours", "20 minutes", "1 hour"))


@query("t10_stream_freshness", f", n AS (SELECT series, max(us) AS us FROM readings GROUP BY series) SELECT series, us, CASE WHEN now - us > {15 * MINUTE} THEN 'unavailable' WHEN now - us > {7 * MINUTE} THEN 'degraded' ELSE 'fresh' END AS status FROM n CROSS JOIN (SELECT max(us) AS now FROM n)")
def stream_freshness(spark, sf_dir):
    """How old each series' newest reading is against the newest of all."""
    at = work_dir(spark)
    st.latest(reading_stream(spark, sf_dir), f"{at}/newest", f"{at}/state")
    newest = spark.read.parquet(f"{at}/newest")
    age = F.col("now") - F.col("us")
    status = F.when(age > 15 * MINUTE, "unavailable").when(age > 7 * MINUTE, "degraded").otherwise("fresh")
    return newest.crossJoin(newest.agg(F.max("us").alias("now"))).select("series", "us", status.alias("status"))  # one row against one per series
