"""Buckets, targets and the first report on changes (step one and two of the plan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, STANDARD, Clocks, issues, readings

B = STANDARD.bucket


def r6(c):
    return F.round(c, 6)


@query("a01_bucket_medians", ", x AS (SELECT series, label, round(med, 6) AS med, n FROM buckets) SELECT * FROM x")
def bucket_medians(spark, sf_dir):
    return bk.bucket_summary(readings(spark, sf_dir)).select("series", "label", r6("med").alias("med"), "n")


@query("a02_bucket_coverage", " SELECT series, label, n, head, tail, gap, coalesce(n >= 3 AND head <= 1920000000 AND tail <= 1920000000 AND gap <= 3840000000, FALSE) AS eligible FROM buckets")
def bucket_coverage(spark, sf_dir):
    return bk.bucket_summary(readings(spark, sf_dir)).select("series", "label", "n", "head", "tail", "gap", F.coalesce(bk.eligible(), F.lit(False)).alias("eligible"))


CUTOFF = 1_705_276_800_000_000 + 5000  # mid-January, just past a label


@query("a03_closed_series", f" SELECT series, label, round(med, 6) AS med FROM closed WHERE label <= {CUTOFF} // 7200000000 * 7200000000")
def closed_series(spark, sf_dir):
    return bk.closed_series(readings(spark, sf_dir), cutoff=CUTOFF).withColumn("med", r6("med"))


@query("p01_closed_buckets", f" SELECT b.series, b.label, round(c.med, 6) AS med FROM buckets b LEFT JOIN closed c USING (series, label) WHERE b.label <= {CUTOFF} // 7200000000 * 7200000000")
def closed_buckets(spark, sf_dir):
    summary = bk.bucket_summary(readings(spark, sf_dir)).where(F.col("label") <= CUTOFF - CUTOFF % B)
    return summary.select("series", "label", r6(F.when(bk.eligible(), F.col("med"))).alias("med"))


@query("j06_exact_offset", " SELECT a.series, a.label, round(a.med, 6) AS med, round(b.med, 6) AS ahead FROM closed a LEFT JOIN closed b ON a.series = b.series AND b.label = a.label + 6 * 7200000000")
def exact_offset(spark, sf_dir):
    out = bk.at_offset(bk.closed_series(readings(spark, sf_dir)), 6, B, "ahead")
    return out.select("series", "label", r6("med").alias("med"), r6("ahead").alias("ahead"))


@query("f01_labels_and_anchors", " SELECT obs_id, (us + 7199999999) // 7200000000 * 7200000000 AS label, us // 7200000000 * 7200000000 AS anchor, us % 7200000000 AS lag FROM readings")
def labels_and_anchors(spark, sf_dir):
    us = F.col("us")
    return readings(spark, sf_dir).select("obs_id", bk.bucket_label(us, B).alias("label"), bk.anchor(us, B).alias("anchor"), (us - bk.anchor(us, B)).alias("lag"))


@query("f02_point_weights", f" SELECT obs_id, (us + {12 * HOUR}) // {B} * {B} AS low, round(1 - ((us + {12 * HOUR}) % {B}) / {B}::DOUBLE, 6) AS w_low, CASE WHEN (us + {12 * HOUR}) % {B} > 0 THEN (us + {12 * HOUR}) // {B} * {B} + {B} END AS high, round(((us + {12 * HOUR}) % {B}) / {B}::DOUBLE, 6) AS w_high FROM readings")
def point_weights(spark, sf_dir):
    at = F.col("us") + STANDARD.lead
    low, share = bk.anchor(at, B), F.pmod(at, F.lit(B)) / B
    return readings(spark, sf_dir).select("obs_id", low.alias("low"), r6(1 - share).alias("w_low"), F.when(share > 0, low + B).alias("high"), r6(share).alias("w_high"))


@query("f03_window_weights", f""" SELECT obs_id, l AS label, round((least(l, e) - greatest(l - {B}, s)) / (e - s)::DOUBLE, 6) AS w FROM (
  SELECT obs_id, us + {12 * HOUR} AS s, us + {28 * HOUR} AS e, unnest(range((us + {12 * HOUR}) // {B} * {B} + {B}, (us + {28 * HOUR} + {B} - 1) // {B} * {B} + 1, {B})) AS l FROM readings)""")
def window_weights(spark, sf_dir):
    s, e = F.col("us") + STANDARD.lead, F.col("us") + STANDARD.lead + STANDARD.window
    spread = readings(spark, sf_dir).select("obs_id", s.alias("s"), e.alias("e"), F.explode(F.sequence(bk.anchor(s, B) + B, bk.bucket_label(e, B), F.lit(B))).alias("label"))
    return spread.select("obs_id", "label", r6((F.least("label", "e") - F.greatest(F.col("label") - B, F.col("s"))) / (F.col("e") - F.col("s"))).alias("w"))


TARGET = f""", t AS (
  SELECT i.*, (issue_us + {12 * HOUR}) // {B} * {B} AS lo, ((issue_us + {12 * HOUR}) % {B}) / {B}::DOUBLE AS share FROM issues i),
targets AS (
  SELECT t.*, CASE WHEN share > 0 THEN a.med * (1 - share) + b.med * share ELSE a.med END AS target, CASE WHEN share > 0 THEN lo + {B} ELSE lo END AS complete
  FROM t LEFT JOIN closed a ON a.series = t.series AND a.label = lo LEFT JOIN closed b ON b.series = t.series AND b.label = lo + {B})"""


def arrival_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issue ledger with its interpolated target and the clock at which it closes."""
    return bk.point_target(issues(spark, sf_dir), bk.closed_series(readings(spark, sf_dir)), STANDARD.lead, B)


@query("e01_arrival_target", f"{TARGET} SELECT issue_id, round(target, 6) AS target, complete FROM targets")
def arrival_target(spark, sf_dir):
    return arrival_targets(spark, sf_dir).select("issue_id", r6("target").alias("target"), "complete")


@query("f08_change_classes", f"{TARGET} SELECT issue_id, CASE WHEN d <= -40 THEN 0 WHEN d <= -20 THEN 1 WHEN d < 20 THEN 2 WHEN d < 40 THEN 3 WHEN d >= 40 THEN 4 END::BIGINT AS class, d <= -20 AS fell, d >= 20 AS rose FROM (SELECT issue_id, target - ref AS d FROM targets)")
def change_classes(spark, sf_dir):
    d = F.col("target") - F.col("ref")
    return arrival_targets(spark, sf_dir).select("issue_id", bk.change_class(d).cast("long").alias("class"), (d <= -20).alias("fell"), (d >= 20).alias("rose"))


@query("a05_window_extrema", f""" SELECT a.series, a.label, CASE WHEN count(b.med) = 8 THEN round(avg(b.med), 6) END AS mean, CASE WHEN count(b.med) = 8 THEN round(min(b.med), 6) END AS low,
  CASE WHEN count(b.med) = 8 THEN round(max(b.med), 6) END AS high, a.label + 14 * {B} AS complete
  FROM closed a LEFT JOIN closed b ON a.series = b.series AND b.label BETWEEN a.label + 7 * {B} AND a.label + 14 * {B} GROUP BY a.series, a.label""")
def window_extrema(spark, sf_dir):
    out = bk.window_values(bk.closed_series(readings(spark, sf_dir)), 7, 14, B)
    return out.select("series", "label", *(r6(c).alias(c) for c in ("mean", "low", "high")), "complete")


@query("a04_window_mean", f""", w AS (
  SELECT issue_id, series, l AS label, (least(l, e) - greatest(l - {B}, s)) / (e - s)::DOUBLE AS w, e FROM (
    SELECT issue_id, series, issue_us + {12 * HOUR} AS s, issue_us + {28 * HOUR} AS e, unnest(range((issue_us + {12 * HOUR}) // {B} * {B} + {B}, (issue_us + {28 * HOUR} + {B} - 1) // {B} * {B} + 1, {B})) AS l FROM issues))
  SELECT issue_id, CASE WHEN count(med) = count(*) THEN round(sum(med * w), 6) END AS target, max(label) AS complete FROM w LEFT JOIN closed USING (series, label) GROUP BY issue_id""")
def window_mean(spark, sf_dir):
    s, e = F.col("issue_us") + STANDARD.lead, F.col("issue_us") + STANDARD.lead + STANDARD.window
    spread = issues(spark, sf_dir).select("issue_id", "series", s.alias("s"), e.alias("e"), F.explode(F.sequence(bk.anchor(s, B) + B, bk.bucket_label(e, B), F.lit(B))).alias("label"))
    weight = (F.least("label", "e") - F.greatest(F.col("label") - B, F.col("s"))) / (F.col("e") - F.col("s"))
    joined = spread.withColumn("w", weight).join(bk.closed_series(readings(spark, sf_dir)), ["series", "label"], "left")
    return joined.groupBy("issue_id").agg(r6(F.when(F.count("med") == F.count(F.lit(1)), F.sum(F.col("med") * F.col("w")))).alias("target"), F.max("label").alias("complete"))


@query("a06_session_mean", f""", d AS (SELECT DISTINCT series, (label - 1) // {DAY} * {DAY} AS day FROM closed)
  SELECT d.series, d.day, CASE WHEN count(c.med) = 4 THEN round(avg(c.med), 6) END AS mean FROM d LEFT JOIN closed c ON c.series = d.series AND c.label > d.day + {8 * HOUR} AND c.label <= d.day + {16 * HOUR} GROUP BY d.series, d.day""")
def session_mean(spark, sf_dir):
    day = bk.anchor(F.col("label") - 1, DAY)
    inside = (F.col("label") > F.col("day") + 8 * HOUR) & (F.col("label") <= F.col("day") + 16 * HOUR)
    value = F.when(inside, F.col("med"))
    return bk.closed_series(readings(spark, sf_dir)).withColumn("day", day).groupBy("series", "day").agg(r6(F.when(F.count(value) == 4, F.avg(value))).alias("mean"))


FIRST = f""", leads AS (
  SELECT a.series, a.label, a.med, s.s AS step, b.med - a.med AS d FROM closed a CROSS JOIN (SELECT unnest(range(1, 7)) AS s) s LEFT JOIN closed b ON b.series = a.series AND b.label = a.label + s.s * {B}),
crossing AS (
  SELECT series, label, count(d) AS n, min(CASE WHEN abs(d) >= 20 THEN step END) AS step, arg_min(sign(d), step) FILTER (abs(d) >= 20) AS dir FROM leads GROUP BY series, label)"""


def first_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, label, n, step, dir: the first of six leads whose change reaches the threshold."""
    out = bk.closed_series(readings(spark, sf_dir))
    for k in range(1, 7):
        out = bk.at_offset(out, k, B, f"m{k}")
    deltas = [F.col(f"m{k}") - F.col("med") for k in range(1, 7)]
    step = F.coalesce(*(F.when(F.abs(d) >= 20, F.lit(k)) for k, d in enumerate(deltas, 1)))
    sign = F.coalesce(*(F.when(F.abs(d) >= 20, F.signum(d)) for d in deltas))
    n = sum((d.isNotNull().cast("int") for d in deltas), F.lit(0))
    return out.select("series", "label", n.cast("long").alias("n"), step.cast("long").alias("step"), sign.cast("long").alias("dir"))


@query("e02_first_crossing", f"{FIRST} SELECT series, label, CASE WHEN n = 6 THEN step END AS step, CASE WHEN n = 6 THEN coalesce(dir, 0) END::BIGINT AS dir FROM crossing")
def first_crossing(spark, sf_dir):
    whole = F.col("n") == 6
    return first_crossings(spark, sf_dir).select("series", "label", F.when(whole, F.col("step")).alias("step"), F.when(whole, F.coalesce("dir", F.lit(0))).alias("dir"))


@query("e03_risk_rows", f"{FIRST} SELECT series, label, s AS step, CASE WHEN s = step THEN dir ELSE 0 END::BIGINT AS cause FROM (SELECT *, unnest(range(1, 1 + coalesce(step, 6))) AS s FROM crossing WHERE n = 6)")
def risk_rows(spark, sf_dir):
    rows = first_crossings(spark, sf_dir).where("n = 6")
    spread = rows.withColumn("s", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("step", F.lit(6).cast("long")))))
    return spread.select("series", "label", F.col("s").alias("step"), F.when(F.col("s") == F.col("step"), F.col("dir")).otherwise(0).cast("long").alias("cause"))


def change_report(spark: SparkSession, sf_dir: str, clocks: Clocks = STANDARD) -> DataFrame:
    """Per series: how far the closed level is from the one six buckets on, and how many large changes come in how many episodes."""
    pairs = bk.at_offset(bk.closed_series(readings(spark, sf_dir), clocks), 6, clocks.bucket, "ahead").where("ahead is not null")
    pairs = pairs.withColumn("delta", F.col("ahead") - F.col("med")).withColumn("dir", bk.direction(F.col("delta")))
    order = Window.partitionBy("series").orderBy("label")
    changes = pairs.where("dir <> 0").withColumn("new", F.coalesce((F.col("label") - F.lag("label").over(order) > 2 * clocks.bucket) | (F.col("dir") != F.lag("dir").over(order)), F.lit(True)))
    episodes = changes.groupBy("series").agg(F.count_if("new").alias("episodes"))
    totals = pairs.groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs("delta"))).alias("mae"), r6(F.avg("delta")).alias("bias"), F.count_if(F.col("dir") != 0).alias("missed"))
    return totals.join(episodes, "series", "left").select("series", "n", "mae", "bias", "missed", F.coalesce("episodes", F.lit(0)).alias("episodes"))


@query("flagship_change_report", f""", pairs AS (
  SELECT a.series, a.label, b.med - a.med AS delta, CASE WHEN abs(b.med - a.med) >= 20 THEN sign(b.med - a.med) ELSE 0 END AS dir FROM closed a JOIN closed b ON a.series = b.series AND b.label = a.label + 6 * {B}),
ep AS (
  SELECT series, count(*) FILTER (is_new) AS episodes FROM (
    SELECT series, coalesce(label - lag(label) OVER w > 2 * {B} OR dir <> lag(dir) OVER w, TRUE) AS is_new FROM pairs WHERE dir <> 0 WINDOW w AS (PARTITION BY series ORDER BY label)) GROUP BY series)
  SELECT p.series, count(*) AS n, round(avg(abs(delta)), 6) AS mae, round(avg(delta), 6) AS bias, count(*) FILTER (dir <> 0) AS missed, coalesce(max(episodes), 0) AS episodes FROM pairs p LEFT JOIN ep USING (series) GROUP BY p.series""")
def flagship(spark, sf_dir):
    return change_report(spark, sf_dir)
