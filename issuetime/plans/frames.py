"""Window features: trailing statistics, lags, gap-safe changes, runs and segments."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.operators import frames as fr
from issuetime.plans.targets import B, r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, MINUTE, STANDARD, issues, readings

SPAN, AGE = STANDARD.span, STANDARD.max_age


def closed(spark, sf_dir):
    return bk.closed_series(readings(spark, sf_dir))


def frame(span: int, shift: int = 0) -> str:
    return f"(PARTITION BY series ORDER BY us RANGE BETWEEN {shift + span - 1} PRECEDING AND {shift} PRECEDING)"


@query("w01_fresh_reference", f" SELECT obs_id, round(quantile_cont(v, 0.5) OVER {frame(SPAN)}, 6) AS fresh FROM readings")
def fresh_reference(spark, sf_dir):
    return fr.fresh_reference(readings(spark, sf_dir), SPAN, AGE).select("obs_id", r6("fresh").alias("fresh"))


LAGS = (2 * HOUR, 6 * HOUR)


@query("w02_raw_lags", f""", x AS (SELECT obs_id, us, v, {', '.join(f"quantile_cont(v, 0.5) OVER {frame(SPAN, s)} AS m{i}, max(us) OVER {frame(SPAN, s)} AS t{i}" for i, s in enumerate(LAGS))} FROM readings)
  SELECT obs_id, {', '.join(f"round(CASE WHEN us - {s} - t{i} <= {AGE} THEN v - m{i} END, 6) AS d{i}" for i, s in enumerate(LAGS))} FROM x""")
def raw_lags(spark, sf_dir):
    out = fr.fresh_references(readings(spark, sf_dir), SPAN, AGE, {f"m{i}": s for i, s in enumerate(LAGS)})
    return out.select("obs_id", *(r6(F.col("v") - F.col(f"m{i}")).alias(f"d{i}") for i in range(len(LAGS))))


@query("w03_trailing_stats", f""", x AS (SELECT obs_id, count(*) OVER w AS n, stddev_pop(v) OVER w AS sd, max(v) OVER w - min(v) OVER w AS rng, regr_slope(v, us / 60000000.0::DOUBLE - 28401120) OVER w AS slope
    FROM readings WINDOW w AS {frame(6 * HOUR)})
  SELECT obs_id, n, round(CASE WHEN n >= 3 THEN sd END, 5) AS sd, round(CASE WHEN n >= 2 THEN rng END, 5) AS range, round(CASE WHEN n >= 3 THEN slope END, 5) AS slope FROM x""")
def trailing_stats(spark, sf_dir):
    x, n = fr.trailing_stats(readings(spark, sf_dir), 6 * HOUR), F.col("n")
    stats = [(fr.least_rows(F.col("sd"), n, 3), "sd"), (fr.least_rows(F.col("high") - F.col("low"), n, 2), "range"), (fr.least_rows(F.col("slope"), n, 3), "slope")]
    return x.select("obs_id", "n", *(F.round(c, 5).alias(a) for c, a in stats))


@query("w04_sequence_bins", f""" SELECT i.issue_id, (i.issue_us - r.us) // {30 * MINUTE} AS bin, count(*) AS n, round(avg(r.v), 5) AS v FROM issues i JOIN readings r
  ON r.series = i.series AND r.us > i.issue_us - {5 * HOUR} AND r.us <= i.issue_us GROUP BY ALL""")
def sequence_bins(spark, sf_dir):
    met = fr.trailing_bins(issues(spark, sf_dir), readings(spark, sf_dir), "issue_us", "us", 30 * MINUTE, 10, "issue_id")
    return met.select("issue_id", "bin", "n", F.round("mean", 5).alias("v"))


@query("w06_gap_safe_change", f" SELECT a.series, a.label, round(a.med - b.med, 6) AS change, round((a.med - b.med) / nullif(b.med, 0), 6) AS share FROM closed a LEFT JOIN closed b ON a.series = b.series AND b.label = a.label - {2 * B}")
def gap_safe_change(spark, sf_dir):
    out = bk.at_offset(closed(spark, sf_dir), -2, B, "b")
    d = F.col("med") - F.col("b")
    return out.select("series", "label", r6(d).alias("change"), r6(F.try_divide(d, F.col("b"))).alias("share"))


@query("w07_rolling", f""", x AS (SELECT series, label, count(*) OVER w AS n, quantile_cont(med, 0.5) OVER w AS m, avg(med) OVER w AS a FROM closed WINDOW w AS (PARTITION BY series ORDER BY label RANGE BETWEEN {5 * B} PRECEDING AND CURRENT ROW))
  SELECT series, label, n, round(CASE WHEN n >= 3 THEN m END, 6) AS med, round(CASE WHEN n >= 4 THEN a END, 7) AS mean FROM x""")
def rolling(spark, sf_dir):
    w = fr.steps_back(6, B)
    n = F.count("med").over(w)
    return closed(spark, sf_dir).select("series", "label", n.alias("n"), r6(fr.least_rows(fr.median_over("med", w), n, 3)).alias("med"), F.round(fr.least_rows(F.avg("med").over(w), n, 4), 7).alias("mean"))


@query("w08_rolling_mad", f""", x AS (SELECT series, label, med, quantile_cont(med, 0.5) OVER w AS m FROM closed WINDOW w AS (PARTITION BY series ORDER BY label RANGE BETWEEN {5 * B} PRECEDING AND CURRENT ROW))
  SELECT series, label, round(quantile_cont(abs(med - m), 0.5) OVER (PARTITION BY series ORDER BY label RANGE BETWEEN {5 * B} PRECEDING AND CURRENT ROW), 6) AS mad FROM x""")
def rolling_mad(spark, sf_dir):
    w = fr.steps_back(6, B)
    x = closed(spark, sf_dir).withColumn("off", F.abs(F.col("med") - fr.median_over("med", w)))
    return x.select("series", "label", r6(fr.median_over("off", w)).alias("mad"))


@query("w09_segmented_ewm", f""", s AS (SELECT *, row_number() OVER (PARTITION BY series, seg ORDER BY label) AS i FROM (SELECT *, sum(j) OVER (PARTITION BY series ORDER BY label) AS seg FROM (
      SELECT *, CASE WHEN label - lag(label) OVER (PARTITION BY series ORDER BY label) > {B} THEN 1 ELSE 0 END AS j FROM closed))),
  e AS (SELECT series, seg, i, label, med AS ewm FROM s WHERE i = 1 UNION ALL SELECT s.series, s.seg, s.i, s.label, e.ewm * (1 - 2.0::DOUBLE / 5) + s.med * (2.0::DOUBLE / 5) FROM e JOIN s ON s.series = e.series AND s.seg = e.seg AND s.i = e.i + 1)
  SELECT series, label, round(ewm, 6) AS ewm FROM e""", recursive=True)
def segmented_ewm(spark, sf_dir):
    return fr.segmented_ewm(closed(spark, sf_dir), 4, B).select("series", "label", r6("ewm").alias("ewm"))


@query("w10_w11_runs_and_falls", f""", x AS (SELECT a.series, a.label, a.med, a.med - b.med AS d FROM closed a LEFT JOIN closed b ON a.series = b.series AND b.label = a.label - {B})
  SELECT series, label, count(*) OVER w = 4 AS complete, (count(*) FILTER (d < 0) OVER w)::BIGINT AS falls FROM x WINDOW w AS (PARTITION BY series ORDER BY label RANGE BETWEEN {3 * B} PRECEDING AND CURRENT ROW)""")
def runs_and_falls(spark, sf_dir):
    w = fr.steps_back(4, B)
    x = bk.at_offset(closed(spark, sf_dir), -1, B, "b").withColumn("d", F.col("med") - F.col("b"))
    return x.select("series", "label", (F.count("med").over(w) == 4).alias("complete"), F.coalesce(F.sum((F.col("d") < 0).cast("long")).over(w), F.lit(0)).alias("falls"))


@query("w12_segments", f", x AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY series ORDER BY us) > {HOUR} THEN 1 ELSE 0 END AS j FROM readings), y AS (SELECT *, sum(j) OVER (PARTITION BY series ORDER BY us) AS seg FROM x) SELECT series, seg::BIGINT AS segment, count(*) AS n, min(us) AS first, max(us) AS last FROM y GROUP BY series, seg")
def gap_segments(spark, sf_dir):
    out = fr.segments(readings(spark, sf_dir), HOUR)
    return out.groupBy("series", F.col("segment").cast("long").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))


HISTORY = (6, 12, 48)


@query("w14_history", " SELECT series, label, " + ", ".join(f"round(CASE WHEN count(*) OVER w{h} >= {h // 4} THEN avg(med) OVER w{h} END, 7) AS mean{h}" for h in HISTORY) + f", min(med) OVER w48 AS low48 FROM closed WINDOW " + ", ".join(f"w{h} AS (PARTITION BY series ORDER BY label RANGE BETWEEN {h * HOUR - B} PRECEDING AND CURRENT ROW)" for h in HISTORY))
def history(spark, sf_dir):
    w = {h: fr.steps_back(h * HOUR // B, B) for h in HISTORY}
    means = [F.round(fr.least_rows(F.avg("med").over(w[h]), F.count("med").over(w[h]), h // 4), 7).alias(f"mean{h}") for h in HISTORY]
    return closed(spark, sf_dir).select("series", "label", *means, F.min("med").over(w[48]).alias("low48"))


@query("w13_diurnal_anomaly", f""", x AS (SELECT a.series, a.label, a.med, quantile_cont(b.med, 0.5) AS profile, count(b.med) AS n FROM closed a LEFT JOIN closed b ON a.series = b.series AND b.label IN (SELECT a.label - d * {DAY} FROM range(1, 8) t(d)) GROUP BY ALL)
  SELECT series, label, n, round(profile, 6) AS profile, round(med - profile, 6) AS anomaly FROM x""")
def diurnal_anomaly(spark, sf_dir):
    out = closed(spark, sf_dir)
    for d in range(1, 8):
        out = bk.at_offset(out, -d * DAY // B, B, f"d{d}")
    kept = F.array_sort(F.filter(F.array(*(F.col(f"d{d}") for d in range(1, 8))), lambda x: x.isNotNull()))
    n = F.size(kept)
    at = lambda i: F.try_element_at(kept, i)
    mid = (at(F.floor((n + 1) / 2).cast("int")) + at(F.floor((n + 2) / 2).cast("int"))) / 2
    profile = F.when(n > 0, mid)
    return out.select("series", "label", n.cast("long").alias("n"), r6(profile).alias("profile"), r6(F.col("med") - profile).alias("anomaly"))


@query("w15_forward_baseline", f""" SELECT a.series, a.label, CASE WHEN count(b.med) = 3 THEN round(avg(b.med) - a.med, 7) END AS mean_error, CASE WHEN count(b.med) = 3 THEN round(max(b.med) - a.med, 6) END AS peak_error
  FROM closed a LEFT JOIN closed b ON a.series = b.series AND b.label BETWEEN a.label + {2 * B} AND a.label + {4 * B} GROUP BY a.series, a.label, a.med""")
def forward_baseline(spark, sf_dir):
    out = bk.window_values(closed(spark, sf_dir), 2, 4, B)
    return out.select("series", "label", F.round(F.col("mean") - F.col("med"), 7).alias("mean_error"), r6(F.col("high") - F.col("med")).alias("peak_error"))


@query("w17_episode_low", f""", x AS (SELECT *, min(med) OVER (PARTITION BY series, (label - 1) // {DAY} ORDER BY label) AS low, lead(med) OVER (PARTITION BY series, (label - 1) // {DAY} ORDER BY label) AS nxt FROM closed)
  SELECT series, (label - 1) // {DAY} AS day, min(low) AS low, min(CASE WHEN med > greatest(low + 10, 1.2 * low) AND nxt > greatest(low + 10, 1.2 * low) THEN label END) AS rebound FROM x GROUP BY ALL""")
def episode_low(spark, sf_dir):
    order = Window.partitionBy("series", "day").orderBy("label")
    x = closed(spark, sf_dir).withColumn("day", F.expr(f"(label - 1) div {DAY}")).withColumn("low", F.min("med").over(order)).withColumn("next", F.lead("med").over(order))
    bar = F.greatest(F.col("low") + 10, 1.2 * F.col("low"))
    return x.groupBy("series", "day").agg(F.min("low").alias("low"), F.min(F.when((F.col("med") > bar) & (F.col("next") > bar), F.col("label"))).alias("rebound"))


@query("w18_shifted_placebo", f" SELECT a.series, a.label, round(b.med, 6) AS placebo FROM closed a LEFT JOIN closed b ON a.series = b.series AND b.label = a.label - {DAY}")
def shifted_placebo(spark, sf_dir):
    return bk.at_offset(closed(spark, sf_dir), -DAY // B, B, "placebo").select("series", "label", r6("placebo").alias("placebo"))


@query("w19_derived_features", f""" SELECT a.series, a.label, round(ln(a.med + 5), 6) AS log_level, round(a.med - b.med, 6) AS change1, round(a.med - avg(c.med), 7) AS over_mean FROM closed a
  LEFT JOIN closed b ON a.series = b.series AND b.label = a.label - {B} LEFT JOIN closed c ON c.series = a.series AND c.label BETWEEN a.label - {11 * B} AND a.label GROUP BY a.series, a.label, a.med, b.med""")
def derived_features(spark, sf_dir):
    out = bk.at_offset(closed(spark, sf_dir), -1, B, "b")
    mean = F.avg("med").over(fr.steps_back(12, B))
    return out.select("series", "label", r6(F.log(F.col("med") + 5)).alias("log_level"), r6(F.col("med") - F.col("b")).alias("change1"), F.round(F.col("med") - mean, 7).alias("over_mean"))
