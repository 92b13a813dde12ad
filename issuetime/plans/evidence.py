"""Further evidence: files read back, publication by gates, metric tables, block resampling, array medians."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.operators import scores as sc
from issuetime.operators import selection as sel
from issuetime.plans.scoring import DAYS, KNOWN, SCORED, day_sums, known_before, scored
from issuetime.plans.streams import work_dir
from issuetime.plans.targets import B, r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, issues, readings, table
from issuetime.sources import files

MID = 1_705_276_800_000_000


@query("s11_csv_round_trip", " SELECT us, series, v FROM readings")
def csv_round_trip(spark, sf_dir):
    path = f"{work_dir(spark)}/csv"
    files.export_csv(readings(spark, sf_dir), ["us", "series", "v"], path)
    return spark.read.schema("us bigint, series string, v double").option("header", True).csv(path)


@query("s09_json_lines", f" SELECT issue_id, recorded_us, round(pred, 6) AS pred FROM issues WHERE issue_id % 10 <> 0 AND recorded_us < {MID}")
def json_lines(spark, sf_dir):
    path = f"{work_dir(spark)}/jsonl"
    line = F.to_json(F.struct("issue_id", "recorded_us", "pred"))
    issues(spark, sf_dir).select(F.when(F.col("issue_id") % 10 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "issue_id bigint, recorded_us bigint, pred double", MID).select("issue_id", "recorded_us", r6("pred").alias("pred"))


@query("s05_detections", f"SELECT 3.0::DOUBLE + (event_id % 200 - 100) / 100.0::DOUBLE AS lat, 101.5::DOUBLE + ((event_id * 7) % 200 - 100) / 100.0::DOUBLE AS lon, (epoch_us(ts) // 60000000) * 60000000 AS acq_us, max(CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END) AS frp FROM events WHERE event_id % 11 <> 0 GROUP BY ALL", inputs=False)
def detections(spark, sf_dir):
    path = f"{work_dir(spark)}/detections"
    e = F.col("event_id")
    clock = F.regexp_replace(F.date_format("ts", "HHmm"), "^0", "")
    lat = F.when(e % 11 == 0, F.lit("95.0")).otherwise((3.0 + (e % 200 - 100) / 100.0).cast("string"))
    rows = table(spark, sf_dir, "events").select(lat.alias("latitude"), (101.5 + (e * 7 % 200 - 100) / 100.0).alias("longitude"), F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), clock.alias("acq_time"), F.when(e % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("frp"))
    rows.unionByName(rows.where(F.col("acq_time") < "5")).write.option("header", True).csv(path)
    return files.load_detections(spark, path)


@query("v12_published_sessions", f"{KNOWN} SELECT i.issue_id, coalesce(1 - a / b > 0, FALSE) AS qualified, round(CASE WHEN coalesce(1 - a / b > 0, FALSE) THEN i.pred ELSE i.ref END, 6) AS published FROM issues i JOIN known k ON k.series = i.series AND k.day = i.issue_us // {DAY}")
def published_sessions(spark, sf_dir):
    """The forecast where its skill over persistence, from outcomes closed before the issue's day, is positive; else the level."""
    now = issues(spark, sf_dir).withColumn("day", F.expr(f"issue_us div {DAY}")).join(known_before(spark, sf_dir), ["series", "day"])
    ok = F.coalesce(1 - F.try_divide(F.col("a"), F.col("b")) > 0, F.lit(False))
    return now.select("issue_id", ok.alias("qualified"), r6(F.when(ok, F.col("pred")).otherwise(F.col("ref"))).alias("published"))


#: Metrics of day sums as (numerator, denominator), the same for all days, resampled days and left-out days.
METRICS = {"mae": ("a", "n"), "ref_mae": ("b", "n"), "ratio": ("a", "b")}


@query("x02_metric_table", f"{DAYS}, s AS (SELECT series, sum(a) AS a, sum(b) AS b, sum(n)::DOUBLE AS n FROM days GROUP BY series) SELECT series, metric, round(value, 6) AS value FROM (SELECT series, a / n AS mae, b / n AS ref_mae, a / b AS ratio FROM s) UNPIVOT (value FOR metric IN (mae, ref_mae, ratio))")
def metric_table(spark, sf_dir):
    wide = day_sums(spark, sf_dir).groupBy("series").agg(*(F.try_divide(F.sum(p), F.sum(q)).alias(m) for m, (p, q) in METRICS.items()))
    return wide.unpivot("series", list(METRICS), "metric", "value").withColumn("value", r6("value"))


@query("v02_candidate_scores", f"{SCORED}, p AS (SELECT series, count(*) AS n, avg(abs(pred - target)) AS mae, avg((p_fall - (d <= -20)::INT) ** 2) AS brier FROM scored GROUP BY series), q AS (SELECT series, avg(y) * (1 - avg(y)) AS always FROM (SELECT series, (d <= -20)::INT AS y FROM scored) GROUP BY series) SELECT series, n, round(mae, 6) AS mae, round(brier, 6) AS brier, round(always, 6) AS prior_brier FROM p JOIN q USING (series)")
def candidate_scores(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("y", (F.col("d") <= -20).cast("int"))
    base = F.avg("y")
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("pred") - F.col("target")))).alias("mae"), r6(F.avg(F.pow(F.col("p_fall") - F.col("y"), 2))).alias("brier"), r6(base * (1 - base)).alias("prior_brier"))


BLOCK, DRAWS = 3, 100


@query("a32_block_bootstrap", f"""{DAYS}, r AS (SELECT series, min(day) AS first, max(day) - min(day) + 1 AS span FROM days GROUP BY series),
  p AS (SELECT series, first, span, draw, unnest(range((span + {BLOCK - 1}) // {BLOCK})) AS place FROM (SELECT *, unnest(range({DRAWS})) AS draw FROM r)),
  q AS (SELECT series, first, span, draw, (((draw * 7919 + place * 104729 + 999) % 2147483647 * 48271 % 2147483647 * 48271 % 2147483647) % span + o) % span AS at FROM p CROSS JOIN (SELECT unnest(range({BLOCK})) AS o)),
  f AS (SELECT q.series, q.draw, (sum(a) - sum(b)) / sum(n) AS diff FROM q JOIN days d ON d.series = q.series AND d.day = q.first + q.at GROUP BY q.series, q.draw)
  SELECT series, round(quantile_cont(diff, 0.05), 6) AS low, round(quantile_cont(diff, 0.95), 6) AS high FROM f GROUP BY series""")
def block_bootstrap(spark, sf_dir):
    """Blocks of consecutive calendar days, empty ones included, wrapping at the end."""
    days = day_sums(spark, sf_dir)
    spans = days.groupBy("series").agg(F.min("day").alias("first"), (F.max("day") - F.min("day") + 1).alias("span"))
    places = spans.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(span + {BLOCK - 1}) div {BLOCK} - 1"))))
    x = (F.col("draw") * 7919 + F.col("place") * 104_729 + 999) % 2_147_483_647
    start = (x * 48_271 % 2_147_483_647 * 48_271 % 2_147_483_647) % F.col("span")
    picked = places.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).select("series", "draw", (F.col("first") + (start + F.col("o")) % F.col("span")).alias("day"))
    diff = picked.join(days, ["series", "day"]).groupBy("series", "draw").agg(((F.sum("a") - F.sum("b")) / F.sum("n")).alias("diff"))
    return diff.groupBy("series").agg(r6(F.percentile("diff", 0.05)).alias("low"), r6(F.percentile("diff", 0.95)).alias("high"))


@query("f20_array_weighted_median", ", c AS (SELECT label, med, sum(w) OVER (PARTITION BY label ORDER BY med) AS c, sum(w) OVER (PARTITION BY label) AS t FROM (SELECT label, med, sum(length(series)) AS w FROM closed GROUP BY label, med)) SELECT label, round(min(med) FILTER (c >= 0.5 * t), 6) AS med FROM c GROUP BY label")
def array_weighted_median(spark, sf_dir):
    from issuetime.functions.probability import array_weighted_median as median

    rows = bk.closed_series(readings(spark, sf_dir)).groupBy("label").agg(F.collect_list(F.struct(F.col("med").alias("v"), F.length("series").cast("double").alias("w"))).alias("x"))  # a handful of series
    return rows.select("label", r6(median(F.col("x"))).alias("med"))


@query("w05_block_transforms", f""", x AS (SELECT a.series, a.label, {', '.join(f"max(CASE WHEN b.label = a.label - {k} * {B} THEN b.med END) AS m{k}" for k in range(4))} FROM closed a JOIN closed b ON b.series = a.series AND b.label BETWEEN a.label - {3 * B} AND a.label GROUP BY a.series, a.label)
  SELECT series, label, round((m0 + m1) / 2 - (m2 + m3) / 2, 6) AS change, round(m0 - 2 * m1 + m2, 6) AS bend FROM x""")
def block_transforms(spark, sf_dir):
    out = bk.closed_series(readings(spark, sf_dir)).withColumn("m0", F.col("med"))
    for k in (1, 2, 3):
        out = bk.at_offset(out, -k, B, f"m{k}")
    m = [F.col(f"m{k}") for k in range(4)]
    return out.select("series", "label", r6((m[0] + m[1]) / 2 - (m[2] + m[3]) / 2).alias("change"), r6(m[0] - 2 * m[1] + m[2]).alias("bend"))


@query("l05_separated_nearest")
def separated_nearest(spark, sf_dir):
    """Per series the five readings nearest to a level of 50, no two within half a day, the closest first."""
    rows = readings(spark, sf_dir).select("series", "us", F.abs(F.col("v") - 50).alias("d"))
    return sel.separated_nearest(rows, 5, 12 * HOUR, "us", "series", "d").select("series", "us", "d")


def case_features(rows):
    """series, us and what cases are compared by: level, change over two hours, and the clock as a point on a circle; null where a value is missing."""
    from issuetime.plans.datasets import feature_rows

    met = rows.select("series", F.col("obs_id").alias("issue_id"), "us", "v").join(feature_rows(rows).drop("us"), "issue_id")
    angle = 2 * F.pi() * F.col("x_hour") / 24
    return met.select("series", "us", (F.log(F.col("v") + 5)).alias("level"), (F.col("x_change") / 50).alias("change"), F.sin(angle).alias("sin"), F.cos(angle).alias("cos"))


@query("l05_separated_cases")
def separated_cases(spark, sf_dir):
    """Of each series the five past cases most like its newest one by level, change and clock, a day old at least, no two within half a day."""
    from issuetime.plans.forecasters import kept

    cases = kept(case_features(readings(spark, sf_dir)).dropna(), "cases")
    names = ("level", "change", "sin", "cos")
    newest = cases.groupBy("series").agg(F.max_by(F.struct("us", *names), "us").alias("now"))  # a row a series
    met = cases.join(newest, "series").where(F.col("us") <= F.col("now.us") - DAY)
    far = sum(((F.col(n) - F.col(f"now.{n}")) ** 2 for n in names[1:]), (F.col("level") - F.col("now.level")) ** 2)
    met = kept(met.select("series", "us", far.alias("d")), "distances")
    return sel.separated_nearest(met, 5, 12 * HOUR, "us", "series", "d").select("series", "us", "rank", r6("d").alias("d"))


@query("u08_daily_concat", f"{SCORED}, m AS (SELECT series, day, avg(target - ref) AS shift FROM scored GROUP BY series, day) SELECT i.issue_id, round(i.ref + m.shift, 5) AS pred FROM issues i LEFT JOIN m ON m.series = i.series AND m.day = i.issue_us // {DAY} - 2")
def daily_concat(spark, sf_dir):
    """Predictions of all days in one job, joined back to every issue."""
    shift = scored(spark, sf_dir).groupBy("series", (F.col("day") + 2).alias("day")).agg(F.avg(F.col("target") - F.col("ref")).alias("shift"))
    now = issues(spark, sf_dir).withColumn("day", F.expr(f"issue_us div {DAY}"))
    return now.join(shift, ["series", "day"], "left").select("issue_id", F.round(F.col("ref") + F.col("shift"), 5).alias("pred"))


@query("e15_dispersion_watch", f" SELECT series, label, coalesce((label % {DAY}) BETWEEN {4 * HOUR} AND {12 * HOUR} AND d1 < 0 AND d2 < 0 AND d1 + d2 <= -10, FALSE) AS watch FROM (SELECT a.series, a.label, a.med - b.med AS d1, b.med - c.med AS d2 FROM closed a LEFT JOIN closed b ON b.series = a.series AND b.label = a.label - {B} LEFT JOIN closed c ON c.series = a.series AND c.label = a.label - {2 * B})")
def dispersion_watch(spark, sf_dir):
    x = bk.at_offset(bk.at_offset(bk.closed_series(readings(spark, sf_dir)), -1, B, "b"), -2, B, "c")
    d1, d2 = F.col("med") - F.col("b"), F.col("b") - F.col("c")
    morning = (F.col("label") % DAY).between(4 * HOUR, 12 * HOUR)
    return x.select("series", "label", F.coalesce(morning & (d1 < 0) & (d2 < 0) & (d1 + d2 <= -10), F.lit(False)).alias("watch"))


@query("v10_level_bands", f""", p AS (SELECT a.series, a.med, b.med - a.med AS e, width_bucket FROM (SELECT *, least(floor(med / 25), 3) AS width_bucket FROM closed) a JOIN closed b ON b.series = a.series AND b.label = a.label + 6 * {B}),
  r AS (SELECT *, row_number() OVER (PARTITION BY series, width_bucket ORDER BY e) AS i, count(*) OVER (PARTITION BY series, width_bucket) AS n FROM p)
  SELECT series, width_bucket::BIGINT AS band, max(n) AS n, round(max(e) FILTER (i = greatest(1, floor((n + 1) * 0.1::DOUBLE))), 6) AS low, round(max(e) FILTER (i = least(n, ceil((n + 1) * 0.9::DOUBLE))), 6) AS high FROM r GROUP BY series, width_bucket""")
def level_bands(spark, sf_dir):
    x = bk.at_offset(bk.closed_series(readings(spark, sf_dir)), 6, B, "ahead").where("ahead is not null").withColumn("e", F.col("ahead") - F.col("med")).withColumn("band", F.least(F.floor(F.col("med") / 25), F.lit(3)))
    part = Window.partitionBy("series", "band")
    r = x.withColumn("i", F.row_number().over(part.orderBy("e"))).withColumn("n", F.count(F.lit(1)).over(part))
    low, high = F.greatest(F.lit(1.0), F.floor((F.col("n") + 1) * 0.1).cast("double")), F.least(F.col("n").cast("double"), F.ceil((F.col("n") + 1) * 0.9).cast("double"))
    pick = lambda rank: r6(F.max(F.when(F.col("i") == rank, F.col("e"))))
    return r.groupBy("series", "band").agg(F.max("n").alias("n"), pick(low).alias("low"), pick(high).alias("high"))
