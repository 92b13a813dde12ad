"""Verification: point, probability and event scores of the issue ledger, resampling, priors and evidence tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.operators import scores as sc
from issuetime.operators.ranks import quantiles, ranked
from issuetime.plans.targets import B, TARGET, arrival_targets, r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, issues, readings, table

SCORED = f"{TARGET}, scored AS (SELECT *, target - ref AS d, pred - ref AS call, (issue_us // {DAY}) AS day FROM targets WHERE target IS NOT NULL)"


def scored(spark, sf_dir):
    rows = arrival_targets(spark, sf_dir).where("target is not null")
    return rows.withColumn("d", F.col("target") - F.col("ref")).withColumn("call", F.col("pred") - F.col("ref")).withColumn("day", F.expr(f"issue_us div {DAY}"))


def rounded(df, keep):
    return df.select(*keep, *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keep))


POINT = "count(*) AS n, round(avg(abs(pred - target)), 6) AS mae, round(sqrt(avg((pred - target) ** 2)), 6) AS rmse, round(avg(pred - target), 6) AS bias, round(avg(abs(d)), 6) AS ref_mae, round(1 - avg(abs(pred - target)) / avg(abs(d)), 6) AS skill, round(avg(abs(pred - target)) FILTER (abs(d) >= 20), 6) AS big_mae"


@query("a24_point_metrics", f"{SCORED} SELECT series, version, {POINT} FROM scored GROUP BY series, version")
def point_metrics(spark, sf_dir):
    return rounded(scored(spark, sf_dir).groupBy("series", "version").agg(*sc.point_metrics("target", "pred", "ref")), ["series", "version"])


@query("a25_error_profile", f"{SCORED} SELECT series, round(quantile_cont(abs(pred - target), 0.9), 6) AS p90, round(avg((abs(pred - target) < abs(d))::INT), 6) AS wins FROM scored GROUP BY series")
def error_profile(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("e", F.abs(F.col("pred") - F.col("target")))
    wins = rows.groupBy("series").agg(r6(F.avg((F.col("e") < F.abs("d")).cast("int"))).alias("wins"))
    return quantiles(rows, "series", "e", {"p90": 0.9}).join(wins, "series").select("series", r6("p90").alias("p90"), "wins")


@query("a26_pinball", f"{SCORED} SELECT series, " + ", ".join(f"round(avg(greatest({t}::DOUBLE * (target - pred), ({t}::DOUBLE - 1) * (target - pred))), 6) AS q{int(100 * t)}" for t in (0.1, 0.5, 0.9)) + " FROM scored GROUP BY series")
def pinball_loss(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("series").agg(*(r6(sc.pinball(F.col("target"), F.col("pred"), t)).alias(f"q{int(100 * t)}") for t in (0.1, 0.5, 0.9)))


@query("a27_binary_scores", f"{SCORED} SELECT series, count(*) AS n, round(avg((p_fall - y) ** 2), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END), 6) AS log_loss, round(avg(y), 6) AS base_rate FROM (SELECT *, (d <= -20)::INT AS y, least(greatest(p_fall, 1e-15), 1 - 1e-15) AS c FROM scored) GROUP BY series")
def binary_scores(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("y", (F.col("d") <= -20).cast("int"))
    return rounded(rows.groupBy("series").agg(*sc.binary_scores("p_fall", "y")), ["series"])


@query("a27_quality_scores", " SELECT lang, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END), 6) AS log_loss, round(avg(y), 6) AS base_rate FROM (SELECT lang, quality AS y, least(1, n_chars / 20000.0::DOUBLE) AS p, least(greatest(least(1, n_chars / 20000.0::DOUBLE), 1e-15), 1 - 1e-15) AS c FROM documents JOIN labels USING (doc_id)) GROUP BY lang", inputs=False)
def quality_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("quality").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("p"))
    return rounded(rows.groupBy("lang").agg(*sc.binary_scores("p", "y")), ["lang"])


@query("a28_multiclass_scores", f"{SCORED} SELECT series, round(avg(pow(p_fall - (k = 0)::INT, 2) + pow(p_none - (k = 1)::INT, 2) + pow(p_rise - (k = 2)::INT, 2)), 6) AS brier, round(avg(-ln(greatest(CASE k WHEN 0 THEN p_fall WHEN 1 THEN p_none ELSE p_rise END, 1e-15))), 6) AS log_loss FROM (SELECT *, CASE WHEN d <= -20 THEN 0 WHEN d < 20 THEN 1 ELSE 2 END AS k FROM scored) GROUP BY series")
def multiclass_scores(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("k", F.when(F.col("d") <= -20, 0).when(F.col("d") < 20, 1).otherwise(2))
    ps = ["p_fall", "p_none", "p_rise"]
    brier = sum((F.pow(F.col(p) - (F.col("k") == i).cast("int"), 2) for i, p in enumerate(ps)), F.lit(0.0))
    picked = F.when(F.col("k") == 0, F.col("p_fall")).when(F.col("k") == 1, F.col("p_none")).otherwise(F.col("p_rise"))
    return rows.groupBy("series").agg(r6(F.avg(brier)).alias("brier"), r6(F.avg(-F.log(F.greatest(picked, F.lit(1e-15))))).alias("log_loss"))


EVENTS = f"{SCORED}, ev AS (SELECT *, CASE WHEN abs(d) >= 20 THEN sign(d) ELSE 0 END AS truth, CASE WHEN p_fall > p_rise AND p_fall > 0.2 THEN -1 WHEN p_rise > p_fall AND p_rise > 0.2 THEN 1 ELSE 0 END AS said FROM scored)"


def event_rows(spark, sf_dir):
    said = F.when((F.col("p_fall") > F.col("p_rise")) & (F.col("p_fall") > 0.2), -1).when((F.col("p_rise") > F.col("p_fall")) & (F.col("p_rise") > 0.2), 1).otherwise(0)
    return scored(spark, sf_dir).withColumn("truth", bk.direction(F.col("d"))).withColumn("said", said)


@query("a29_event_confusion", f"{EVENTS} SELECT series, count(*) FILTER (truth <> 0 AND said = truth) AS hits, count(*) FILTER (truth <> 0 AND said = 0) AS misses, count(*) FILTER (truth <> 0 AND said = -truth) AS wrong_way, count(*) FILTER (truth = 0 AND said <> 0) AS false_calls, round(count(*) FILTER (truth <> 0 AND said = truth) / count(*) FILTER (truth <> 0), 6) AS recall FROM ev GROUP BY series")
def event_confusion(spark, sf_dir):
    truth, said = F.col("truth"), F.col("said")
    hit = (truth != 0) & (said == truth)
    return event_rows(spark, sf_dir).groupBy("series").agg(F.count_if(hit).alias("hits"), F.count_if((truth != 0) & (said == 0)).alias("misses"), F.count_if((truth != 0) & (said == -truth)).alias("wrong_way"), F.count_if((truth == 0) & (said != 0)).alias("false_calls"), r6(F.try_divide(F.count_if(hit), F.count_if(truth != 0))).alias("recall"))


@query("e05_episodes", f"""{EVENTS}, f AS (SELECT *, CASE WHEN issue_us - lag(issue_us) OVER w > {4 * HOUR} OR truth <> lag(truth) OVER w THEN 1 ELSE 0 END AS j FROM ev WHERE truth <> 0 WINDOW w AS (PARTITION BY series ORDER BY issue_us)),
  g AS (SELECT *, sum(j) OVER (PARTITION BY series ORDER BY issue_us) AS island FROM f)
  SELECT series, min(issue_us) AS start, max(issue_us) AS stop, min(truth)::BIGINT AS dir, count(*) AS n, bool_or(said = truth) AS caught FROM g GROUP BY series, island""")
def episodes(spark, sf_dir):
    flagged = sc.islands(event_rows(spark, sf_dir).where("truth <> 0"), 4 * HOUR, "issue_us", "series", "truth")
    return flagged.groupBy("series", "island").agg(F.min("issue_us").alias("start"), F.max("issue_us").alias("stop"), F.min("truth").cast("long").alias("dir"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("said") == F.col("truth")).alias("caught")).drop("island")


@query("a30_reliability", f"{SCORED} SELECT b.bin, count(p) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS freq FROM (SELECT unnest(range(1, 11)) AS bin) b LEFT JOIN (SELECT p_fall AS p, (d <= -20)::INT AS y, least(floor(p_fall * 10)::BIGINT + 1, 10) AS bin FROM scored) s USING (bin) GROUP BY b.bin")
def reliability(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.col("p_fall").alias("p"), (F.col("d") <= -20).cast("int").alias("y"), F.least(F.floor(F.col("p_fall") * 10) + 1, F.lit(10)).alias("bin"))
    bins = spark.range(1, 11).withColumnRenamed("id", "bin")
    return bins.join(rows, "bin", "left").groupBy("bin").agg(F.count("p").alias("n"), r6(F.avg("p")).alias("mean_p"), r6(F.avg("y")).alias("freq"))


DAYS = f"{SCORED}, days AS (SELECT series, day, sum(abs(pred - target)) AS a, sum(abs(d)) AS b, count(*) AS n FROM scored GROUP BY series, day)"


def day_sums(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("series", "day").agg(F.sum(F.abs(F.col("pred") - F.col("target"))).alias("a"), F.sum(F.abs("d")).alias("b"), F.count(F.lit(1)).alias("n"))


@query("a31_day_bootstrap", f"""{DAYS}, o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS at, count(*) OVER (PARTITION BY series) AS days FROM days),
  p AS (SELECT series, days, draw, unnest(range(days)) AS place FROM (SELECT DISTINCT series, days, unnest(range(200)) AS draw FROM o)),
  q AS (SELECT series, draw, ((draw * 7919 + place * 104729 + 12345) % 2147483647 * 48271 % 2147483647 * 48271 % 2147483647) % days AS at FROM p),
  r AS (SELECT q.series, q.draw, (sum(a) - sum(b)) / sum(n) AS diff FROM q JOIN o ON o.series = q.series AND o.at = q.at GROUP BY q.series, q.draw)
  SELECT series, round(quantile_cont(diff, 0.05), 6) AS low, round(quantile_cont(diff, 0.95), 6) AS high, round(avg((diff < 0)::INT), 6) AS below FROM r GROUP BY series""")
def day_bootstrap(spark, sf_dir):
    return rounded(sc.day_bootstrap(day_sums(spark, sf_dir), 200), ["series"])


@query("a33_leave_one_day_out", f"{DAYS}, l AS (SELECT series, day, (sum(a) OVER w - a) / (sum(n) OVER w - n) AS mae FROM days WINDOW w AS (PARTITION BY series)) SELECT series, round(min(mae), 6) AS low, round(max(mae), 6) AS high FROM l GROUP BY series")
def leave_one_day_out(spark, sf_dir):
    w = Window.partitionBy("series")
    left = F.try_divide(F.sum("a").over(w) - F.col("a"), F.sum("n").over(w) - F.col("n"))
    return day_sums(spark, sf_dir).select("series", left.alias("mae")).groupBy("series").agg(r6(F.min("mae")).alias("low"), r6(F.max("mae")).alias("high"))


@query("a34_day_wins", f"{DAYS} SELECT series, count(*) AS days, count(*) FILTER (a < b) AS wins FROM days GROUP BY series")
def day_wins(spark, sf_dir):
    return day_sums(spark, sf_dir).groupBy("series").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("a") < F.col("b")).alias("wins"))


@query("a37_day_balanced", f"{DAYS} SELECT series, round(avg(a / n), 6) AS mae, round(avg(b / n), 6) AS ref_mae FROM days GROUP BY series")
def day_balanced(spark, sf_dir):
    return day_sums(spark, sf_dir).groupBy("series").agg(r6(F.avg(F.col("a") / F.col("n"))).alias("mae"), r6(F.avg(F.col("b") / F.col("n"))).alias("ref_mae"))


@query("a35_grouped_summary", f"{SCORED} SELECT series, version, grouping(series, version)::BIGINT AS level, {POINT} FROM scored GROUP BY GROUPING SETS ((series, version), (series), ())")
def grouped_summary(spark, sf_dir):
    rows = scored(spark, sf_dir)
    sets = rows.groupingSets([[rows.series, rows.version], [rows.series], []], "series", "version").agg(F.grouping_id("series", "version").alias("level"), *sc.point_metrics("target", "pred", "ref"))
    return rounded(sets, ["series", "version", "level"])


@query("a36_cohort_summary", f"{SCORED} SELECT cohort, count(*) AS n, round(avg(abs(pred - target)), 6) AS mae FROM (SELECT *, unnest(list_filter(['all', CASE WHEN ref > 80 THEN 'high' END, CASE WHEN abs(d) >= 20 THEN 'changed' END, CASE WHEN version = 'a' THEN 'a' END], lambda x: x IS NOT NULL)) AS cohort FROM scored) GROUP BY cohort")
def cohort_summary(spark, sf_dir):
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col("ref") > 80, F.lit("high")), F.when(F.abs("d") >= 20, F.lit("changed")), F.when(F.col("version") == "a", F.lit("a"))))
    return scored(spark, sf_dir).withColumn("cohort", F.explode(tags)).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("pred") - F.col("target")))).alias("mae"))


@query("a38_walk_forward_prior", f"""{SCORED}, d2 AS (SELECT DISTINCT series, day FROM scored)
  SELECT x.series, x.day, count(s.d) AS n, count(*) FILTER (s.d <= -20) AS falls, count(*) FILTER (s.d >= 20) AS rises FROM d2 x LEFT JOIN scored s ON s.series = x.series AND s.complete < x.day * {DAY} AND s.complete >= (x.day - 14) * {DAY} GROUP BY x.series, x.day""")
def walk_forward_prior(spark, sf_dir):
    rows = scored(spark, sf_dir)
    done = rows.withColumn("done", F.expr(f"complete div {DAY}")).groupBy("series", "done").agg(F.count("d").alias("n"), F.count_if(F.col("d") <= -20).alias("falls"), F.count_if(F.col("d") >= 20).alias("rises"))
    known = done.withColumn("day", F.explode(F.sequence(F.col("done") + 1, F.col("done") + 14))).groupBy("series", "day").agg(*(F.sum(c).alias(c) for c in ("n", "falls", "rises")))
    return rows.select("series", "day").distinct().join(known, ["series", "day"], "left").fillna(0, ["n", "falls", "rises"])


KNOWN = f"""{SCORED}, sums AS (SELECT series, complete // {DAY} AS closed_day, count(*) AS n, count(*) FILTER (d <= -20) AS falls, count(*) FILTER (d >= 20) AS rises, sum(abs(pred - target)) AS a, sum(abs(d)) AS b FROM scored GROUP BY ALL),
  known AS (SELECT i.series, i.day, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(falls), 0)::BIGINT AS falls, coalesce(sum(rises), 0)::BIGINT AS rises, sum(a) AS a, sum(b) AS b FROM (SELECT DISTINCT series, issue_us // {DAY} AS day FROM issues) i LEFT JOIN sums s ON s.series = i.series AND s.closed_day < i.day GROUP BY i.series, i.day)"""


def known_before(spark, sf_dir):
    """Per series and issue day what was known when the day began: n, falls, rises and error sums of the outcomes closed on earlier days."""
    rows = scored(spark, sf_dir)
    fell, rose = F.count_if(F.col("d") <= -20), F.count_if(F.col("d") >= 20)
    sums = rows.groupBy("series", F.expr(f"complete div {DAY}").alias("day")).agg(F.count(F.lit(1)).alias("n"), fell.alias("falls"), rose.alias("rises"), F.sum(F.abs(F.col("pred") - F.col("target"))).alias("a"), F.sum(F.abs("d")).alias("b"))
    days = issues(spark, sf_dir).select("series", F.expr(f"issue_us div {DAY}").alias("day")).distinct()
    before = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per series and day
    total = lambda c: F.sum(c).over(before).alias(c)
    out = days.withColumn("asked", F.lit(True)).join(sums, ["series", "day"], "full").select("series", "day", "asked", *(total(c) for c in ("n", "falls", "rises", "a", "b")))
    return out.where("asked").drop("asked").fillna(0, ["n", "falls", "rises"])


@query("a39_smoothed_prior", f"{KNOWN} SELECT i.issue_id, round((falls + 1) / (n + 3), 6) AS fall, round((rises + 1) / (n + 3), 6) AS rise FROM issues i JOIN known k ON k.series = i.series AND k.day = i.issue_us // {DAY}")
def smoothed_prior(spark, sf_dir):
    """The class prior as it could be issued: from outcomes that had closed before the issue's day."""
    now = issues(spark, sf_dir).withColumn("day", F.expr(f"issue_us div {DAY}")).join(known_before(spark, sf_dir), ["series", "day"])
    return now.select("issue_id", r6((F.col("falls") + 1) / (F.col("n") + 3)).alias("fall"), r6((F.col("rises") + 1) / (F.col("n") + 3)).alias("rise"))


TAUS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)


@query("a40_operating_curve", f"{SCORED} SELECT tau::DOUBLE AS tau, count(*) FILTER (d <= -20 AND p_fall >= tau) AS caught, count(*) FILTER (d > -20 AND p_fall >= tau) AS false_calls FROM scored CROSS JOIN (SELECT unnest({list(TAUS)}) AS tau) GROUP BY tau")
def operating_curve(spark, sf_dir):
    each = scored(spark, sf_dir).withColumn("tau", F.explode(F.array(*(F.lit(t) for t in TAUS))))
    said = F.col("p_fall") >= F.col("tau")
    return each.groupBy("tau").agg(F.count_if((F.col("d") <= -20) & said).alias("caught"), F.count_if((F.col("d") > -20) & said).alias("false_calls"))


@query("a41_ranking_scores", f"{SCORED}, r AS (SELECT series, (d <= -20)::INT AS y, rank() OVER (PARTITION BY series ORDER BY p_fall) + (count(*) OVER (PARTITION BY series, p_fall) - 1) / 2.0::DOUBLE AS rk FROM scored) SELECT series, sum(y)::BIGINT AS positives, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY series")
def ranking_scores(spark, sf_dir):
    rows = scored(spark, sf_dir).select("series", (F.col("d") <= -20).cast("int").alias("y"), "p_fall")
    rows = ranked(rows, "series", "p_fall").withColumnRenamed("average", "rk")
    y = F.sum("y")
    return rows.groupBy("series").agg(y.alias("positives"), r6(F.try_divide(F.sum(F.col("rk") * F.col("y")) - y * (y + 1) / 2, y * F.sum(1 - F.col("y")))).alias("auc"))


@query("a42_interval_coverage", f"{SCORED} SELECT series, round(avg((target BETWEEN pred - 30 AND pred + 30)::INT), 6) AS covered FROM scored GROUP BY series")
def interval_coverage(spark, sf_dir):
    inside = F.col("target").between(F.col("pred") - 30, F.col("pred") + 30)
    return scored(spark, sf_dir).groupBy("series").agg(r6(F.avg(inside.cast("int"))).alias("covered"))


@query("v11_split_scores", f"{SCORED} SELECT series, day // 7 AS week, count(*) AS n, round(avg(abs(pred - target)), 6) AS mae FROM scored GROUP BY ALL")
def split_scores(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("series", F.expr("day div 7").alias("week")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("pred") - F.col("target")))).alias("mae"))


@query("v13_day_table", f"{SCORED} SELECT day, day >= 19737 AS after, count(*) AS n, round(avg(abs(pred - target)), 6) AS mae, round(avg(abs(d)), 6) AS ref_mae, round(avg((p_fall - (d <= -20)::INT) ** 2), 6) AS brier FROM scored GROUP BY day")
def day_table(spark, sf_dir):
    brier = F.avg(F.pow(F.col("p_fall") - (F.col("d") <= -20).cast("int"), 2))
    return scored(spark, sf_dir).groupBy("day").agg((F.first("day") >= 19_737).alias("after"), F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("pred") - F.col("target")))).alias("mae"), r6(F.avg(F.abs("d"))).alias("ref_mae"), r6(brier).alias("brier"))


@query("a46_policy_gates", f"""{SCORED}, m AS (SELECT series, count(*) AS n, avg(abs(pred - target)) AS mae, 1 - avg(abs(pred - target)) / avg(abs(d)) AS skill FROM scored GROUP BY series)
  SELECT series, gate, round(value, 6) AS value, CASE gate WHEN 'n' THEN value >= 100 WHEN 'mae' THEN value <= 35 ELSE value >= 0 END AS passed FROM (SELECT series, n::DOUBLE AS n, mae, skill FROM m) UNPIVOT (value FOR gate IN (n, mae, skill))""")
def policy_gates(spark, sf_dir):
    m = scored(spark, sf_dir).groupBy("series").agg(*sc.point_metrics("target", "pred", "ref")).select("series", F.col("n").cast("double").alias("n"), "mae", "skill")
    value = F.col("value")
    passed = F.when(F.col("gate") == "n", value >= 100).when(F.col("gate") == "mae", value <= 35).otherwise(value >= 0)
    return m.unpivot("series", ["n", "mae", "skill"], "gate", "value").select("series", "gate", r6(value).alias("value"), passed.alias("passed"))


@query("m20_climatology_blend", f"{KNOWN} SELECT s.series, w::DOUBLE AS w, count(*) AS n, round(avg((w * p_fall + (1 - w) * falls / k.n::DOUBLE - (d <= -20)::INT) ** 2), 6) AS brier FROM scored s JOIN known k ON k.series = s.series AND k.day = s.day AND k.n > 0 CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w) GROUP BY s.series, w")
def climatology_blend(spark, sf_dir):
    """Issued probabilities blended with the base rate that was known before the issue's day, at five weights."""
    known = known_before(spark, sf_dir).where("n > 0").select("series", "day", (F.col("falls") / F.col("n")).alias("base"))
    rows = scored(spark, sf_dir).withColumn("y", (F.col("d") <= -20).cast("int")).join(known, ["series", "day"])
    each = rows.withColumn("w", F.explode(F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)))))
    return each.groupBy("series", "w").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.pow(F.col("w") * F.col("p_fall") + (1 - F.col("w")) * F.col("base") - F.col("y"), 2))).alias("brier"))
