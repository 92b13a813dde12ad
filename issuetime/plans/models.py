"""Walk-forward models and distributions of the issue ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuetime.operators import learn as ln
from issuetime.operators import ridge as rg
from issuetime.operators import scores as sc
from issuetime.plans.targets import TARGET, arrival_targets, r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, issues, readings

LOOK, HOLD = 14 * DAY, 44 * HOUR
TRAIN = f"""{TARGET}, days AS (SELECT DISTINCT series, issue_us // {DAY} AS day FROM issues),
train AS (SELECT t.*, d.day FROM targets t JOIN days d ON d.series = t.series AND t.target IS NOT NULL AND t.issue_us > d.day * {DAY} - {LOOK} AND t.issue_us < d.day * {DAY} - {HOLD} AND t.complete < d.day * {DAY})"""


def evaluated(spark, sf_dir):
    """Evaluation days of each series."""
    return issues(spark, sf_dir).select("series", F.expr(f"issue_us div {DAY}").alias("day")).distinct()


@query("p07_training_rows", f"{TRAIN} SELECT series, day, count(*) AS n, min(issue_id) AS first, max(issue_id) AS last FROM train GROUP BY series, day")
def training_rows(spark, sf_dir):
    parts = [F.count(F.lit(1)).alias("n"), F.min("issue_id").alias("least"), F.max("issue_id").alias("most")]
    rows = ln.training_sums(arrival_targets(spark, sf_dir), parts, [F.sum("n").alias("n"), F.min("least").alias("first"), F.max("most").alias("last")])
    return rows.join(evaluated(spark, sf_dir), ["series", "day"]).select("series", "day", "n", "first", "last")


@query("m02_ridge_days", f"{TRAIN}, s AS (SELECT series, day, count(*) AS n, avg(ref) AS mx, avg(target) AS my, count(*) * covar_pop(ref, target) AS sxy, count(*) * var_pop(ref) AS sxx FROM train GROUP BY series, day) SELECT series, day, n, round(sxy / (sxx + 100), 6) AS slope, round(my - sxy / (sxx + 100) * mx, 5) AS intercept FROM s")
def ridge_days(spark, sf_dir):
    fit = ln.ridge_days(arrival_targets(spark, sf_dir), "target", "ref", 100.0).join(evaluated(spark, sf_dir), ["series", "day"])
    return fit.select("series", "day", "n", r6("slope").alias("slope"), F.round("intercept", 5).alias("intercept"))


def _robust_sql(key: str, alpha: float) -> str:
    """Two robust-scaled columns and their ridge by ``key`` from the rows of ``train`` (columns y, x1, x2), in closed form."""
    at = lambda c, p: f"quantile_disc({c}, {p})"
    z = lambda c: f"CASE WHEN {c} IS NULL THEN 0 ELSE greatest(-4, least(4, ({c} - m{c}) / CASE WHEN w{c} > 0 THEN w{c} ELSE 1 END)) END"
    scales = ", ".join(f"{at(c, 0.5)} AS m{c}, {at(c, 0.75)} - {at(c, 0.25)} AS w{c}" for c in ("x1", "x2"))
    return f"""q AS (SELECT {key}, {scales} FROM rows GROUP BY {key}), z AS (SELECT {key}, y, {z("x1")} AS z1, {z("x2")} AS z2 FROM rows JOIN q USING ({key})),
  s AS (SELECT {key}, count(*) AS n, avg(z1) AS a1, avg(z2) AS a2, avg(y) AS my, count(*) * var_pop(z1) + {alpha} AS s11, count(*) * var_pop(z2) + {alpha} AS s22, count(*) * covar_pop(z1, z2) AS s12, count(*) * covar_pop(z1, y) AS s1, count(*) * covar_pop(z2, y) AS s2 FROM z GROUP BY {key}),
  b AS (SELECT *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM s)
  SELECT {key}, n, round(b1, 6) AS b1, round(b2, 6) AS b2, round(my - b1 * a1 - b2 * a2, 6) AS intercept FROM b"""


@query("m02_robust_ridge", f"{TRAIN}, rows AS (SELECT series, day, target - ref AS y, ref AS x1, p_fall AS x2 FROM train), {_robust_sql('series, day', 5)}")
def robust_ridge(spark, sf_dir):
    """The change by ridge on columns less their medians, divided by their quartile ranges and held to four, for every series and day at once."""
    rows = arrival_targets(spark, sf_dir).withColumn("y", F.col("target") - F.col("ref"))
    spans = ln.training_spans(rows).withColumn("_serves", rg.served_days())
    fit = rg.ridge_models(spans, ["series"], "_serves", ["ref", "p_fall"], "y", 5.0, exact=True).withColumnRenamed("model", "day").join(evaluated(spark, sf_dir), ["series", "day"])
    return fit.select("series", "day", "n", *(r6(F.element_at("coefficients", k)).alias(f"b{k}") for k in (1, 2)), r6("intercept").alias("intercept"))


@query("m12_fold_ridge", f"{TARGET}, d AS (SELECT DISTINCT series, issue_us // {DAY} AS day FROM targets), f AS (SELECT *, ntile(4) OVER (PARTITION BY series ORDER BY day) AS fold FROM d), x AS (SELECT t.series, t.target - t.ref AS y, t.ref AS x1, t.p_fall AS x2, f.fold AS own FROM targets t JOIN f ON f.series = t.series AND f.day = t.issue_us // {DAY} WHERE target IS NOT NULL), rows AS (SELECT x.*, fold FROM x JOIN (SELECT unnest(range(1, 5)) AS fold) g ON g.fold <> x.own), {_robust_sql('series, fold', 5)}")
def fold_ridge(spark, sf_dir):
    """For each contiguous block of days the ridge fitted on the other three, for forecasts out of fold."""
    from pyspark.sql import Window

    rows = arrival_targets(spark, sf_dir).withColumns({"day": F.expr(f"issue_us div {DAY}"), "y": F.col("target") - F.col("ref")})
    folds = rows.select("series", "day").distinct().withColumn("fold", F.ntile(4).over(Window.partitionBy("series").orderBy("day")))
    spans = rows.join(folds, ["series", "day"]).withColumn("_serves", rg.other_folds("fold", 4))
    fit = rg.ridge_models(spans, ["series"], "_serves", ["ref", "p_fall"], "y", 5.0, exact=True)
    return fit.select("series", F.col("model").alias("fold"), "n", *(r6(F.element_at("coefficients", k)).alias(f"b{k}") for k in (1, 2)), r6("intercept").alias("intercept"))


@query("m01_walk_forward", f"{TRAIN}, s AS (SELECT series, day, count(*) AS n, avg(target - ref) AS shift FROM train GROUP BY series, day) SELECT i.issue_id, CASE WHEN n >= 10 THEN round(i.ref + shift, 5) END AS pred FROM issues i LEFT JOIN s ON s.series = i.series AND s.day = i.issue_us // {DAY}")
def walk_forward(spark, sf_dir):
    d = F.col("target") - F.col("ref")
    fit = ln.training_sums(arrival_targets(spark, sf_dir), [F.count(F.lit(1)).alias("n"), F.count(d).alias("m"), F.sum(d).alias("d")], [F.sum("n").alias("n"), (F.sum("d") / F.sum("m")).alias("shift")])
    now = issues(spark, sf_dir).withColumn("day", F.expr(f"issue_us div {DAY}")).join(fit, ["series", "day"], "left")
    return now.select("issue_id", F.round(F.when(F.col("n") >= 10, F.col("ref") + F.col("shift")), 5).alias("pred"))


@query("x01_fit_predict", f"{TRAIN}, s AS (SELECT series, day, count(*) AS n, median(target - ref) AS shift FROM train GROUP BY series, day) SELECT i.issue_id, CASE WHEN n >= 10 THEN round(i.ref + shift, 5) END AS pred FROM issues i LEFT JOIN s ON s.series = i.series AND s.day = i.issue_us // {DAY}")
def fit_predict(spark, sf_dir):
    """The contract of a model: pandas frames of one window's training rows and one day's test rows in, predictions out."""

    def median_shift(train, test):
        shift = (train["target"] - train["ref"]).median() if len(train) >= 10 else float("nan")
        out = test[["issue_id"]].copy()
        out["pred"] = test["ref"] + shift
        return out

    pred = ln.walk_forward(arrival_targets(spark, sf_dir), median_shift, "issue_id bigint, pred double")
    return pred.select("issue_id", F.round(F.nanvl("pred", F.lit(None).cast("double")), 5).alias("pred"))


@query("m11_ratio_distribution", f"{TRAIN} SELECT series, day, count(*) AS n, round(avg((ln((target + 5) / (ref + 5)) <= ln(75 / 55.0::DOUBLE))::INT), 6) AS below FROM train GROUP BY series, day")
def ratio_distribution(spark, sf_dir):
    """Share of past log ratios that keep a level of 50 at or under 70."""
    z = F.log((F.col("target") + 5) / (F.col("ref") + 5))
    held = (z <= F.log(F.lit(75 / 55.0))).cast("int")
    rows = ln.training_sums(arrival_targets(spark, sf_dir), [F.count(F.lit(1)).alias("n"), F.count(held).alias("m"), F.sum(held).alias("held")], [F.sum("n").alias("n"), r6(F.sum("held") / F.sum("m")).alias("below")])
    return rows.join(evaluated(spark, sf_dir), ["series", "day"]).select("series", "day", "n", "below")


@query("m31_scaled_persistence", f"{TRAIN}, q AS (SELECT series, day, median(ln((target + 5) / (ref + 5))) AS z FROM train GROUP BY series, day) SELECT i.issue_id, round((i.ref + 5) * exp(z) - 5, 5) AS pred FROM issues i JOIN q ON q.series = i.series AND q.day = i.issue_us // {DAY}")
def scaled_persistence(spark, sf_dir):
    z = F.median(F.log((F.col("target") + 5) / (F.col("ref") + 5)))
    fit = ln.training_rows(arrival_targets(spark, sf_dir)).groupBy("series", "day").agg(z.alias("z"))
    now = issues(spark, sf_dir).withColumn("day", F.expr(f"issue_us div {DAY}"))
    return now.join(fit, ["series", "day"]).select("issue_id", F.round((F.col("ref") + 5) * F.exp("z") - 5, 5).alias("pred"))


@query("m12_block_folds", f"{TARGET}, d AS (SELECT DISTINCT series, issue_us // {DAY} AS day FROM targets), f AS (SELECT *, ntile(4) OVER (PARTITION BY series ORDER BY day) AS fold FROM d), x AS (SELECT t.series, t.target - t.ref AS y, f.fold FROM targets t JOIN f ON f.series = t.series AND f.day = t.issue_us // {DAY} WHERE target IS NOT NULL), s AS (SELECT series, fold, sum(y) AS y, count(*) AS n FROM x GROUP BY ALL) SELECT series, fold, n, round((sum(y) OVER w - y) / (sum(n) OVER w - n), 6) AS out_of_fold FROM s WINDOW w AS (PARTITION BY series)")
def block_folds(spark, sf_dir):
    from pyspark.sql import Window

    rows = arrival_targets(spark, sf_dir).withColumn("day", F.expr(f"issue_us div {DAY}"))
    folds = rows.select("series", "day").distinct().withColumn("fold", F.ntile(4).over(Window.partitionBy("series").orderBy("day")))
    s = rows.where("target is not null").join(folds, ["series", "day"]).groupBy("series", "fold").agg(F.sum(F.col("target") - F.col("ref")).alias("y"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("series")
    return s.select("series", F.col("fold").cast("long").alias("fold"), "n", r6((F.sum("y").over(w) - F.col("y")) / (F.sum("n").over(w) - F.col("n"))).alias("out_of_fold"))


@query("f19_cumulative_incidence", " SELECT issue_id, " + ", ".join(f"round({p} * (1 - pow(1 - p_fall - p_rise, 3)) / (p_fall + p_rise), 6) AS {n}" for p, n in (("p_fall", "fall"), ("p_rise", "rise"))) + " FROM issues")
def cumulative_incidence(spark, sf_dir):
    h = F.array(*[F.struct(F.col("p_fall").alias("fall"), F.col("p_rise").alias("rise")) for _ in range(3)])
    out = issues(spark, sf_dir).withColumn("c", ln.cumulative_incidence(h))
    return out.select("issue_id", r6("c.fall").alias("fall"), r6("c.rise").alias("rise"))


@query("a44_inverse_error_weights", f"{TARGET}, e AS (SELECT series, avg(abs(pred - target)) AS a, avg(abs(ref - target)) AS b FROM targets WHERE target IS NOT NULL GROUP BY series) SELECT series, round(1 / pow(a + 3, 2) / (1 / pow(a + 3, 2) + 1 / pow(b + 3, 2)), 6) AS w_pred FROM e")
def inverse_error_weights(spark, sf_dir):
    e = arrival_targets(spark, sf_dir).where("target is not null").groupBy("series").agg(*sc.point_metrics("target", "pred", "ref"))
    a, b = 1 / F.pow(F.col("mae") + 3, 2), 1 / F.pow(F.col("ref_mae") + 3, 2)
    return e.select("series", r6(a / (a + b)).alias("w_pred"))


@query("m16_isotonic_quality")
def isotonic_quality(spark, sf_dir):
    """Monotone map from text length to the probability of quality."""
    from pyspark.ml.regression import IsotonicRegression

    from issuetime.schemas import table

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("p"), F.col("quality").cast("double").alias("y"))
    return IsotonicRegression(featuresCol="p", labelCol="y").fit(rows).transform(rows).select("doc_id", "p", F.col("prediction").alias("calibrated"))


@query("m29_fresh_shift", " SELECT i.issue_id, round(i.pred + (r.v - c.med), 6) AS pred FROM issues i JOIN readings r ON r.obs_id = i.issue_id JOIN closed c ON c.series = i.series AND c.label = i.issue_us // 7200000000 * 7200000000")
def fresh_shift(spark, sf_dir):
    from issuetime.operators import buckets as bk
    from issuetime.plans.targets import B

    r = readings(spark, sf_dir)
    now = issues(spark, sf_dir).withColumn("label", bk.anchor(F.col("issue_us"), B)).join(r.select(F.col("obs_id").alias("issue_id"), "v"), "issue_id")
    return now.join(bk.closed_series(r), ["series", "label"]).select("issue_id", r6(F.col("pred") + (F.col("v") - F.col("med"))).alias("pred"))
