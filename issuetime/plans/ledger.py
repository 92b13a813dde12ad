"""The issue ledger read back, verified and recalibrated as it was issued; checks of features by truncation and by a second path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.operators import learn as ln
from issuetime.operators import scores as sc
from issuetime.operators.joins import asof_join_blocks
from issuetime.plans.datasets import feature_rows
from issuetime.plans.models import TRAIN
from issuetime.plans.scoring import KNOWN, SCORED, known_before, scored
from issuetime.plans.streams import work_dir
from issuetime.plans.targets import B, TARGET, arrival_targets, r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, STANDARD, issues, newest_runs, readings, run_hours_of


def day_of(c: str):
    return F.expr(f"{c} div {DAY}")


@query("s08_ledger_scan", " SELECT issue_id, issue_us, recorded_us, version, round(pred, 6) AS pred, round(p_fall, 6) AS p_fall, round(p_rise, 6) AS p_rise FROM issues")
def ledger_scan(spark, sf_dir):
    """Published payloads, written as text, decoded once into a flat table; the two versions keep their heads in different places."""
    path = f"{work_dir(spark)}/ledger"
    rows = issues(spark, sf_dir)
    chances = F.struct("p_fall", "p_rise").alias("chances")
    first = F.to_json(F.struct(F.col("issue_us").alias("issue"), "version", "pred", chances))
    second = F.to_json(F.struct(F.struct(F.col("issue_us").alias("at")).alias("clock"), "version", F.struct(F.struct(F.col("pred").alias("level"), chances).alias("arrival")).alias("heads")))
    rows.select("issue_id", "recorded_us", F.when(F.col("version") == "a", first).otherwise(second).alias("payload")).write.parquet(path)
    chance = "chances struct<p_fall:double,p_rise:double>"
    body = F.from_json("payload", f"issue bigint, clock struct<at:bigint>, version string, pred double, {chance}, heads struct<arrival:struct<level:double,{chance.replace(' ', ':', 1)}>>")
    flat = spark.read.parquet(path).withColumn("p", body)
    either = lambda a, b: F.coalesce(F.col(f"p.{a}"), F.col(f"p.{b}"))
    heads = {"pred": ("pred", "heads.arrival.level"), "p_fall": ("chances.p_fall", "heads.arrival.chances.p_fall"), "p_rise": ("chances.p_rise", "heads.arrival.chances.p_rise")}
    return flat.select("issue_id", either("issue", "clock.at").alias("issue_us"), "recorded_us", "p.version", *(r6(either(*v)).alias(k) for k, v in heads.items()))


@query("v03_issued_events", f"""{KNOWN}, e AS (SELECT t.series, t.target - t.ref AS d, t.p_fall, k.n, k.falls FROM targets t JOIN known k ON k.series = t.series AND k.day = t.issue_us // {DAY}),
  r AS (SELECT *, CASE WHEN d IS NULL THEN 'open' WHEN n < 20 THEN 'thin' ELSE 'scored' END AS reason, (d <= -20)::INT AS y FROM e)
  SELECT series, reason, count(*) AS n, sum(y)::BIGINT AS events, round(avg((p_fall - y) ** 2) FILTER (reason = 'scored'), 6) AS brier, round(avg(y ** 2) FILTER (reason = 'scored'), 6) AS none, round(avg((falls / n - y) ** 2) FILTER (reason = 'scored'), 6) AS prior FROM r GROUP BY series, reason""")
def issued_events(spark, sf_dir):
    """The published chances of a fall against never calling one and against the prior that could have been issued; what is left out is counted by its reason."""
    rows = arrival_targets(spark, sf_dir).withColumn("day", day_of("issue_us")).join(known_before(spark, sf_dir), ["series", "day"]).withColumn("d", F.col("target") - F.col("ref"))
    reason = F.when(F.col("d").isNull(), "open").when(F.col("n") < 20, "thin").otherwise("scored")
    rows = rows.withColumn("reason", reason).withColumn("y", (F.col("d") <= -20).cast("int"))
    score = lambda p: r6(F.avg(F.when(F.col("reason") == "scored", F.pow(p - F.col("y"), 2))))
    return rows.groupBy("series", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), score(F.col("p_fall")).alias("brier"), score(F.lit(0.0)).alias("none"), score(F.try_divide(F.col("falls"), F.col("n"))).alias("prior"),
    )


LOOKS = (19_735, 19_740, 19_745)


@query("v04_prospective", f"""{SCORED}, l AS (SELECT unnest({list(LOOKS)}) AS look), f AS (SELECT * FROM issues QUALIFY row_number() OVER (PARTITION BY series, version, recorded_us // {4 * HOUR} ORDER BY recorded_us, issue_id) = 1),
  s AS (SELECT l.look, f.series, f.version, count(*) AS n, count(DISTINCT s.day) AS days, avg(abs(s.pred - s.target)) AS mae, avg(abs(s.d)) AS ref_mae FROM f JOIN scored s USING (issue_id) JOIN l ON s.complete < l.look * {DAY} GROUP BY ALL)
  SELECT look, series, version, n, days, round(mae, 6) AS mae, round(ref_mae, 6) AS ref_mae, CASE WHEN n < 20 OR days < 3 THEN 'support' WHEN mae < 0.98 * ref_mae THEN 'better' ELSE 'not shown' END AS verdict, row_number() OVER (PARTITION BY series, version ORDER BY look) AS looks FROM s""")
def prospective(spark, sf_dir):
    """First publications of each slot scored at sealed looks: every look is written to an append-only table before labels are read, and counted."""
    from issuetime.operators.selection import first_by
    from issuetime.sources.ingest import append_issues

    path = f"{work_dir(spark)}/looks"
    cohorts = issues(spark, sf_dir).select("series", "version").distinct()
    for look in LOOKS:
        append_issues(cohorts.withColumn("look", F.lit(look).cast("long")), path, ["look", "series", "version"], "series")
    looks = spark.read.parquet(path)
    counted = looks.withColumn("looks", F.row_number().over(Window.partitionBy("series", "version").orderBy("look")).cast("long"))
    first = first_by(scored_or_open(spark, sf_dir).withColumn("slot", F.expr(f"recorded_us div {4 * HOUR}")), ["series", "version", "slot"], "recorded_us", "issue_id").where("target is not null")
    met = first.join(counted, ["series", "version"]).where(F.col("complete") < F.col("look") * DAY)
    out = met.groupBy("look", "series", "version", "looks").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(day_of("issue_us")).alias("days"), F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"), F.avg(F.abs(F.col("target") - F.col("ref"))).alias("ref_mae"))
    verdict = F.when((F.col("n") < 20) | (F.col("days") < 3), "support").when(F.col("mae") < 0.98 * F.col("ref_mae"), "better").otherwise("not shown")
    return out.select("look", "series", "version", "n", "days", r6("mae").alias("mae"), r6("ref_mae").alias("ref_mae"), verdict.alias("verdict"), "looks")


def scored_or_open(spark, sf_dir):
    return arrival_targets(spark, sf_dir)


CUTS = tuple(1_704_067_200_000_000 + d * DAY for d in (5, 12, 20, 27))


def leaks(build, rows: DataFrame, clock: str, key: str, cuts: tuple[int, ...], tolerance: float = 1e-9) -> DataFrame:
    """feature, checked, leaks: how many values at or before a cut change when the rows after it are taken away."""
    out = None
    for cut in cuts:
        whole, cut_off = build(rows).where(F.col(clock) <= cut), build(rows.where(F.col(clock) <= cut))
        names = [c for c in whole.columns if c not in (key, clock)]
        met = whole.join(cut_off.select(key, *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_there")), key, "left")
        same = lambda c: F.col("_there") & (F.col(c).eqNullSafe(F.col(f"_{c}")) | (F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance))
        wrong = met.agg(F.count(F.lit(1)).alias("checked"), *(F.count_if(~F.coalesce(same(c), F.lit(False))).alias(c) for c in names))
        found = wrong.unpivot("checked", names, "feature", "leaks")
        out = found if out is None else out.union(found)
    return out.groupBy("feature").agg(F.sum("checked").alias("checked"), F.sum("leaks").alias("leaks"))


@query("v05_leak_check", f" SELECT feature, (SELECT count(*) FROM readings CROSS JOIN (SELECT unnest({list(CUTS)}) AS c) WHERE us <= c) AS checked, 0::BIGINT AS leaks FROM (SELECT unnest(['x_hour', 'x_fresh', 'x_change']) AS feature)")
def leak_check(spark, sf_dir):
    """The features of the training table, rebuilt from readings cut off at four clocks."""
    return leaks(feature_rows, readings(spark, sf_dir), "us", "issue_id", CUTS)


@query("v06_second_path", f"{TARGET} SELECT series, count(*) AS n, count(target) AS labelled, 0::BIGINT AS differ FROM targets GROUP BY series")
def second_path(spark, sf_dir):
    return target_differences(arrival_targets(spark, sf_dir), issues(spark, sf_dir), bk.closed_series(readings(spark, sf_dir)))


def target_differences(targets: DataFrame, issued: DataFrame, closed: DataFrame) -> DataFrame:
    """series, n, labelled, differ: targets (issue_id, target) against the same by plain SQL joins over the closed buckets."""
    at = f"i.issue_us + {STANDARD.lead}"
    again = issued.sparkSession.sql(
        f"""SELECT i.issue_id, CASE WHEN pmod({at}, {B}) = 0 THEN a.med ELSE a.med + (b.med - a.med) * pmod({at}, {B}) / {B} END AS again FROM {{issues}} i
        LEFT JOIN {{closed}} a ON a.series = i.series AND a.label = {at} - pmod({at}, {B}) LEFT JOIN {{closed}} b ON b.series = i.series AND b.label = {at} - pmod({at}, {B}) + {B}""",
        issues=issued, closed=closed,
    )
    met = targets.join(again, "issue_id")
    same = F.col("target").isNull() & F.col("again").isNull() | (F.abs(F.col("target") - F.col("again")) <= 1e-6)
    return met.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("labelled"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differ"))


NOON = 12 * HOUR


@query("v08_issued_evidence", f""", d AS (SELECT series, (label - 1) // {DAY} AS day, avg(med) FILTER ((label - 1) % {DAY} < {NOON}) AS anchor, avg(med) FILTER ((label - 1) % {DAY} >= {NOON}) AS truth FROM closed GROUP BY ALL),
  o AS (SELECT fetched, max(run_id) AS run_id FROM runs GROUP BY fetched), w AS (SELECT d.*, o.run_id FROM (SELECT *, day * {DAY} + {NOON} AS clock FROM d WHERE anchor IS NOT NULL AND truth IS NOT NULL) d ASOF JOIN o ON d.clock >= o.fetched),
  p AS (SELECT run_id, CASE WHEN count(temp) FILTER (h < 12) = 12 THEN avg(temp) FILTER (h BETWEEN 1 AND 11) - max(temp) FILTER (h = 0) END AS moved FROM run_hours GROUP BY run_id)
  SELECT series, count(*) AS days, count(moved) AS scored, round(avg(abs(anchor + moved - truth)), 6) AS mae, round(avg(abs(anchor - truth)) FILTER (moved IS NOT NULL), 6) AS ref_mae FROM w LEFT JOIN p USING (run_id) GROUP BY series""")
def issued_evidence(spark, sf_dir):
    """Per day the run visible at noon: its projected change, anchored at the morning's level, against the afternoon."""
    label = F.col("label") - 1
    d = bk.closed_series(readings(spark, sf_dir)).groupBy("series", F.expr(f"(label - 1) div {DAY}").alias("day")).agg(F.avg(F.when(label % DAY < NOON, F.col("med"))).alias("anchor"), F.avg(F.when(label % DAY >= NOON, F.col("med"))).alias("truth"))
    d = d.dropna().withColumn("clock", F.col("day") * DAY + NOON).withColumn("all", F.lit("all"))
    newest = newest_runs(spark, sf_dir)
    met = asof_join_blocks(d, newest, "clock", "fetched", DAY, on="all").where("right is not null").withColumn("run_id", F.col("right.run_id"))
    at = lambda c: F.when(c, F.col("temp"))
    moved = F.when(F.count(at(F.col("h") < 12)) == 12, F.avg(at(F.col("h").between(1, 11))) - F.max(at(F.col("h") == 0)))
    p = run_hours_of(newest).groupBy("run_id").agg(moved.alias("moved"))
    out = met.join(p, "run_id", "left")
    return out.groupBy("series").agg(F.count(F.lit(1)).alias("days"), F.count("moved").alias("scored"), r6(F.avg(F.abs(F.col("anchor") + F.col("moved") - F.col("truth")))).alias("mae"), r6(F.avg(F.when(F.col("moved").isNotNull(), F.abs(F.col("anchor") - F.col("truth"))))).alias("ref_mae"))


@query("v09_wind_evidence", f""", o AS (SELECT fetched, max(run_id) AS run_id FROM runs GROUP BY fetched), c AS (SELECT a.series, a.label, k.k AS later, b.med - a.med AS change FROM closed a CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) k JOIN closed b ON b.series = a.series AND b.label = a.label + k.k * {B}),
  w AS (SELECT c.*, o.run_id FROM c ASOF JOIN o ON c.label >= o.fetched) SELECT series, later, count(*) AS n, round(corr(h.speed, change), 5) AS corr FROM w JOIN run_hours h ON h.run_id = w.run_id AND h.h = 0 AND h.speed IS NOT NULL GROUP BY series, later""")
def wind_evidence(spark, sf_dir):
    """Correlation of the issued wind with the change of the level one to three buckets later."""
    c = bk.closed_series(readings(spark, sf_dir))
    for k in (1, 2, 3):
        c = bk.at_offset(c, k, B, f"m{k}")
    changes = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("later"), (F.col(f"m{k}") - F.col("med")).alias("change")) for k in (1, 2, 3))))
    c = c.select("series", "label", changes.alias("x")).select("series", "label", "x.later", "x.change", F.lit("all").alias("all")).where("change is not null")
    newest = newest_runs(spark, sf_dir)
    met = asof_join_blocks(c, newest, "label", "fetched", HOUR, on="all").where("right is not null").withColumn("run_id", F.col("right.run_id"))
    wind = run_hours_of(newest).where("h = 0 and speed is not null").select("run_id", "speed")
    return met.join(wind, "run_id").groupBy("series", "later").agg(F.count(F.lit(1)).alias("n"), F.round(sc.correlation("speed", "change"), 5).alias("corr"))


@query("m03_two_feature_ridge", f"""{TRAIN}, s AS (SELECT series, day, count(*)::DOUBLE AS n, avg(ref) AS m1, stddev_pop(ref) AS s1, avg(p_fall) AS m2, stddev_pop(p_fall) AS s2, avg(target - ref) AS my, corr(ref, p_fall) AS r, covar_pop(ref, target - ref) / stddev_pop(ref) AS c1, covar_pop(p_fall, target - ref) / stddev_pop(p_fall) AS c2 FROM train GROUP BY series, day HAVING count(*) >= 10),
  b AS (SELECT *, ((n + 5) * n * c1 - n * r * n * c2) / (pow(n + 5, 2) - pow(n * r, 2)) AS b1, ((n + 5) * n * c2 - n * r * n * c1) / (pow(n + 5, 2) - pow(n * r, 2)) AS b2 FROM s)
  SELECT i.issue_id, round(i.ref + my + b1 * (i.ref - m1) / s1 + b2 * (i.p_fall - m2) / s2, 4) AS pred FROM issues i JOIN b ON b.series = i.series AND b.day = i.issue_us // {DAY}""")
def two_feature_ridge(spark, sf_dir):
    """Ridge on two standardised features per day, solved in closed form from sums of the outcomes closed before it."""
    y = F.col("target") - F.col("ref")
    rows = ln.training_rows(arrival_targets(spark, sf_dir)).withColumn("y", y)
    s = rows.groupBy("series", "day").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("ref").alias("m1"), F.stddev_pop("ref").alias("s1"), F.avg("p_fall").alias("m2"), F.stddev_pop("p_fall").alias("s2"),
        F.avg("y").alias("my"), sc.correlation("ref", "p_fall").alias("r"), F.covar_pop("ref", "y").alias("v1"), F.covar_pop("p_fall", "y").alias("v2"),
    ).where("n >= 10")
    n, r, c1, c2 = F.col("n"), F.col("r"), F.try_divide("v1", "s1"), F.try_divide("v2", "s2")
    det = F.pow(n + 5, 2) - F.pow(n * r, 2)
    b1, b2 = ((n + 5) * n * c1 - n * r * n * c2) / det, ((n + 5) * n * c2 - n * r * n * c1) / det
    now = issues(spark, sf_dir).withColumn("day", day_of("issue_us")).join(s, ["series", "day"])
    pred = F.col("ref") + F.col("my") + b1 * F.try_divide(F.col("ref") - F.col("m1"), F.col("s1")) + b2 * F.try_divide(F.col("p_fall") - F.col("m2"), F.col("s2"))
    return now.select("issue_id", F.round(pred, 4).alias("pred"))


PIT = "least(greatest(floor((target - (pred - 60)) / 120 * 100), 0), 99)"
LEVEL = "least(greatest(floor((70 - (pred - 60)) / 120 * 100), 0), 100)"


@query("m14_pit_recalibration", f"{TRAIN}, h AS (SELECT series, day, {PIT} AS bin FROM train) SELECT i.issue_id, count(*) AS n, round(avg((h.bin < {LEVEL.replace('pred', 'i.pred')})::INT), 6) AS p FROM issues i JOIN h ON h.series = i.series AND h.day = i.issue_us // {DAY} GROUP BY i.issue_id, i.pred HAVING count(*) >= 10")
def pit_recalibration(spark, sf_dir):
    """The chance to stay at or under 70, read again through the share of past outcomes that fell below that place of their forecast.

    Places are hundredths of the forecast's range, so a day's past is a histogram of a hundred rows, whatever its size.
    """
    placed = arrival_targets(spark, sf_dir).withColumn("bin", F.expr(PIT))
    past = ln.training_sums(placed, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("c")], ("bin",))
    now = issues(spark, sf_dir).withColumn("day", day_of("issue_us")).withColumn("place", F.expr(LEVEL))
    asked = now.select("series", "day", "place").distinct()
    read = asked.join(past, ["series", "day"]).groupBy("series", "day", "place").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("bin") < F.col("place"), F.col("c")).otherwise(0)).alias("below")).where("n >= 10")
    return now.join(read, ["series", "day", "place"]).select("issue_id", "n", r6(F.col("below") / F.col("n")).alias("p"))


CELL = f"issue_us % {DAY} // {HOUR} AS hour, floor(ln(ref + 5) * 4)::BIGINT AS level"
KERNEL = "exp(-0.5 * pow(least(abs(a.hour - b.hour), 24 - abs(a.hour - b.hour)) / 3.0::DOUBLE, 2) - 0.5 * pow((a.level - b.level) / 2.0::DOUBLE, 2))"


@query("m18_kernel_climatology", f"""{TRAIN}, c AS (SELECT series, day, {CELL}, count(*) AS n, count(*) FILTER (target - ref <= -20) AS falls, sum(target - ref) AS moved FROM train GROUP BY ALL), q AS (SELECT DISTINCT series, issue_us // {DAY} AS day, {CELL} FROM issues)
  SELECT a.series, a.day, a.hour, a.level, round((sum({KERNEL} * b.falls) + 0.4) / (sum({KERNEL} * b.n) + 2), 6) AS p_fall, round(sum({KERNEL} * b.moved) / (sum({KERNEL} * b.n) + 2), 5) AS shift FROM q a JOIN c b ON a.series = b.series AND a.day = b.day GROUP BY a.series, a.day, a.hour, a.level""")
def kernel_climatology(spark, sf_dir):
    """Chance of a fall and mean change near each clock hour and level, from Gaussian weights over cells of the day's past rows."""
    cell = [F.expr(f"issue_us % {DAY} div {HOUR}").alias("hour"), F.floor(F.log(F.col("ref") + 5) * 4).cast("long").alias("level")]
    moved = F.col("target") - F.col("ref")
    parts = [F.count(F.lit(1)).alias("n"), F.count_if(moved <= -20).alias("falls"), F.sum(moved).alias("moved")]
    past = ln.training_sums(arrival_targets(spark, sf_dir).select("*", *cell), parts, [F.sum(c).alias(c) for c in ("n", "falls", "moved")], ("hour", "level"))
    asked = issues(spark, sf_dir).select("series", day_of("issue_us").alias("day"), *cell).distinct()
    met = asked.join(past.withColumnsRenamed({"hour": "hour2", "level": "level2"}), ["series", "day"])
    apart = F.abs(F.col("hour") - F.col("hour2"))
    w = F.exp(-0.5 * F.pow(F.least(apart, 24 - apart) / 3.0, 2) - 0.5 * F.pow((F.col("level") - F.col("level2")) / 2.0, 2))
    total = lambda c: F.sum(w * F.col(c))
    return met.groupBy("series", "day", "hour", "level").agg(r6((total("falls") + 0.4) / (total("n") + 2)).alias("p_fall"), F.round(total("moved") / (total("n") + 2), 5).alias("shift"))


_TREND = f"""trend AS (SELECT i.issue_id, greatest(-2, least(2, coalesce(floor((a.med - b.med) / 15), 0)))::BIGINT AS trend FROM issues i
  LEFT JOIN closed a ON a.series = i.series AND a.label = i.issue_us // {B} * {B} LEFT JOIN closed b ON b.series = i.series AND b.label = i.issue_us // {B} * {B} - {2 * B})"""
_KERNEL3 = f"{KERNEL} * exp(-0.5 * pow(a.trend - b.trend, 2))"


@query("m18_trend_climatology", f"""{TRAIN}, {_TREND}, c AS (SELECT series, day, {CELL}, trend, count(*) AS n, count(*) FILTER (target - ref <= -20) AS falls, sum(target - ref) AS moved FROM train JOIN trend USING (issue_id) GROUP BY ALL),
  q AS (SELECT DISTINCT series, issue_us // {DAY} AS day, {CELL}, trend FROM issues JOIN trend USING (issue_id))
  SELECT a.series, a.day, a.hour, a.level, a.trend, round((sum({_KERNEL3} * b.falls) + 0.4) / (sum({_KERNEL3} * b.n) + 2), 6) AS p_fall, round(sum({_KERNEL3} * b.moved) / (sum({_KERNEL3} * b.n) + 2), 5) AS shift
  FROM q a JOIN c b ON a.series = b.series AND a.day = b.day GROUP BY a.series, a.day, a.hour, a.level, a.trend""")
def trend_climatology(spark, sf_dir):
    """Chance of a fall and mean change near each clock hour, level and trend of the last two closed buckets, from Gaussian weights over cells of past rows.

    A day's past is at most hours times levels times five trends of cells, whatever its rows.
    """
    closed = bk.closed_series(readings(spark, sf_dir))
    two = bk.at_offset(closed, -2, B, "before").select("series", "label", F.floor((F.col("med") - F.col("before")) / 15).alias("t"))
    cell = {"hour": F.expr(f"issue_us % {DAY} div {HOUR}"), "level": F.floor(F.log(F.col("ref") + 5) * 4).cast("long"), "trend": F.greatest(F.lit(-2), F.least(F.lit(2), F.coalesce("t", F.lit(0)))).cast("long")}
    celled = lambda rows: rows.withColumn("label", bk.anchor(F.col("issue_us"), B)).join(two, ["series", "label"], "left").withColumns(cell)
    moved, axes = F.col("target") - F.col("ref"), ("hour", "level", "trend")
    parts = [F.count(F.lit(1)).alias("n"), F.count_if(moved <= -20).alias("falls"), F.sum(moved).alias("moved")]
    past = ln.training_sums(celled(arrival_targets(spark, sf_dir)), parts, [F.sum(c).alias(c) for c in ("n", "falls", "moved")], axes)
    asked = celled(issues(spark, sf_dir)).select("series", day_of("issue_us").alias("day"), *axes).distinct()
    met = asked.join(past.withColumnsRenamed({c: f"{c}2" for c in axes}), ["series", "day"])
    apart = F.abs(F.col("hour") - F.col("hour2"))
    w = F.exp(-0.5 * F.pow(F.least(apart, 24 - apart) / 3.0, 2) - 0.5 * F.pow((F.col("level") - F.col("level2")) / 2.0, 2) - 0.5 * F.pow(F.col("trend") - F.col("trend2"), 2))
    total = lambda c: F.sum(w * F.col(c))
    return met.groupBy("series", "day", *axes).agg(r6((total("falls") + 0.4) / (total("n") + 2)).alias("p_fall"), F.round(total("moved") / (total("n") + 2), 5).alias("shift"))


@query("m19_prequential_blend", f"""{KNOWN} SELECT i.issue_id, round((w1 * i.pred + w2 * i.ref + w3 * (i.ref + 50) / 2) / (w1 + w2 + w3), 6) AS pred FROM issues i JOIN (
  SELECT series, day, 1 / pow(coalesce(a / n, 10) + 3, 2) AS w1, 1 / pow(coalesce(b / n, 10) + 3, 2) AS w2, 1 / pow(coalesce((a + b) / (2 * n), 10) + 3, 2) AS w3 FROM known) k ON k.series = i.series AND k.day = i.issue_us // {DAY}""")
def prequential_blend(spark, sf_dir):
    """The forecast, persistence and half mean reversion, weighed by the inverse squared errors known before the issue's day."""
    k, c = known_before(spark, sf_dir), lambda e: 1 / F.pow(F.coalesce(e, F.lit(10.0)) + 3, 2)
    k = k.select("series", "day", c(F.try_divide("a", "n")).alias("w1"), c(F.try_divide("b", "n")).alias("w2"), c(F.try_divide(F.col("a") + F.col("b"), 2 * F.col("n"))).alias("w3"))
    now = issues(spark, sf_dir).withColumn("day", day_of("issue_us")).join(k, ["series", "day"])
    blend = (F.col("w1") * F.col("pred") + F.col("w2") * F.col("ref") + F.col("w3") * (F.col("ref") + 50) / 2) / (F.col("w1") + F.col("w2") + F.col("w3"))
    return now.select("issue_id", r6(blend).alias("pred"))


@query("m21_tuned_shrinkage", f"{SCORED}, g AS (SELECT series, k / 10.0::DOUBLE AS w, avg(abs(k / 10.0 * pred + (1 - k / 10.0) * ref - target)) FILTER (day < 19737) AS tuned, avg(abs(k / 10.0 * pred + (1 - k / 10.0) * ref - target)) FILTER (day >= 19737) AS held FROM scored CROSS JOIN (SELECT unnest(range(11))::DOUBLE AS k) GROUP BY ALL), b AS (SELECT series, min(tuned) AS best FROM g GROUP BY series) SELECT g.series, min(w) AS w, round(arg_min(tuned, w), 6) AS tuned, round(arg_min(held, w), 6) AS held FROM g JOIN b USING (series) WHERE tuned <= 1.01 * best GROUP BY g.series")
def tuned_shrinkage(spark, sf_dir):
    """The least weight on the forecast within one percent of the best on the tuning days, and its error on the days after."""
    each = scored(spark, sf_dir).withColumn("w", F.explode(F.array(*(F.lit(k / 10.0) for k in range(11)))))
    e = F.abs(F.col("w") * F.col("pred") + (1 - F.col("w")) * F.col("ref") - F.col("target"))
    g = each.groupBy("series", "w").agg(F.avg(F.when(F.col("day") < 19737, e)).alias("tuned"), F.avg(F.when(F.col("day") >= 19737, e)).alias("held"))
    near = g.withColumn("best", F.min("tuned").over(Window.partitionBy("series"))).where("tuned <= 1.01 * best")  # eleven rows a series
    return near.groupBy("series").agg(F.min("w").alias("w"), r6(F.min_by("tuned", "w")).alias("tuned"), r6(F.min_by("held", "w")).alias("held"))
