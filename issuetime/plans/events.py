"""Detectors and states over closed buckets, geometry, and event tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.operators import frames as fr
from issuetime.operators.scores import islands
from issuetime.plans.targets import B, r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, readings, table


def closed(spark, sf_dir):
    return bk.closed_series(readings(spark, sf_dir))


ONSETS = f", onsets AS (SELECT a.series, a.label, a.med - b.med AS d, sign(a.med - b.med)::BIGINT AS dir FROM closed a JOIN closed b ON a.series = b.series AND b.label = a.label - {B} AND abs(a.med - b.med) >= 20)"


def onsets(spark, sf_dir):
    out = bk.at_offset(closed(spark, sf_dir), -1, B, "b").withColumn("d", F.col("med") - F.col("b")).where(F.abs("d") >= 20)
    return out.select("series", "label", "d", F.signum("d").cast("long").alias("dir"))


@query("e04_rapid_episodes", f"""{ONSETS}, j AS (SELECT *, CASE WHEN label - lag(label) OVER w > {12 * HOUR} OR dir <> lag(dir) OVER w THEN 1 ELSE 0 END AS j FROM onsets WINDOW w AS (PARTITION BY series ORDER BY label)), g AS (SELECT *, sum(j) OVER (PARTITION BY series ORDER BY label) AS g FROM j)
  SELECT series, min(label) AS start, max(label) AS stop, min(dir) AS dir, round(max(abs(d)), 6) AS largest, count(*) AS n FROM g GROUP BY series, g""")
def rapid_episodes(spark, sf_dir):
    runs = islands(onsets(spark, sf_dir), 12 * HOUR, "label", "series", "dir")
    return runs.groupBy("series", "island").agg(F.min("label").alias("start"), F.max("label").alias("stop"), F.min("dir").alias("dir"), r6(F.max(F.abs("d"))).alias("largest"), F.count(F.lit(1)).alias("n")).drop("island")


@query("e06_representatives", f"{ONSETS} SELECT series, label, dir FROM onsets QUALIFY coalesce(label - lag(label) OVER (PARTITION BY series ORDER BY label) > {6 * HOUR}, TRUE)")
def representatives(spark, sf_dir):
    first = F.col("label") - F.lag("label").over(Window.partitionBy("series").orderBy("label")) > 6 * HOUR
    return onsets(spark, sf_dir).withColumn("_f", F.coalesce(first, F.lit(True))).where("_f").select("series", "label", "dir")


JOINT = f""", c AS (SELECT label, max(med) FILTER (series = 'click') AS a, max(med) FILTER (series = 'error') AS b, max(med) FILTER (series = 'purchase') AS s0, max(med) FILTER (series = 'signup') AS s1, max(med) FILTER (series = 'view') AS s2 FROM closed GROUP BY label),
  f AS (SELECT x.label, x.a - y.a AS da, x.b - y.b AS db, x.s0 - y.s0 AS d0, x.s1 - y.s1 AS d1, x.s2 - y.s2 AS d2 FROM c x LEFT JOIN c y ON y.label = x.label - {B})"""


CHANNELS = dict(zip(("a", "b", "s0", "s1", "s2"), ['click', 'error', 'purchase', 'signup', 'view'], strict=True))


def channels(spark, sf_dir):
    """Five channels on one bucket grid (two levels, three that can support them) with their one-bucket changes."""
    wide = closed(spark, sf_dir).groupBy("label").pivot("series", list(CHANNELS.values())).agg(F.max("med")).toDF("label", *CHANNELS)
    before = wide.select((F.col("label") + B).alias("label"), *(F.col(c).alias(f"{c}_before") for c in CHANNELS))
    return wide.join(before, "label", "left").select("label", *CHANNELS, *((F.col(c) - F.col(f"{c}_before")).alias(f"d{c[-1]}") for c in CHANNELS))


@query("e07_joint_drop", f"{JOINT} SELECT label, coalesce(da <= -5 AND db <= -5, FALSE) AS joint, coalesce(da <= -5 AND db <= -5, FALSE) AND (coalesce(d0 < 0, FALSE) OR coalesce(d1 < 0, FALSE) OR coalesce(d2 < 0, FALSE)) AS supported FROM f")
def joint_drop(spark, sf_dir):
    """Both levels drop in one bucket; supported if any further channel falls with them."""
    both = F.coalesce((F.col("da") <= -5) & (F.col("db") <= -5), F.lit(False))
    fell = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    return channels(spark, sf_dir).select("label", both.alias("joint"), (both & (fell("d0") | fell("d1") | fell("d2"))).alias("supported"))


@query("e09_sustained_fall", f""", x AS (SELECT a.series, a.label, a.med, a.med - b.med AS d, a.med - c.med AS fall FROM closed a LEFT JOIN closed b ON a.series = b.series AND b.label = a.label - {B} LEFT JOIN closed c ON c.series = a.series AND c.label = a.label - {3 * B})
  SELECT series, label, coalesce(fall <= -15 AND (count(*) FILTER (d < 0) OVER w) >= 2 AND med <= (min(med) OVER w) + 5, FALSE) AS sustained FROM x WINDOW w AS (PARTITION BY series ORDER BY label RANGE BETWEEN {2 * B} PRECEDING AND CURRENT ROW)""")
def sustained_fall(spark, sf_dir):
    x = bk.at_offset(bk.at_offset(closed(spark, sf_dir), -1, B, "b"), -3, B, "c")
    w = fr.steps_back(3, B)
    falls = F.sum((F.col("med") < F.col("b")).cast("int")).over(w)
    return x.select("series", "label", F.coalesce((F.col("med") - F.col("c") <= -15) & (F.coalesce(falls, F.lit(0)) >= 2) & (F.col("med") <= F.min("med").over(w) + 5), F.lit(False)).alias("sustained"))


@query("e12_air_state", f""", x AS (SELECT a.series, a.label, a.med, a.med - b.med AS d1, a.med - c.med AS d2 FROM closed a LEFT JOIN closed b ON a.series = b.series AND b.label = a.label - {B} LEFT JOIN closed c ON c.series = a.series AND c.label = a.label - {2 * B})
  SELECT series, label, CASE WHEN d1 IS NULL OR d2 IS NULL THEN 'collecting' WHEN d1 >= 20 THEN 'fast_rise' WHEN d1 <= -20 THEN 'rapid_improvement' WHEN d2 >= 10 THEN 'rising' WHEN d2 <= -10 THEN 'improving' WHEN med > 55 THEN 'stable_high' ELSE 'steady' END AS state FROM x""")
def air_state(spark, sf_dir):
    x = bk.at_offset(bk.at_offset(closed(spark, sf_dir), -1, B, "b"), -2, B, "c")
    d1, d2 = F.col("med") - F.col("b"), F.col("med") - F.col("c")
    state = F.when(d1.isNull() | d2.isNull(), "collecting").when(d1 >= 20, "fast_rise").when(d1 <= -20, "rapid_improvement").when(d2 >= 10, "rising").when(d2 <= -10, "improving").when(F.col("med") > 55, "stable_high").otherwise("steady")
    return x.select("series", "label", state.alias("state"))


@query("e13_prior_outlook", f"""{ONSETS}, o AS (SELECT a.series, a.label, a.dir, b.med - c.med AS outcome, a.label + {2 * B} AS closes FROM onsets a JOIN closed c ON c.series = a.series AND c.label = a.label JOIN closed b ON b.series = a.series AND b.label = a.label + {2 * B}),
  f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY series, dir, (label - 1) // {DAY} ORDER BY label) = 1)
  SELECT x.series, x.label, x.dir, count(f.label) AS events, round(CASE WHEN count(f.label) >= 2 THEN median(f.outcome) END, 6) AS outlook FROM onsets x LEFT JOIN f ON f.series = x.series AND f.dir = x.dir AND f.closes < x.label AND f.label >= x.label - {14 * DAY} GROUP BY ALL""")
def prior_outlook(spark, sf_dir):
    from issuetime.operators.joins import trailing_join

    ahead = bk.at_offset(closed(spark, sf_dir), 2, B, "later").select("series", "label", (F.col("later") - F.col("med")).alias("outcome"))
    on = onsets(spark, sf_dir).select("series", "label", "dir")
    done = on.join(ahead, ["series", "label"]).where("outcome is not null").withColumn("day", F.expr(f"(label - 1) div {DAY}"))
    first = Window.partitionBy("series", "dir", "day").orderBy("label")
    done = done.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("series", F.col("label").alias("was"), F.col("dir").alias("was_dir"), "outcome")
    seen = trailing_join(on, done, "label", "was", 14 * DAY + 1).where((F.col("dir") == F.col("was_dir")) & (F.col("was") + 2 * B < F.col("label")))
    found = seen.groupBy("series", "label").agg(F.count(F.lit(1)).alias("events"), F.median("outcome").alias("m"))
    return on.join(found, ["series", "label"], "left").select("series", "label", "dir", F.coalesce("events", F.lit(0)).alias("events"), r6(F.when(F.col("events") >= 2, F.col("m"))).alias("outlook"))


OVERLAY = f"""{ONSETS}, o AS (SELECT a.series, a.label, a.dir, c.med AS level, b.med - c.med AS outcome FROM onsets a JOIN closed c ON c.series = a.series AND c.label = a.label JOIN closed b ON b.series = a.series AND b.label = a.label + {4 * B}),
  f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY series, dir, (label - 1) // {DAY} ORDER BY label) = 1),
  p AS (SELECT x.series, x.label, x.dir, count(f.label) AS events, min(level) AS lo, max(level) AS hi, median(outcome) AS m FROM onsets x LEFT JOIN f ON f.series = x.series AND f.dir = x.dir AND f.label + {4 * B} < x.label AND f.label >= x.label - {14 * DAY} GROUP BY ALL),
  y AS (SELECT p.*, c.med AS level, m1.med AS m1, m2.med AS m2 FROM p JOIN closed c USING (series, label) LEFT JOIN closed m1 ON m1.series = p.series AND m1.label = p.label + {B} LEFT JOIN closed m2 ON m2.series = p.series AND m2.label = p.label + {2 * B}),
  z AS (SELECT *, greatest(1, 0.03 * level) AS tol, CASE WHEN dir < 0 THEN least(level, m1, m2) ELSE greatest(level, m1, m2) END AS ext, unnest([1, 2]) AS age FROM y),
  v AS (SELECT *, (m1 - level) * dir < -tol OR (age = 2 AND ((m2 - level) * dir < -tol OR ((ext - m2) * dir >= greatest(3, 0.08 * abs(ext)) AND ((ext - m1) * dir >= greatest(3, 0.08 * abs(ext)) OR (m1 - m2) * dir >= greatest(2, 0.05 * abs(ext)))))) AS back, CASE WHEN age = 1 THEN m1 ELSE m2 END AS anchor FROM z),
  s AS (SELECT *, CASE WHEN events < 2 THEN 'insufficient' WHEN level NOT BETWEEN lo AND hi THEN 'outside' WHEN m1 IS NULL OR (age = 2 AND m2 IS NULL) THEN 'awaiting' WHEN back THEN 'reversed' ELSE 'active' END AS status FROM v)
  SELECT series, label, age, events, status, CASE WHEN status = 'active' THEN round(greatest(0, anchor + (level + m - anchor) / age), 6) END AS projected FROM s"""


@query("e13_event_overlay", OVERLAY)
def event_overlay(spark, sf_dir):
    """Each onset one and two buckets on: what completed prior events of its kind (one a day, in 14 days) say, if they are two or more,
    its level lies inside theirs, and the buckets since neither go back over the trigger nor rebound; the weight halves with age."""
    from issuetime.operators.joins import trailing_join

    around = closed(spark, sf_dir)
    for name, steps in (("m1", 1), ("m2", 2), ("end", 4)):
        around = bk.at_offset(around, steps, B, name)
    on = onsets(spark, sf_dir).select("series", "label", "dir").join(around.withColumnRenamed("med", "level"), ["series", "label"])
    first = Window.partitionBy("series", "dir", "day").orderBy("label")
    done = on.where("end is not null").withColumn("day", F.expr(f"(label - 1) div {DAY}")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    done = done.select("series", F.col("label").alias("was"), F.col("dir").alias("was_dir"), F.col("level").alias("was_level"), (F.col("end") - F.col("level")).alias("outcome"))
    seen = trailing_join(on.select("series", "label", "dir"), done, "label", "was", 14 * DAY + 1).where((F.col("dir") == F.col("was_dir")) & (F.col("was") + 4 * B < F.col("label")))
    prior = seen.groupBy("series", "label").agg(F.count(F.lit(1)).alias("events"), F.min("was_level").alias("lo"), F.max("was_level").alias("hi"), F.median("outcome").alias("m"))
    x = on.join(prior, ["series", "label"], "left").withColumn("events", F.coalesce("events", F.lit(0))).withColumn("age", F.explode(F.array(F.lit(1), F.lit(2))))
    level, m1, m2, way, late = F.col("level"), F.col("m1"), F.col("m2"), F.col("dir"), F.col("age") == 2
    limit, far = F.greatest(F.lit(1.0), 0.03 * level), F.when(way < 0, F.least(level, m1, m2)).otherwise(F.greatest(level, m1, m2))
    margin = F.greatest(F.lit(3.0), 0.08 * F.abs(far))
    rebound = ((far - m2) * way >= margin) & (((far - m1) * way >= margin) | ((m1 - m2) * way >= F.greatest(F.lit(2.0), 0.05 * F.abs(far))))
    back = ((m1 - level) * way < -limit) | (late & (((m2 - level) * way < -limit) | rebound))
    status = F.when(F.col("events") < 2, "insufficient").when(~level.between(F.col("lo"), F.col("hi")), "outside").when(m1.isNull() | (late & m2.isNull()), "awaiting").when(back, "reversed").otherwise("active")
    anchor = F.when(late, m2).otherwise(m1)
    projected = F.greatest(F.lit(0.0), anchor + (level + F.col("m") - anchor) / F.col("age"))
    return x.withColumn("status", status).select("series", "label", F.col("age").cast("long").alias("age"), "events", "status", r6(F.when(F.col("status") == "active", projected)).alias("projected"))


POINTS = "(SELECT event_id, value, (event_id % 200 - 100) / 100.0::DOUBLE * 110.57 AS n, ((event_id * 7) % 200 - 100) / 100.0::DOUBLE * 111.32 AS e FROM events)"


def points(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", "value", ((e % 200 - 100) / 100.0 * 110.57).alias("n"), ((e * 7 % 200 - 100) / 100.0 * 111.32).alias("e"))


@query("e17_sector_ring", f"SELECT least(floor(sqrt(n * n + e * e) / 40), 3)::BIGINT AS ring, (floor(fmod(degrees(atan2(e, n)) + 360, 360) / 45 + 0.5)::BIGINT % 8) AS sector, count(*) AS points, round(sum(value), 4) AS weight FROM {POINTS} GROUP BY ALL", inputs=False)
def sector_ring(spark, sf_dir):
    n, e = F.col("n"), F.col("e")
    ring = F.least(F.floor(F.sqrt(n * n + e * e) / 40), F.lit(3)).cast("long")
    sector = F.floor(F.pmod(F.degrees(F.atan2(e, n)) + 360, F.lit(360.0)) / 45 + 0.5) % 8
    return points(spark, sf_dir).groupBy(ring.alias("ring"), sector.alias("sector")).agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 4).alias("weight"))


POLYGON = ((-60.0, -50.0), (70.0, -40.0), (55.0, 62.0), (-20.0, 30.0))


def _crosses_sql(i: int) -> str:
    (x1, y1), (x2, y2) = POLYGON[i], POLYGON[(i + 1) % len(POLYGON)]
    return f"(CASE WHEN ({y1}::DOUBLE > n) <> ({y2}::DOUBLE > n) AND e < ({x2 - x1})::DOUBLE * (n - {y1}::DOUBLE) / ({y2 - y1})::DOUBLE + {x1}::DOUBLE THEN 1 ELSE 0 END)"


@query("j16_point_in_polygon", f"SELECT event_id, ({' + '.join(_crosses_sql(i) for i in range(4))}) % 2 = 1 AS inside FROM {POINTS}", inputs=False)
def point_in_polygon(spark, sf_dir):
    """Crossings of a ray with the polygon's edges, which are few and part of the expression."""
    edges = zip(POLYGON, (*POLYGON[1:], POLYGON[0]), strict=True)
    crossing = [F.when(((F.lit(y1) > F.col("n")) != (F.lit(y2) > F.col("n"))) & (F.col("e") < (x2 - x1) * (F.col("n") - y1) / (y2 - y1) + x1), 1).otherwise(0) for (x1, y1), (x2, y2) in edges]
    return points(spark, sf_dir).select("event_id", (sum(crossing[1:], crossing[0]) % 2 == 1).alias("inside"))
