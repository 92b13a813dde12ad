"""Air paths that arrive in the windows of events, through the winds of each supplier's lattice."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuetime.operators import transport as tr
from issuetime.registry import query
from issuetime.schemas import table

AXIS, HOURS, LEVELS = (0.0, 1.0, 2.0), 49, (925, 850)
#: Corners (lon, lat) of the sectors whose contact is looked for: one to the south-west, one to the north.
SECTORS = (((0.1, 0.3), (0.9, 0.2), (0.8, 0.9), (0.3, 0.8)), ((0.6, 1.3), (1.5, 1.25), (1.2, 1.9)))


def winds(spark, sf_dir):
    """run, level, u, v, s: one lattice of hourly winds, and of a level carried by them, per supplier and level; a few runs miss an hour."""
    run, level = F.col("s_suppkey"), F.col("level")
    axis, hours = F.sequence(F.lit(0), F.lit(2)), F.sequence(F.lit(0), F.lit(HOURS - 1))
    over = lambda f: F.flatten(F.transform(axis, lambda i: F.flatten(F.transform(axis, lambda j: F.transform(hours, lambda t: f(i, j, t))))))
    higher = (level == LEVELS[1]).cast("double")
    u = over(lambda i, j, t: F.when((run % 17 == 3) & (t == 9), None).otherwise((run % 5 - 2) * 1.0 + 0.1 * i + 0.2 * ((run + t) % 4) + higher))
    v = over(lambda i, j, t: (run % 3 - 1) * 1.0 + 0.1 * j - 0.5 * higher)
    s = over(lambda i, j, t: 20.0 + 3.0 * i + 2.0 * j + ((run * 7 + t * 5) % 12) * 1.0)
    levels = F.explode(F.array(*(F.lit(x) for x in LEVELS)))
    return table(spark, sf_dir, "supplier").withColumn("level", levels).select(run.alias("run"), "level", u.alias("u"), v.alias("v"), s.alias("s"))


def arrivals(spark, sf_dir):
    """event_id, place, level, run: three arrivals at both levels, at the start, middle and end of each event's two hours."""
    n = F.col("event_id")
    at = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"), (n * 3 % 39 + 8).cast("double").alias("start"), F.posexplode(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))).alias("place", "later"))
    at = at.withColumn("level", F.explode(F.array(*(F.lit(x) for x in LEVELS))))
    return at.select("event_id", "run", "place", "level", (F.col("start") + F.col("later")).alias("at_hour"), F.lit(1.0).alias("at_lat"), F.lit(1.0).alias("at_lon"))


def paths(spark, sf_dir):
    """Paths of the arrivals whose run has a lattice."""
    runs = winds(spark, sf_dir)
    known = arrivals(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run")), "run", "left_semi")
    return tr.back_paths(known, runs, AXIS, AXIS, HOURS, SECTORS)


@query("m23_back_trajectories")
def back_trajectories(spark, sf_dir):
    """End, hours traced and first contacts of every path; the runs of 49 hours end most before 48 hours are traced."""
    lat, lon = F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    return paths(spark, sf_dir).select("event_id", "place", "level", lat, lon, "traced", "reached", F.col("contacts")[0].alias("south_west"), F.col("contacts")[1].alias("north"))


@query("a49_path_summary")
def path_summary(spark, sf_dir):
    """Both levels of each window's three paths together."""
    return tr.path_summary(paths(spark, sf_dir), "event_id", LEVELS[0])


@query("m24_sampled_field")
def sampled_field(spark, sf_dir):
    """Where the air that arrives in the middle of each event was six hours before, at both levels, and the field there; null off the lattice or before the run."""
    middle = arrivals(spark, sf_dir).where("place = 1")
    known = middle.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run")), "run", "left_semi")
    out = tr.back_paths(known, winds(spark, sf_dir), AXIS, AXIS, HOURS, (), most=6.0)
    whole = F.col("reached")
    return out.select("event_id", "level", *(F.round(F.when(whole, F.col(c)), 6).alias(c) for c in ("lat", "lon", "sampled")))
