"""Issued hourly forecasts over exact windows: each value holds for the hour ahead of its valid time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuetime.operators.joins import overlap_join
from issuetime.schemas import HOUR


def window_hours(hours: DataFrame, start: Column, length: int) -> DataFrame:
    """run_id, fetched, start, stop, at, w and the fields of every hour that the run's window touches (null if missing)."""
    windows = hours.groupBy("run_id").agg(F.first("fetched").alias("fetched")).withColumn("start", start).withColumn("stop", F.col("start") + length)
    near = hours.withColumn("_start", start).where((F.col("valid") > F.col("_start") - HOUR) & (F.col("valid") < F.col("_start") + length))
    return overlap_join(windows, near.drop("fetched", "_start").withColumn("at", F.col("valid")), "run_id", HOUR)


def complete(value: Column, over: Column) -> Column:
    """The aggregate, null unless every touched hour has the field."""
    return F.when(F.count(over) == F.count(F.lit(1)), value)


def circular_mean(degrees: Column, weight: Column) -> Column:
    """Weighted mean direction in [0, 360), null if the resultant is about zero."""
    x, y = F.sum(F.cos(F.radians(degrees)) * weight), F.sum(F.sin(F.radians(degrees)) * weight)
    return F.when(F.sqrt(x * x + y * y) > 1e-6 * F.sum(weight), F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)))


def wind_uv(speed: Column, direction_from: Column) -> tuple[Column, Column]:
    """East and north components of the wind that comes from a direction."""
    return -speed * F.sin(F.radians(direction_from)), -speed * F.cos(F.radians(direction_from))


def compass(direction_from: Column) -> Column:
    """One of sixteen compass names."""
    # Fixed values.
    names = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    return F.when(direction_from.isNotNull(), F.element_at(F.array(*(F.lit(n) for n in names)), (F.floor(direction_from / 22.5 + 0.5) % 16 + 1).cast("int")))


def from_bearing(speed: Column, direction_from: Column, bearing: Column) -> tuple[Column, Column]:
    """How far the wind comes from a source at ``bearing``: alignment in [0, 1] and signed component of the speed."""
    along = F.cos(F.radians(direction_from - bearing))
    return F.when(along.isNotNull(), F.greatest(F.lit(0.0), along)), speed * along


def path_parts(hours: DataFrame, field: str, windows: tuple[tuple[int, int], ...]) -> DataFrame:
    """run_id, ahead, length, a, b, va, vb: the straight pieces between hours, cut to each window (start after the run's fetch, length)."""
    following = F.lead(field).over(Window.partitionBy("run_id").orderBy("h"))
    first, last = min(o for o, _ in windows), max(o + n for o, n in windows)
    near = hours.where((F.col("valid") > F.col("fetched") + first - HOUR) & (F.col("valid") < F.col("fetched") + last + HOUR))
    pieces = near.select("run_id", "fetched", "valid", F.col(field).alias("x"), following.alias("next"))
    each = F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("ahead"), F.lit(n).cast("long").alias("length")) for o, n in windows)))
    cut = pieces.withColumn("_w", each).select("*", "_w.*").withColumn("a", F.greatest("valid", F.col("fetched") + F.col("ahead"))).withColumn("b", F.least(F.col("valid") + HOUR, F.col("fetched") + F.col("ahead") + F.col("length")))
    at = lambda t: F.col("x") + (F.col("next") - F.col("x")) * (F.col(t) - F.col("valid")) / HOUR
    return cut.where("a < b").select("run_id", "ahead", "length", "a", "b", at("a").alias("va"), at("b").alias("vb"))


def ordered_wind(hours: DataFrame, ahead: int, length: int, height: Column) -> DataFrame:
    """One row per run for the window of ``length`` that starts ``ahead`` of its fetch; one shuffle by run serves the steps and all sums."""
    u, v = wind_uv(F.col("speed"), F.col("direction"))
    start, stop, valid = F.col("fetched") + ahead, F.col("fetched") + ahead + length, F.col("valid")
    overlap = lambda a, b: F.greatest(F.least(b, valid + HOUR) - F.greatest(a, valid), F.lit(0))
    order = Window.partitionBy("run_id").orderBy("valid")
    step = F.sqrt(F.pow(F.col("_u") - F.lag("_u").over(order), 2) + F.pow(F.col("_v") - F.lag("_v").over(order), 2))
    near = hours.where((valid + HOUR > F.col("fetched")) & (valid <= stop)).withColumns({"_u": u, "_v": v, "_vent": F.col("speed") / 3.6 * height, "_w": overlap(start, stop), "_w0": overlap(F.col("fetched"), start), "_stepped": valid - HOUR >= F.col("fetched")})
    near = near.withColumn("_step", step)
    whole = lambda c, on: F.count_if(F.col(c).isNotNull() & on) == F.count_if(on)
    mean = lambda c, w: F.when(whole(c, F.col(w) > 0), F.sum(F.col(c) * F.col(w)) / F.sum(w))
    first = lambda c: F.max(F.when(F.col("h") == 0, F.col(c)))
    out = near.groupBy("run_id").agg(
        mean("_u", "_w").alias("u"), mean("_v", "_w").alias("v"), mean("speed", "_w").alias("speed"), mean("_vent", "_w").alias("vent_during"), mean("_vent", "_w0").alias("vent_before"),
        F.when(whole("_step", F.col("_stepped")), F.max(F.when(F.col("_stepped"), F.col("_step")))).alias("max_step"), first("_u").alias("_u0"), first("_v").alias("_v0"),
    )
    size = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    both = F.sqrt(F.col("_u0") * F.col("_u0") + F.col("_v0") * F.col("_v0")) * size
    turn = lambda c: F.when(both > 1e-6, F.least(F.greatest(c / both, F.lit(-1.0)), F.lit(1.0)))
    cosine, sine = F.col("_u0") * F.col("u") + F.col("_v0") * F.col("v"), F.col("_u0") * F.col("v") - F.col("_v0") * F.col("u")
    return out.withColumns({"coherence": F.when(F.col("speed") > 0.1, F.least(size / F.col("speed"), F.lit(1.0))), "turn_cos": turn(cosine), "turn_sin": turn(sine)}).drop("_u0", "_v0")


def explode_grid(runs: DataFrame, points: str = "points") -> DataFrame:
    """run, i, j, t, pm of runs with an array of lattice points (i, j, pm: a series); a run whose series differ in length is dropped.

    Joins sort and merge them: Spark's size of an exploded table is that of its runs, for which it would broadcast it.
    """
    same = F.forall(points, lambda p: F.size(p["pm"]) == F.size(F.element_at(points, 1)["pm"]))
    point = runs.where(same).select("run", F.explode(points).alias("p"))
    return point.select("run", "p.i", "p.j", F.posexplode("p.pm").alias("t", "pm")).hint("merge")
