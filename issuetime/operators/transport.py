"""Backward paths through gridded winds of issued runs, and what a window's paths say together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kilometres of one degree of latitude, as the paths are defined.
DEGREE_KM = 111.2

PATH = "lat double, lon double, traced double, reached boolean, contacts array<double>, sampled double"
#: Arrivals of one run that meet its lattices in one task.
SHARE = 100_000
#: Lattice values that a group of small runs holds about; an arrival counts as ``ARRIVAL`` of them.
GROUP, ARRIVAL = 2_000_000, 20


def within(lat, lon, corners: Sequence[tuple[float, float]]):
    """Which points a polygon of (lon, lat) corners winds around: its edges that pass a point's latitude to the north with the point on
    their left count up, those that pass to the south with it on their right count down."""
    import numpy as np

    a = np.asarray(corners, float)
    b = np.roll(a, -1, axis=0)
    turns = np.zeros(len(lat), int)
    for (ax, ay), (bx, by) in zip(a, b, strict=True):
        left = (bx - ax) * (lat - ay) - (by - ay) * (lon - ax)
        turns += (ay <= lat) & (lat < by) & (left > 0)
        turns -= (by <= lat) & (lat < ay) & (left < 0)
    return turns != 0


def _at(fields, axes, places, which):
    """Each path's value of each of ``fields`` (lattices x lats x lons x times) at its place in its lattice ``which``; NaN outside or where a corner that
    weighs is not finite. A corner of weight exactly zero is not asked, so that a path may run along a missing value's edge."""
    import numpy as np

    inside, low, part = True, [], []
    for axis, x in zip(axes, places, strict=True):
        inside = inside & (x >= axis[0]) & (x <= axis[-1])
        i = np.clip(np.searchsorted(axis, x) - 1, 0, len(axis) - 2)
        low.append(i)
        part.append((x - axis[i]) / (axis[i + 1] - axis[i]))
    totals = [np.zeros(len(low[0])) for _ in fields]
    for corner in np.ndindex(2, 2, 2):
        w = np.prod([p if c else 1 - p for p, c in zip(part, corner, strict=True)], axis=0)
        for total, field in zip(totals, fields, strict=True):
            value = field[(which, *(i + c for i, c in zip(low, corner, strict=True)))]
            total += np.where(w != 0, w * np.where(np.isfinite(value), value, np.nan), 0.0)
    return [np.where(inside, total, np.nan) for total in totals]


def back_paths(
    arrivals: DataFrame, lattices: DataFrame, lats: Sequence[float], lons: Sequence[float], hours: int, sectors: Sequence[Sequence[tuple[float, float]]], most: float = 48.0, step: float = 0.5, share: int = SHARE
) -> DataFrame:
    """``arrivals`` with the end of each path, the hours traced, whether ``most`` was reached, the age of its first contact with each sector, and ``sampled``.

    ``arrivals``: run, level, at_lat, at_lon, at_hour besides columns of the caller, which are carried. ``lattices``: run, level and the run's winds u, v and
    field s (array<double>, winds in km/h, over lats, lons and ``hours`` hours in this order), one row for each run and level. A path goes back
    by midpoint steps and ends early where the wind is not known: off the lattice, before the run, or beside a missing value. sampled is the
    field at the path's end, null where it is not known. Arrivals without a lattice, or with one of another length, trace no hour.

    Arrivals travel to their run's lattices, which are moved once. A run with more than ``share`` arrivals is dealt to as many groups as it has
    shares, each with the run's lattices, so that a group holds about a share at most. The shares meet in groups of many small runs, so that the
    steps of a group's paths are taken together, and equal arrivals go one path.
    """
    import numpy as np
    import pandas as pd

    axes = [np.asarray(lats, float), np.asarray(lons, float), np.arange(hours, dtype=float)]
    shape, kept = (len(lats), len(lons), hours), [c for c in arrivals.columns if c not in ("at_lat", "at_lon", "at_hour")]
    size, names = int(np.prod(shape)), ("u", "v", "s")
    unknown = np.full(shape, np.nan)

    def lattice(x) -> np.ndarray:
        return unknown if x is None or len(x) != size else np.asarray(x, float).reshape(shape)

    def trace(part: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=[*kept, "lat", "lon", "traced", "reached", "contacts", "sampled"], dtype=object)
        order = {place: i for i, place in enumerate(zip(mine["run"], mine["level"], strict=True), 1)}
        fields = [(unknown,) * 3] + [tuple(lattice(x) for x in row) for row in zip(*(mine[n] for n in names), strict=True)]
        which = np.array([order.get(place, 0) for place in zip(part["run"], part["level"], strict=True)], int)
        u_all, v_all, s_all = (np.stack([f[k] for f in fields]) for k in range(3))
        lat, lon, hour = (part[c].to_numpy(float, na_value=np.nan).copy() for c in ("at_lat", "at_lon", "at_hour"))
        # equal arrivals have one path
        same = pd.DataFrame({"which": which, "lat": lat, "lon": lon, "hour": hour}).groupby(["which", "lat", "lon", "hour"], sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(same, return_index=True)[1]
        which, lat, lon, hour = which[first], lat[first], lon[first], hour[first]
        going, traced = np.ones(len(first), bool), np.zeros(len(first))
        contacts = np.full((len(first), len(sectors)), np.nan)
        for age in np.arange(0, most + step / 2, step):
            for s, corners in enumerate(sectors):
                met = going & np.isnan(contacts[:, s]) & within(lat, lon, corners)
                contacts[met, s] = age
            traced[going] = age
            if age >= most or not going.any():
                break
            u, v = _at((u_all, v_all), axes, (lat, lon, hour), which)
            mid = lat - v * step / 2 / DEGREE_KM, lon - u * step / 2 / (DEGREE_KM * np.cos(np.radians(lat))), hour - step / 2
            u, v = _at((u_all, v_all), axes, mid, which)
            going &= np.isfinite(u) & np.isfinite(v)
            lat = np.where(going, lat - v * step / DEGREE_KM, lat)
            lon = np.where(going, lon - u * step / (DEGREE_KM * np.cos(np.radians(mid[0]))), lon)
            hour = np.where(going, hour - step, hour)
        (sampled,) = _at((s_all,), axes, (lat, lon, hour), which)
        out = part[kept].copy()
        out["lat"], out["lon"], out["traced"], out["reached"] = lat[same], lon[same], traced[same], going[same]
        met = [[None if np.isnan(x) else x for x in row] for row in contacts.tolist()]
        ends = [None if np.isnan(x) else float(x) for x in sampled]
        out["contacts"], out["sampled"] = [met[i] for i in same], [ends[i] for i in same]
        return out

    hot = arrivals.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("run", F.ceil(F.col("n") / share).cast("int").alias("_parts"))
    hot = F.broadcast(hot)  # at most one row for each ``share`` arrivals
    cells = (arrivals.count() * ARRIVAL + lattices.count() * size) // GROUP + 1  # counted first: two numbers
    cell = F.when(F.col("run").isNotNull(), F.pmod(F.xxhash64("run", "_salt"), F.lit(cells))).otherwise(-1).alias("_cell")
    carried = [c for c in arrivals.columns if c not in ("run", "level")]
    a = arrivals.join(hot, "run", "left").withColumn("_salt", F.pmod(F.xxhash64(*carried), F.coalesce("_parts", F.lit(1)).cast("bigint"))).drop("_parts")
    b = lattices.join(hot, "run", "left").select("run", "level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)).cast("bigint") - 1)).alias("_salt"), *(F.col(n).cast("array<double>").alias(n) for n in names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrivals.schema.fields if f.name in kept)
    return a.select("*", cell).drop("_salt").groupBy("_cell").cogroup(b.select("*", cell).drop("_salt").groupBy("_cell")).applyInPandas(trace, f"{fields}, {PATH}")


def path_summary(paths: DataFrame, by: str, primary: int, least: float = 12.0, most: float = 48.0) -> DataFrame:
    """Per window: paths in contact at the primary and at the other level, range of the first contact's age, hours traced, and a state.

    ``paths``: ``by``, ``place`` (of the arrival in its window), level, traced, contacts. incomplete: a primary path shorter
    than ``least``; height_sensitive: the levels disagree at some arrival; all, any, unresolved (none, but a path ended early), none.
    """
    hit = F.array_min("contacts")
    own = F.col("level") == primary
    arrival = paths.groupBy(by, "place").agg(F.max(F.when(own, hit.isNotNull())).alias("p"), F.max(F.when(~own, hit.isNotNull())).alias("s"), F.min(F.when(own, hit)).alias("age"), F.min(F.when(own, F.col("traced"))).alias("traced"))
    n = arrival.groupBy(by).agg(
        F.count("p").alias("paths"), F.count_if("p").alias("contacts"), F.count_if("s").alias("other_contacts"), F.min("age").alias("first_age"), F.max("age").alias("last_age"), F.min("traced").alias("traced"),
        F.count_if(F.col("traced") >= least).alias("usable"), F.count_if(F.coalesce("p", F.lit(False)) != F.coalesce("s", F.lit(False))).alias("unlike"),
    )
    plain = F.when(F.col("contacts") == F.col("paths"), "all").when(F.col("contacts") > 0, "any").when(F.col("traced") < most, "unresolved").otherwise("none")
    state = F.when((F.col("usable") < F.col("paths")) | (F.col("paths") == 0), "incomplete").when(F.col("unlike") > 0, "height_sensitive").otherwise(plain)
    return n.withColumn("state", state).drop("usable", "unlike")
