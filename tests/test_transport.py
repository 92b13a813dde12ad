"""Back trajectories and their summaries against a plain walk of one path at a time."""

import math

from issuetime import registry
from issuetime.operators import transport as tr
from issuetime.plans import transport as plan

DIR = "/root/testdata/sf0.001"


def inside(lat, lon, corners):
    """The sectors are convex and run to the left: a point inside lies left of every edge."""
    ends = [*corners[1:], corners[0]]
    return all((b[0] - a[0]) * (lat - a[1]) > (b[1] - a[1]) * (lon - a[0]) for a, b in zip(corners, ends, strict=True))


def wind(field, lat, lon, hour, hours):
    if not (0 <= lat <= 2 and 0 <= lon <= 2 and 0 <= hour <= hours - 1):
        return None
    i, j, t = min(max(math.ceil(lat) - 1, 0), 1), min(max(math.ceil(lon) - 1, 0), 1), min(max(math.ceil(hour) - 1, 0), hours - 2)
    total = 0.0
    for di in (0, 1):
        for dj in (0, 1):
            for dt in (0, 1):
                w = abs(1 - di - (lat - i)) * abs(1 - dj - (lon - j)) * abs(1 - dt - (hour - t))
                if w != 0:
                    value = field[((i + di) * 3 + j + dj) * hours + t + dt]
                    if value is None:
                        return None
                    total += w * value
    return total


def walk(u, v, hour, hours=plan.HOURS, most=48):
    lat = lon = 1.0
    seen, age = [None, None], 0.0
    while True:
        seen = [age if s is None and inside(lat, lon, c) else s for s, c in zip(seen, plan.SECTORS, strict=True)]
        if age >= most:
            return lat, lon, age, True, seen
        a, b = wind(u, lat, lon, hour, hours), wind(v, lat, lon, hour, hours)
        if a is None or b is None:
            return lat, lon, age, False, seen
        middle = lat - b * 0.25 / 111.2, lon - a * 0.25 / (111.2 * math.cos(math.radians(lat))), hour - 0.25
        a, b = wind(u, *middle, hours), wind(v, *middle, hours)
        if a is None or b is None:
            return lat, lon, age, False, seen
        lat, lon = lat - b * 0.5 / 111.2, lon - a * 0.5 / (111.2 * math.cos(math.radians(middle[0])))
        hour, age = hour - 0.5, age + 0.5


def test_paths_and_summaries_equal_a_plain_walk(spark):
    winds = {(r["run"], r["level"]): r for r in plan.winds(spark, DIR).collect()}
    given = [(r, winds.get((r["run"], r["level"]))) for r in plan.arrivals(spark, DIR).collect()]
    walked = {(r["event_id"], r["place"], r["level"]): walk(w["u"], w["v"], r["at_hour"]) for r, w in given if r["event_id"] % 9 == 0 and w}
    got = {(r["event_id"], r["place"], r["level"]): r for r in plan.paths(spark, DIR).where("event_id % 9 = 0").collect()}
    assert set(got) == set(walked) and got
    for key, (lat, lon, age, reached, seen) in walked.items():
        r = got[key]
        assert math.isclose(r["lat"], lat, abs_tol=1e-9) and math.isclose(r["lon"], lon, abs_tol=1e-9)
        assert (r["traced"], r["reached"], r["contacts"]) == (age, reached, seen)
    assert {x is None for w in walked.values() for x in w[4]} == {True, False}
    summaries = {r["event_id"]: r for r in registry.queries()["a49_path_summary"](spark, DIR).where("event_id % 9 = 0").collect()}
    states = set()
    for event, s in summaries.items():
        own, other = ([walked[event, p, level] for p in range(3)] for level in plan.LEVELS)
        ages = [min((x for x in w[4] if x is not None), default=None) for w in own]
        hit, hit2 = [a is not None for a in ages], [any(x is not None for x in w[4]) for w in other]
        state = "all" if all(hit) else "any" if any(hit) else "unresolved" if min(w[2] for w in own) < 48 else "none"
        state = "incomplete" if min(w[2] for w in own) < 12 else "height_sensitive" if hit != hit2 else state
        met = [a for a in ages if a is not None]
        assert (s["state"], s["contacts"], s["other_contacts"], s["first_age"], s["last_age"]) == (state, sum(hit), sum(hit2), min(met, default=None), max(met, default=None))
        states.add(state)
    assert len(summaries) == len({k[0] for k in walked}) and len(states) > 2


def test_odd_rows_trace_nothing_and_no_wind_reaches_the_limit(spark):
    still = [0.0] * (9 * 60)
    rows = [(1, 1, 1.0, 1.0, 55.0), (2, 2, 1.0, 1.0, 55.0), (3, 1, None, 1.0, 55.0), (4, 4, 1.0, 1.0, 55.0), (5, 1, 9.0, 1.0, 55.0), (6, None, 1.0, 1.0, 55.0), (7, 77, 1.0, 1.0, 55.0)] + [(100 + i, 1, 1.0, 1.0, 50.0 + i % 9) for i in range(60)]
    arrivals = spark.createDataFrame([(i, run, 0, *at) for i, run, *at in rows], "id int, run bigint, level int, at_lat double, at_lon double, at_hour double")
    lattices = spark.createDataFrame([(1, 0, still, still, [7.0] * len(still)), (2, 0, None, still, still), (4, 0, still[:5], still, still), (9, 0, still, still, still)], "run bigint, level int, u array<double>, v array<double>, s array<double>")
    for share in (10, 1000):  # the hot run goes to several groups or to one
        got = {r["id"]: (r["traced"], r["reached"], r["sampled"]) for r in tr.back_paths(arrivals, lattices, plan.AXIS, plan.AXIS, 60, plan.SECTORS, share=share).collect()}
        assert {i: g for i, g in got.items() if i < 100} == {1: (48.0, True, 7.0), 2: (0.0, False, 0.0), 3: (0.0, False, None), 4: (0.0, False, 0.0), 5: (0.0, False, None), 6: (0.0, False, None), 7: (0.0, False, None)}
        assert len(got) == len(rows) and all(got[100 + i][:2] == (48.0, True) for i in range(60))


def test_sampled_field_is_that_of_the_plain_walk(spark):
    winds = {(r["run"], r["level"]): r for r in plan.winds(spark, DIR).collect()}
    places = {(r["event_id"], r["level"]): r for r in plan.arrivals(spark, DIR).where("place = 1").collect()}
    seen = 0
    for r in registry.queries()["m24_sampled_field"](spark, DIR).collect():
        p = places[r["event_id"], r["level"]]
        w = winds[p["run"], p["level"]]
        lat, lon, age, reached, _ = walk(w["u"], w["v"], p["at_hour"], most=6)
        assert (r["lat"] is not None) == reached
        if reached:
            assert math.isclose(r["lat"], lat, abs_tol=1e-6) and math.isclose(r["sampled"], wind(w["s"], lat, lon, p["at_hour"] - age, plan.HOURS), abs_tol=1e-5)
            seen += 1
    assert seen > 10
