"""Operators whose cost or precision once hung on the size of the tables, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from issuetime import registry
from issuetime.operators import frames as fr
from issuetime.operators import joins as jn
from issuetime.operators import ridge as rg
from issuetime.operators import scores as sc
from issuetime.operators import transport as tr
from issuetime.schemas import run_hours, run_hours_of, runs

DIR = "/root/testdata/sf0.01"


def test_nearest_equals_a_plain_search(spark):
    """j05 (F1): two as-of joins find what all pairs of the band gave, with ties of distance and of clock, and nothing out of reach."""
    rng = random.Random(3)
    left = [("a" if i % 3 else "b", i, rng.randrange(400)) for i in range(150)]
    right = [("a" if i % 2 else "b", rng.randrange(400), i, float(i)) for i in range(120)]
    met = jn.nearest_join(spark.createDataFrame(left, "series string, id long, at long"), spark.createDataFrame(right, "series string, us long, obs_id long, v double"), "at", "us", "obs_id", 6, 3, 50)
    got = {r["id"]: r["right"] and (r["right"]["us"], r["right"]["obs_id"], r["right"]["v"]) for r in met.collect()}
    for series, i, at in left:
        near = [(abs(at - us), o, us, v) for s, us, o, v in right if s == series and at - 6 <= us <= at + 3]
        want = min(near)[1:] if near else None
        assert got[i] == (want and (want[1], want[0], want[2]))


def broadcast_sizes(plan: str) -> int:
    """Joins that send the 48 hours of every run to all tasks."""
    from_side, lines = 0, plan.splitlines()
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for other in lines[n + 1 :]:
                if len(other) - len(other.lstrip(" :+-")) <= depth:
                    break
                below.append(other)
            from_side += any("Generate explode" in b for b in below)
    return from_side


@pytest.mark.parametrize("name", ["f13_interpolated_point", "e15_dry_dispersion", "w21_paired_arrays", "j10_station_match", "f14_trilinear"])
def test_exploded_tables_are_not_broadcast(spark, name):
    """F2, F7, F8, F9, F18: the size that Spark takes for an exploded table is that of its runs."""
    assert broadcast_sizes(registry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()) == 0


def test_totals_up_to_points(spark):
    """w21 (F18): what lies between two points is a difference of totals, over blocks with and without rows, nulls aside."""
    rng = random.Random(5)
    rows = [("a", rng.randrange(-50, 900), rng.choice([None, 1, 2, 7])) for _ in range(200)]
    points = [("a", i, rng.randrange(-100, 1200)) for i in range(80)] + [("b", 99, 5)]
    met = fr.totals_until(spark.createDataFrame(points, "series string, id long, at long"), spark.createDataFrame(rows, "series string, us long, k long"), "at", "us", {"s": F.sum("k"), "n": F.count("k")}, block=100)
    got = {r["id"]: (r["s"], r["n"] or 0) for r in met.collect()}
    for series, i, at in points:
        known = [k for s, us, k in rows if s == series and us <= at and k is not None]
        assert got[i] == (sum(known) if known else None, len(known))


def test_trailing_medians_equal_plain_windows(spark):
    """w01, w02, s12, p11, v05 (F20, F21, F22, F27, F29): sliding medians with shifts, rows of one clock, nulls and NaN."""
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randrange(600), i, rng.choice([None, float("nan"), float("inf"), rng.random(), rng.random(), rng.random()])) for i in range(300)]
    out = fr.trailing_medians(spark.createDataFrame(rows, "series string, us long, id long, v double"), 40, [0, 25], block=100)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for series, us, i, _ in rows:
        for k, shift in enumerate((0, 25)):
            inside = [(t, v) for s, t, _, v in rows if s == series and us - shift - 40 < t <= us - shift]
            values = sorted((v for _, v in inside if v is not None), key=lambda v: (math.isnan(v), v))
            assert got[i]["newests"][k] == max((t for t, _ in inside), default=None)
            have = got[i]["medians"][k]
            if not values:
                assert have is None
                continue
            a, b = values[(len(values) - 1) // 2], values[len(values) // 2]
            want = a if a == b else a + (b - a) * 0.5
            assert have == pytest.approx(want, nan_ok=True)


def test_correlation_of_a_constant(spark):
    """v09 (F16): a wind that does not vary divided by zero."""
    rows = spark.createDataFrame([("c", 5.0, 1.0), ("c", 5.0, 2.0), ("d", 1.0, 1.0), ("d", 2.0, 3.0), ("d", 4.0, 3.5), ("d", None, 9.0), ("e", None, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in rows.groupBy("g").agg(sc.correlation("x", "y").alias("r")).collect()}
    assert math.isnan(got["c"]) and got["e"] is None
    assert got["d"] == pytest.approx(rows.where("x is not null and g = 'd'").agg(F.corr("x", "y")).first()[0])


def test_quartiles_past_a_sketch_are_exact(spark):
    """m02, m12 (F24, F25): with more values than a sketch keeps, quartiles are those of the sorted values."""
    rng = random.Random(11)
    values = [[("s", [1] if i % 2 else [1, 2], None if i % 50 == 0 else round(rng.gauss(0, 40), 2)) for i in range(30_000)]][0]
    rows = spark.createDataFrame(values, "series string, serves array<long>, x double")
    got = {r["model"]: r for r in rg.robust_scales(rows, ["series"], "serves", ["x"], exact=True).collect()}
    for model in (1, 2):
        known = sorted(x for _, serves, x in values if model in serves and x is not None)
        at = lambda p: known[math.ceil(p * len(known)) - 1]
        assert got[model]["centers"] == [at(0.5)] and got[model]["widths"] == [at(0.75) - at(0.25)]


def test_stations_on_one_line_go_by_distance(spark):
    """a21 (F23): of stations equally straight upwind the nearest is named, as its SQL says."""
    sql = registry.oracle_sql()["a21_upwind_medians"]
    assert "round(al, 9), -eta, station" in sql
    import duckdb

    for order in ("ASC", "DESC"):
        rows = f"(SELECT * FROM (VALUES (1.0::DOUBLE, 20.0::DOUBLE, 'near'), (1.0::DOUBLE + 2e-16, 45.0::DOUBLE, 'far')) t(al, eta, station) ORDER BY eta {order})"
        assert duckdb.sql(f"SELECT arg_max(station, (round(al, 9), -eta, station)) FROM {rows}").fetchall()[0][0] == "near"


def test_small_runs_share_groups(spark):
    """a49, m23, m24 (F3, F30, F35): many runs are traced together, each through its own lattices, and equal arrivals alike."""
    hours, n = 4, 40
    flat = lambda x: [x] * (2 * 2 * hours)
    winds = spark.createDataFrame([(r, 1, flat(float(r)), flat(0.0), flat(100.0 + r)) for r in range(n)], "run long, level int, u array<double>, v array<double>, s array<double>")
    there = spark.createDataFrame([(i, i % (n + 1), 1, 0.5, 0.5, 3.0) for i in range(5 * (n + 1))], "id long, run long, level int, at_lat double, at_lon double, at_hour double")
    paths = tr.back_paths(there, winds, (0.0, 1.0), (0.0, 1.0), hours, (), most=1.0)
    got = paths.collect()
    assert len(got) == 5 * (n + 1)
    for r in got:
        assert (r["sampled"] is None) == (r["run"] == n)
        if r["run"] < n:
            assert r["sampled"] == pytest.approx(100.0 + r["run"]) and r["lon"] == pytest.approx(0.5 - r["run"] / (tr.DEGREE_KM * math.cos(math.radians(0.5))))
    assert "_cell" in paths._jdf.queryExecution().optimizedPlan().toString()


def test_hours_of_some_runs_are_those_of_all(spark):
    few = run_hours_of(runs(spark, DIR).where("run_id % 50 = 0"))
    assert few.exceptAll(run_hours(spark, DIR).where("run_id % 50 = 0")).isEmpty() and few.count() % 48 == 0


def test_nearest_levels_equal_a_plain_search(spark):
    """m32 (F14): the nearest levels come from places in the order of levels, not from all pairs of a group; ties, few rows and missing levels."""
    rng = random.Random(13)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    level = lambda: rng.choice(odd) if rng.random() < 0.15 else float(rng.randrange(12))
    past = [(rng.choice("abc"), level(), i, float(i)) for i in rng.sample(range(500), 120)] + [("d", 1.0, 900, 2.0)]
    now = [(g, i, level()) for i, g in enumerate("abcde" * 12)]
    met = jn.nearest_levels(spark.createDataFrame(now, "g string, issue_id long, ref double"), spark.createDataFrame(past, "g string, level double, past long, d double"), ["g"], 5)
    got = {r["issue_id"]: [b["past"] for b in r["best"]] for r in met.collect()}
    for g, i, ref in now:
        apart = lambda x: None if x is None or ref is None else abs(x - ref)
        order = sorted((a is None, 0.0 if a is None or math.isnan(a) else a, p) if a is None or not math.isnan(a) else (False, math.inf, math.inf, p) for s, x, p, _ in past if s == g for a in [apart(x)])
        want = [o[-1] for o in order[:5]]
        assert got.get(i, []) == want
    assert "Cartesian" not in met._jdf.queryExecution().executedPlan().toString()


def test_outcomes_meet_in_bins_of_time(spark, tmp_path):
    """t09 (F17): rows of a series are compared with those of their bins of time only, and nothing at a bin's edge is lost."""
    from issuetime.streaming import buckets as st

    rng = random.Random(17)
    minute, base = 60_000_000, 1_700_000_000_000_000
    at = sorted(rng.sample(range(0, 3000), 400)) + [2999, 3000]
    spark.createDataFrame([("a" if i % 3 else "b", base + m * minute, i) for i, m in enumerate(at)], "series string, us long, obs_id long").coalesce(1).write.parquet(str(tmp_path / "r"))
    read = lambda: spark.readStream.schema("series string, us long, obs_id long").parquet(str(tmp_path / "r")).select("series", F.timestamp_micros("us").alias("ts"), "obs_id")
    met = st.matched(read().select("series", F.col("obs_id").alias("issue_id"), F.col("ts").alias("at")), read(), "12 hours", "20 minutes", "1 hour")
    assert "bin" in met._jdf.queryExecution().analyzed().toString()
    st.run_to_end(met, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    name = lambda i: "a" if i % 3 else "b"
    assert got == sorted((i, j) for i, a in enumerate(at) for j, b in enumerate(at) if name(i) == name(j) and a + 720 <= b < a + 740)


def test_models_read_a_row_once(spark):
    """m06, m07, m15 (F10, F11, F37): a row that serves several days is scaled by each day's quartiles as it is summed; it is not written once for each."""
    import numpy as np

    from issuetime.operators import newton as nt

    rng = np.random.default_rng(19)
    rows = [("ab"[i % 2], int(i % 5), int(i % 5 + i % 3), [None if i % 31 == 0 else float(a), float(b)], int(a + b + rng.normal() > 0), float(rng.uniform(0.5, 2))) for i, (a, b) in enumerate(rng.normal(0, 3, (600, 2)))]
    table = spark.createDataFrame(rows, "key string, first long, last long, z array<double>, y int, w double").repartition(3)
    scales = {f"{k}{d}": ([0.1 * d, 0.0], [2.0 + d, None if k == "a" else 1.5]) for k in "ab" for d in range(8)}
    got = nt.fit_served(table, *nt.multinomial(2, 2), 0.05, scales, 20)
    held = lambda v, c, s: 0.0 if v is None or s is None else min(4.0, max(-4.0, (v - c) / s))
    plain = [(f"{k}{d}", [held(v, c, s) for v, c, s in zip(z, *scales[f"{k}{d}"])], y, w) for k, first, last, z, y, w in rows for d in range(first, last + 1)]
    want = nt.fit_softmax(spark.createDataFrame(plain, "key string, z array<double>, y int, w double"), "key", *nt.multinomial(2, 2), 0.05)
    assert set(got) == set(want) == {f"{k}{d}" for k in "ab" for d in range(7)}
    apart = lambda theta: theta[3:] - theta[:3]  # noqa: E731  # only the classes' difference is fixed
    assert all(apart(got[k]) == pytest.approx(apart(want[k]), abs=1e-6) for k in want)


def test_blocks_of_classes_equal_the_whole_derivatives():
    """m06, m07 (F10, F11): the classes' blocks hold all that the product with their zeros gave."""
    import numpy as np

    from issuetime.operators import newton as nt

    rng = np.random.default_rng(23)
    x, y, w, theta = rng.normal(size=(300, 4)), rng.integers(0, 3, 300), rng.uniform(0.1, 2, 300), rng.normal(size=15)
    design, _ = nt.multinomial(3, 4)
    got, want = nt.derivatives(design, x, y, w, theta), nt.derivatives(lambda v: design(v), x, y, w, theta)
    assert hasattr(design, "derivatives") and all(a == pytest.approx(b) for a, b in zip(got, want))


def test_leaf_quantiles_do_not_meet_every_cell(spark):
    """m10, m13 (F12, F13): an issue's quantiles come from halving the range of its leaves' cells, not from a join with all of them."""
    from issuetime.plans import forecasters as fc

    rng = random.Random(29)
    rows = [(t, k, rng.gauss(0, 60)) for t in range(fc.TREES) for k in (0, 3) for _ in range(40)]
    asked = [(i, t, rng.choice((0, 3))) for i in range(30) for t in range(fc.TREES)]
    leaves = spark.createDataFrame(rows, "tree int, leaf int, d double")
    met = fc.leaf_quantiles(leaves, leaves.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")), spark.createDataFrame(asked, "issue_id long, tree int, leaf int"), (0.05, 0.5, 1.0))
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    for r in met.collect():
        cells = {}
        for i, t, k in asked:
            for tree, leaf, d in rows:
                if i == r["issue_id"] and (t, k) == (tree, leaf):
                    cells.setdefault(math.floor(d / fc.CELL), []).append(d)
        want, upto = [], 0
        for p in (0.05, 0.5, 1.0):
            upto, place = 0, iter(sorted(cells))
            while upto < p * 40 * fc.TREES - 1e-6:
                at = next(place)
                upto += len(cells[at])
            want.append(sum(cells[at]) / len(cells[at]))
        assert r["q"] == pytest.approx(want)


def test_average_ranks_meet_no_equal_rows(spark):
    """a23 (F28): mean places from counts of the values, ties by arithmetic and nulls last; the query puts no equal rows in a window."""
    from issuetime.operators.ranks import average_ranks

    rng = random.Random(31)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)])) for _ in range(500)]
    counts = spark.createDataFrame(rows, "g string, v long").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    got = {(r["g"], r["v"]): (r["average"], r["total"]) for r in average_ranks(counts, "g", "v", "c", parts=8).collect()}
    for g in "ab":
        mine = sorted((v is None, v or 0) for s, v in rows if s == g)
        for none, v in set(mine):
            places = [i for i, m in enumerate(mine, 1) if m == (none, v)]
            assert got[g, None if none else v] == (sum(places) / len(places), len(mine))
    assert "count(1) windowspecdefinition" not in registry.queries()["a23_spearman"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_ridge_sums_move_a_row_once(spark):
    """m04 (F4): a row meets the scales of all models it serves at once, in groups that are split when large, and is not repeated for each model."""
    rng, group = random.Random(37), rg.GROUP
    rows = [(rng.choice("ab"), [1, 2, 3] if i % 2 else [2, 3], *(rng.gauss(0, 2) for _ in range(2)), rng.gauss(0, 1)) for i in range(400)]
    table = spark.createDataFrame(rows, "k string, serves array<long>, x0 double, x1 double, y double")
    whole = {(r["k"], r["model"]): r for r in rg.ridge_models(table, ["k"], "serves", ["x0", "x1"], "y", 2.0).collect()}
    try:
        rg.GROUP = 7
        split = rg.ridge_models(table, ["k"], "serves", ["x0", "x1"], "y", 2.0)
        plan = split._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["k"], r["model"]): r for r in split.collect()}
    finally:
        rg.GROUP = group
    assert "FlatMapCoGroupsInArrow" in plan and "inline(_scales" not in plan
    assert set(got) == set(whole) and all(got[m]["n"] == whole[m]["n"] and got[m]["coefficients"] == pytest.approx(whole[m]["coefficients"]) for m in whole)


def test_equal_rows_are_spread(spark, monkeypatch):
    """m04 (F4): a group of equal rows is dealt over its shares."""
    monkeypatch.setattr(rg, "GROUP", 10)
    table = spark.createDataFrame([("a", [1], 1.0, 2.0)] * 200, "k string, serves array<long>, x double, y double")
    scales = spark.createDataFrame([("a", 1, 200, [0.0], [1.0])], "k string, model long, n long, centers array<double>, widths array<double>")
    dealt = rg.product_sums(table, ["k"], "serves", ["x"], "y", scales)
    assert dealt.first()["sums"][0] == 200 and "monotonically_increasing_id" in dealt._jdf.queryExecution().optimizedPlan().toString()
