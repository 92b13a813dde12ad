"""Operators whose work or memory once grew faster than their tables, or met in one task, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from issuetime import registry
from issuetime.operators import frames as fr
from issuetime.operators import nearest as nr
from issuetime.operators import selection as sel
from issuetime.plans import scans, weather
from issuetime.schemas import HOUR, run_hours_of

DIR, Q = "/root/testdata/sf0.01", registry.queries()


def exploded_shuffles(plan: str) -> int:
    """Shuffles of exploded rows that no aggregate has reduced before."""
    lines, found = plan.splitlines(), 0
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for n, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = [b for b in lines[n + 1 :]]
            end = next((i for i, b in enumerate(below) if depth(b) <= depth(line)), len(below))
            names = [next((k for k in ("Aggregate", "Generate explode", "Exchange") if k in b), None) for b in below[:end]]
            found += next((k for k in names if k), None) == "Generate explode"
    return found


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lattices_are_built_by_many_tasks(spark):
    """a22 (F41): suppliers are few bytes, read by one task; their lattices are built after they are dealt, and no filter builds them before."""
    assert scans.grid(spark, DIR).select(F.spark_partition_id().alias("p")).distinct().count() > 4
    plan = plan_of(Q["a22_grid_gradient"](spark, DIR))
    assert plan.index("Exchange") > plan.index("Generate") and "flatten" not in plan[plan.index("Exchange") :]


def test_hours_of_payloads_are_not_shuffled(spark):
    """s03 (F38)"""
    assert exploded_shuffles(plan_of(Q["s03_all_run_hours"](spark, DIR))) == 0


def test_revisions_of_many_runs_of_a_clock(spark):
    """w16 (F36): what is shuffled and ordered is a row for each clock and hour, not for each run and hour; against a plain loop."""
    rng = random.Random(5)
    runs = [(i, 1_704_067_200_000_000 + rng.randrange(9) * HOUR // 2, rng.choice("ab"), rng.randrange(50)) for i in range(300)]
    table = spark.createDataFrame(runs, "run_id long, fetched long, source string, cust long")
    out = weather.revisions(table)
    assert exploded_shuffles(plan_of(out)) == 0
    hours, want = {}, {}
    for r in run_hours_of(table).where("temp is not null").collect():
        hours.setdefault((r["source"], r["valid"]), []).append((r["fetched"], r["run_id"], r["temp"]))
    for (source, valid), met in hours.items():
        for fetched, run, temp in met:
            older = [x for x in met if x[0] <= fetched - HOUR]
            if older:
                want[source, valid, run] = round(temp - max(older)[2], 6)
    got = out.collect()
    assert len(got) == len(want) > 5000 and {(r["source"], r["valid"], r["run_id"]): r["revision"] for r in got} == want


def test_bins_before_points(spark):
    """w04 (F34): bins by totals from either side of their edges, no pairs; rows on edges, without value, key or clock."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-60, 300)]), rng.choice([None, float("nan"), rng.random(), rng.random(), rng.random()])) for _ in range(400)]
    points = [(rng.choice(["a", "b", None]), i // 2 if i < 20 else i, rng.choice([None, *range(-50, 330)])) for i in range(150)]
    out = fr.trailing_bins(spark.createDataFrame(points, "series string, id long, at long"), spark.createDataFrame(rows, "series string, us long, v double"), "at", "us", 10, 4, "id")
    assert "Join" not in plan_of(out)
    want = {}
    for series, i, at in points:
        for s, us, v in rows:
            if series is not None and s == series and None not in (at, us) and 0 <= at - us < 40:
                want.setdefault((i, (at - us) // 10), []).append(v)
    got = {(r["id"], r["bin"]): (r["n"], r["mean"]) for r in out.collect()}
    assert set(got) == set(want)
    for k, values in want.items():
        known = [v for v in values if v is not None]
        assert got[k][0] == len(values) and got[k][1] == (pytest.approx(sum(known) / len(known), nan_ok=True) if known else None)


def test_tasks_hand_on_few_rows_at_once():
    """l06, m17 (F39, F40): a task's questions leave it in frames of bounded size, however many blocks they go to."""
    taken = iter(range(10_000))
    frames = nr.in_frames(((i, [0.0], i % 3) for i in taken), {"query_id": "int64", "embedding": "object", "cell": "int32"}, 300)
    first = next(frames)
    assert len(first) == 300 and next(taken) <= 301 and first.dtypes.astype(str).tolist() == ["int64", "object", "int32"]
    assert sum(len(f) for f in frames) == 9_699 and list(nr.in_frames(iter(()), {"a": "int64"})) == []


def test_queries_of_several_lots(spark, monkeypatch):
    """l06, m17 (F39, F40): a block meets a bounded number of queries at once, with the same rows found."""
    rng = random.Random(2)
    table = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(200)], "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in nr.nearest_rows(table, table, 3, 4, 30).collect())
    monkeypatch.setattr(nr, "LOT", 40)
    assert whole == sorted(tuple(r) for r in nr.nearest_rows(table, table, 3, 4, 30).collect()) and len(whole) == 600


def test_cases_of_a_hot_key_do_not_meet(spark):
    """l05 (F32): few keys' choices go to the cases; before, all of a key's cases went to one task in every round."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(500), round(rng.random(), 2)) for _ in range(300)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sel.separated_nearest(spark.createDataFrame(rows, "series string, us long, d double"), 4, 60, "us", "series", "d")
        assert "SortMergeJoin" not in plan_of(out)
        got = {(r["series"], r["rank"]): (r["d"], r["us"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for key in "ab":
        picks = []
        for _ in range(4):
            free = [(d, us) for s, us, d in rows if s == key and all(abs(us - t) >= 60 for _, t in picks)]
            picks += [min(free)] if free else []
        assert [got[key, i + 1] for i in range(len(picks))] == picks
