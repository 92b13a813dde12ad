"""Operators over every hour of every run and every level, against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from issuetime import registry
from issuetime.functions.clock import corrected_everywhere
from issuetime.schemas import run_hours

DIR, Q = "/root/testdata/sf0.001", registry.queries()


@pytest.fixture(scope="module")
def hours(spark):
    return run_hours(spark, DIR).collect()


def test_all_hours_of_accepted_runs(spark, hours):
    got = {(r["run_id"], r["h"]): r["temp"] for r in Q["s03_all_run_hours"](spark, DIR).collect()}
    assert got == {(r["run_id"], r["h"]): r["temp"] for r in hours if r["source"] in ("1-URGENT", "5-LOW")}


def test_all_points_and_vectors(spark, hours):
    got = {(r["run_id"], r["h"]): r["pprob"] for r in Q["p03_all_points"](spark, DIR).collect()}
    assert got == {(r["run_id"], r["h"]): r["pprob"] - 5 if r["pprob"] is not None and 5 <= r["pprob"] <= 95 else None for r in hours}
    got = {(r["run_id"], r["h"]): r["u"] for r in Q["f11_all_vectors"](spark, DIR).collect()}
    assert len(got) == len(hours)
    for r in hours:
        u = got[r["run_id"], r["h"]]
        assert u is None if r["speed"] is None else u == pytest.approx(-r["speed"] * math.sin(math.radians(r["direction"])), abs=2e-6)


def test_all_revisions(spark, hours):
    want, before = {}, {}
    for r in sorted((r for r in hours if r["temp"] is not None), key=lambda r: (r["fetched"], r["run_id"])):
        older = [x for x in before.setdefault((r["source"], r["valid"]), []) if x["fetched"] <= r["fetched"] - 3_600_000_000]
        if older:
            want[r["source"], r["valid"], r["run_id"]] = round(r["temp"] - older[-1]["temp"], 6)
        before[r["source"], r["valid"]].append(r)
    assert {(r["source"], r["valid"], r["run_id"]): r["revision"] for r in Q["w16_all_revisions"](spark, DIR).collect()} == want


def test_wet_end_beyond_the_first_day(spark, hours):
    rain = {}
    for r in hours:
        rain.setdefault(r["run_id"], {})[r["h"]] = r["precip"]
    seen = set()
    for r in Q["e14_whole_runs"](spark, DIR).collect():
        x = rain.pop(r["run_id"])
        wet = [h for h in range(25) if x[h]]
        after = [h for h in range(wet[-1] + 1, 48) if not x[h]] if wet else []
        status = "missing" if None in [x[h] for h in range(25)] else "dry" if not wet else "open" if not after else "end missing" if x[after[0]] is None else "ends"
        assert (r["status"], r["first_wet"], r["dry_again"]) == (status, wet[0] if wet else None, after[0] if status == "ends" else None)
        seen.add((status, bool(after) and after[0] > 24))
    assert not rain and ("ends", True) in seen


def test_levels_of_every_range(spark):
    rows = [(0.0, 50.0), (1.0, 90.0), (40.0, 50.0), (209.0, 50.0), (210.0, 50.0), (235.0, 50.0), (260.0, 50.0), (500.0, 50.0), (300.0, None), (300.0, math.nan), (None, 50.0)]
    got = [r["c"] for r in spark.createDataFrame(rows, "v double, rh double").coalesce(1).select(corrected_everywhere(F.col("v"), F.col("rh")).alias("c")).collect()]
    want = [0, 0, (0.786 * 0.5 + 0.524 * 0.5) * 40 + 1.44, 0.786 * 209 + 1.44, 0.786 * 210 + 1.44, 0.738 * 235 - 2.155 + 4.358, 2.966 + 0.69 * 260 + 8.84e-4 * 260**2, 2.966 + 345 + 221, 300, 300, None]
    assert got == [None if w is None else pytest.approx(w) for w in want]
    assert Q["f10_all_levels"](spark, DIR).count() == 1000
