"""Checkers find what is planted: leaks, differing targets, and gaps longer than any window."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuetime import registry
from issuetime.operators import buckets as bk
from issuetime.plans import ledger
from issuetime.plans.targets import arrival_targets
from issuetime.schemas import HOUR, issues, readings

DIR = "/root/testdata/sf0.001"


def test_a_planted_leak_is_found(spark):
    r = readings(spark, DIR).select("obs_id", "series", "us", "v")

    def build(rows):
        order = Window.partitionBy("series").orderBy("us")
        return rows.select("obs_id", "us", F.lag("v").over(order).alias("past"), F.lead("v").over(order).alias("future"), F.avg("v").over(Window.partitionBy("series")).alias("mean"))

    found = {x["feature"]: (x["checked"], x["leaks"]) for x in ledger.leaks(build, r, "us", "obs_id", ledger.CUTS).collect()}
    names = r.select("series").distinct().count()
    assert found["past"][1] == 0 and 0 < found["future"][1] <= names * len(ledger.CUTS) and found["mean"][1] > found["future"][1]
    assert {c for c, _ in found.values()} == {sum(r.where(F.col("us") <= c).count() for c in ledger.CUTS)}


def test_planted_differences_are_counted(spark):
    d = "/root/testdata/sf0.01"
    targets = arrival_targets(spark, d)
    known = [x["issue_id"] for x in targets.where("target is not null").orderBy("issue_id").limit(5).collect()]
    open_ = targets.where("target is null").orderBy("issue_id").first()["issue_id"]
    wrong = F.when(F.col("issue_id").isin(known[:3]), F.col("target") + 0.001).when(F.col("issue_id") == known[3], None).when(F.col("issue_id") == open_, 1.0).otherwise(F.col("target"))
    closed = bk.closed_series(readings(spark, d))
    count = lambda t: sum(x["differ"] for x in ledger.target_differences(t, issues(spark, d), closed).collect())
    assert count(targets) == 0 and count(targets.withColumn("target", wrong)) == 5


def test_a_gap_of_ten_days_is_a_gap(spark, tmp_path):
    """The reading before the last hours may be older than any window; a series of one reading has no gap."""
    start = dt.datetime(2024, 3, 1)
    rows = [(i, start + dt.timedelta(days=10 * (i > 0), minutes=m), s, float(i)) for i, (m, s) in enumerate([(0, "a"), (0, "a"), (20, "a"), (100, "a"), (5, "b")])]
    spark.createDataFrame([(i, t, s, v, 1, '{"k": 3}') for i, t, s, v in rows], "event_id bigint, ts timestamp_ntz, event_type string, value double, user_id bigint, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["series"]: (r["n"], r["gaps"], r["last"]) for r in registry.queries()["a51_history_report"](spark, str(tmp_path)).collect()}
    assert got == {"a": (3, 2, 3.0), "b": (1, 0, 4.0)} and HOUR > 0


def test_policies_fail_missing_metrics_and_name_the_failures(spark):
    from issuetime.plans.policies import POLICY, judged

    metrics = spark.createDataFrame([("s", "all", "n", 5.0), ("s", "all", "mae", 2.0), ("t", "all", "n", 1.0), ("t", "all", "mae", None)], "series string, cohort string, metric string, value double")
    policy = spark.createDataFrame([("p", "much", "n", "all", ">=", 5.0), ("p", "near", "mae", "all", "<=", 2.5), ("q", "odd", "skill", "all", ">=", 0.0)], POLICY)
    got = {(r["series"], r["policy"], r["gate"]): (r["margin"], r["passed"], r["verdict"], r["failures"]) for r in judged(metrics, policy, ["series"]).collect()}
    assert got == {
        ("s", "p", "much"): (0.0, True, "qualified", ""), ("s", "p", "near"): (0.5, True, "qualified", ""), ("s", "q", "odd"): (None, False, "failed", "odd"),
        ("t", "p", "much"): (-4.0, False, "failed", "much,near"), ("t", "p", "near"): (None, False, "failed", "much,near"), ("t", "q", "odd"): (None, False, "failed", "odd"),
    }
