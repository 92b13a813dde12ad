"""Pairs of issues and trailing rows, dealt evenly."""

import random

import pytest

from issuetime import registry
from issuetime.operators import joins as jn


@pytest.mark.parametrize("parts, share", [(1, None), (4, 50), (7, 50)])
def test_bins_lose_and_repeat_no_pair(spark, parts, share):
    """j07 (F3): rows at the reach's and the bins' edges, clocks before 1970, an empty series."""
    rng = random.Random(parts)
    clock = lambda: rng.choice([rng.randint(-300, 300), rng.randrange(-300, 301, 25)])
    asked, rows = ([(rng.choice("ab" + only), i, clock()) for i in range(n)] for n, only in ((150, "c"), (200, "d")))
    out = jn.trailing_join(spark.createDataFrame(asked, "series string, issue_id long, at long"), spark.createDataFrame(rows, "series string, obs_id long, us long"), "at", "us", 100, parts=parts, share=share)
    got = sorted((r["issue_id"], r["obs_id"]) for r in out.collect())
    assert got == sorted((i, j) for a, i, t in asked for b, j, u in rows if a == b and t - 100 < u <= t)
    assert out.columns == ["series", "issue_id", "at", "obs_id", "us"]


def test_pairs_are_made_by_many_tasks(spark):
    """j07 (F3): neither in a task of the side that is streamed past a broadcast nor in as few as its bytes ask for."""
    out = registry.queries()["j07_trailing_readings"](spark, "/root/testdata/sf0.01")
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    assert out.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and out.count() == 30758
