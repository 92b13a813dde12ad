"""Boosted trees of many training sets at once against ``pyspark.ml``'s, one set at a time."""

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from issuetime import registry
from issuetime.operators import boosting as bo


def spans_of(spark, n=900):
    """Rows of overlapping training sets; a feature with missing values, one that is constant, an outcome that is missing, one head known on no row of a set."""
    rng, rows = random.Random(41), []
    for _ in range(n):
        first = rng.randint(1, 4)
        z = [float(rng.randint(0, 9)), rng.choice([None, *(float(k) for k in range(7))]), 3.0, rng.choice([0.0, 0.0, 1.0])]
        y = 4 * z[0] - (z[1] or 0) ** 2 + 9 * z[3] * (z[0] > 4) + rng.gauss(0, 2)
        rows.append((first, min(first + rng.randint(0, 2), 5), [y if rng.random() < 0.9 else None, -y + z[0] if first > 2 else None], z))
    return rows, spark.createDataFrame(rows, "first long, last long, y array<double>, z array<double>").repartition(3).cache()


@pytest.mark.parametrize("absolute", [False, True])
def test_all_sets_at_once_equal_one_at_a_time(spark, absolute):
    """m05, m26 (F5, F15)"""
    rows, table = spans_of(spark)
    codes = bo.Codes(bo.edges(table, 4, 20), 4)
    trees = bo.fit_boosted(bo.coded(table, codes).cache(), codes, 2, absolute)
    asked = [(i, m, r[3]) for m in (1, 3, 5, 9) for i, r in enumerate(rows[:120])]
    said = bo.predict_boosted(spark.createDataFrame(asked, "i long, model long, z array<double>"), codes, trees, ["a", "b"], ["i", "model"])
    got = {(r["i"], r["model"]): (r["a"], r["b"]) for r in said.collect()}
    assert len(got) == len(asked) and {got[i, 9] for i in range(120)} == {(None, None)} and {got[i, 1][1] for i in range(120)} == {None}
    for m in (1, 3, 5):
        mine = [r for r in rows if r[0] <= m <= r[1]]
        known = sorted(r[3][1] for r in mine if r[3][1] is not None)
        middle = known[(len(known) + 1) // 2 - 1]
        vector = array_to_vector(F.transform("z", lambda v: F.coalesce(v, F.lit(middle))))
        for h in (0, 1):
            train = [(r[3], r[2][h]) for r in mine if r[2][h] is not None]
            if not train:
                continue
            frame = spark.createDataFrame(train, "z array<double>, label double").withColumn("features", vector)
            model = GBTRegressor(lossType="absolute" if absolute else "squared", maxIter=5, maxDepth=3, seed=7).fit(frame)
            test = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows[:120])], "i long, z array<double>").withColumn("features", vector)
            want = {r["i"]: r["prediction"] for r in model.transform(test).collect()}
            assert [got[i, m][h] for i in range(120)] == pytest.approx([want[i] for i in range(120)], abs=1e-6)


def test_no_rows_give_no_trees(spark):
    table = spans_of(spark)[1].where("false")
    codes = bo.Codes(bo.edges(table, 4, 20), 4)
    assert bo.fit_boosted(bo.coded(table, codes), codes, 2, False) == {}


def test_days_are_not_fitted_one_by_one(spark, monkeypatch):
    """m05, m26 (F5, F15): the number of jobs does not grow with days, heads or trees' nodes; no fit of a day is left."""
    from issuetime.plans import forecasters as fc

    monkeypatch.setattr(fc, "each_day", lambda *a, **k: pytest.fail("fitted day by day"))
    got = registry.queries()["m26_session_regressor"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["issue_id", "session", "step", "pred"] and got.count() > 0
