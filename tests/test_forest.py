"""Forests of many training sets at once (F6, F31) against ``pyspark.ml``'s trees, one set at a time, and plain medians."""

import random
import statistics

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from issuetime import registry
from issuetime.operators import boosting as bo
from issuetime.operators import forest as ft
from issuetime.operators import ridge as rg

DIR = "/root/testdata/sf0.001"


def spans_of(spark, features, outcome, n=900):
    rng, rows = random.Random(41), []
    for i in range(n):
        first = rng.randint(1, 4)
        z = [float(rng.randint(0, 9)), float(rng.randint(0, 6))][:features]
        y = outcome(z, rng)
        rows.append((first, min(first + rng.randint(0, 2), 5), [y, None if y is None else 2 * y + 1, None if y is None else z[0]], z, i))
    return rows, spark.createDataFrame(rows, "first long, last long, y array<double>, z array<double>, key long").repartition(3).cache()


def fitted(table, features, **kind):
    codes = bo.Codes(bo.edges(table, features, 20), features)
    coded = bo.coded(table, codes, ("key",)).cache()
    return codes, coded, ft.fit_forest(coded, codes, bootstrap=False, **kind)


def asked_of(spark, rows, model):
    return spark.createDataFrame([(r[4], model, r[3]) for r in rows[:150]], "i long, model long, z array<double>")


def test_classes_of_all_sets_equal_one_set_at_a_time(spark):
    """Two features, so that every node may split by both; weighted classes, some outcomes missing."""
    rows, table = spans_of(spark, 2, lambda z, rng: None if rng.random() < 0.1 else float(min(2, max(0, (z[0] + 2 * (z[1] > 3) + rng.gauss(0, 2)) // 4))))
    weights = {m: [1 / sum(r[0] <= m <= r[1] and r[2][0] == k for r in rows) for k in range(3)] for m in range(1, 6)}
    codes, _, forest = fitted(table, 2, trees=1, depth=4, least=5, classes=weights)
    for m in (1, 3, 5, 9):
        got = {r["i"]: (r["a"], r["b"], r["c"]) for r in ft.predict_forest(asked_of(spark, rows, m), codes, forest, ["a", "b", "c"], ["i"]).collect()}
        if m == 9:
            assert set(got.values()) == {(None, None, None)}
            continue
        train = [(r[3], r[2][0], weights[m][int(r[2][0])]) for r in rows if r[0] <= m <= r[1] and r[2][0] is not None]
        frame = spark.createDataFrame(train, "z array<double>, label double, w double").withColumn("features", array_to_vector("z"))
        model = DecisionTreeClassifier(maxDepth=4, minInstancesPerNode=5, weightCol="w").fit(frame)
        said = model.transform(asked_of(spark, rows, m).withColumn("features", array_to_vector("z"))).select("i", vector_to_array("probability").alias("p")).collect()
        assert all(got[r["i"]] == pytest.approx(tuple(r["p"]), abs=1e-9) for r in said)


def test_means_of_all_sets_equal_one_set_at_a_time(spark):
    rows, table = spans_of(spark, 1, lambda z, rng: None if rng.random() < 0.1 else z[0] ** 2 + rng.gauss(0, 3))
    codes, coded, forest = fitted(table, 1, trees=2, depth=3, least=15)
    means = ft.leaf_means(coded, codes, forest, 2)
    for m in (1, 3, 5):
        train = [(r[3], r[2][0]) for r in rows if r[0] <= m <= r[1] and r[2][0] is not None]
        frame = spark.createDataFrame(train, "z array<double>, label double").withColumn("features", array_to_vector("z"))
        model = DecisionTreeRegressor(maxDepth=3, minInstancesPerNode=15).fit(frame)
        want = {r["i"]: r["prediction"] for r in model.transform(asked_of(spark, rows, m).withColumn("features", array_to_vector("z"))).collect()}
        got = {r["i"]: r["a"] for r in ft.predict_forest(asked_of(spark, rows, m), codes, forest, ["a"], ["i"]).collect()}
        assert got == pytest.approx(want, abs=1e-6)
        twice = {r["i"]: r["b"] for r in ft.predict_forest(asked_of(spark, rows, m), codes, means, ["b", "c"], ["i"]).collect()}
        assert twice == pytest.approx({i: 2 * v + 1 for i, v in want.items()}, abs=1e-6)


def test_rows_are_drawn_once_on_average():
    often = ft.drawn(np.arange(-20_000, 20_000), 12)
    assert often.shape == (40_000, 12) and abs(often.mean() - 1) < 0.01 and abs(often.var() - 1) < 0.02
    assert np.abs(np.corrcoef(often.T) - np.eye(12)).max() < 0.03


def test_medians_of_all_sets(spark):
    rng = random.Random(3)
    rows = [(k := rng.choice("ab"), sorted({rng.randint(1, 3), rng.randint(1, 3)}), rng.choice([None, float("nan"), round(rng.gauss(0, 9), 1)]) if k == "a" else round(rng.gauss(0, 9))) for _ in range(301)]
    table = spark.createDataFrame([(k, s, None if v is None else float(v)) for k, s, v in rows], "kind string, s array<int>, v double")
    got = {(r["kind"], r["model"]): (r["n"], r["median"]) for r in rg.medians(table, ["kind"], "s", "v").collect()}
    for k, m in got:
        mine = [v for x, s, v in rows if x == k and m in s]
        assert got[k, m] == (len(mine), pytest.approx(statistics.median(v for v in mine if v is not None and v == v)))
    assert len(got) == 6


def test_no_rows_give_no_trees(spark):
    table = spans_of(spark, 2, lambda z, rng: z[0])[1].where("false")
    codes, coded, forest = fitted(table, 2, trees=2, depth=3, least=1, classes=3)
    assert forest == {} and ft.leaf_means(coded, codes, forest, 2) == {}


@pytest.mark.parametrize("name", ["m25_class_medians", "m28_joint_extrema"])
def test_days_are_not_fitted_one_by_one(spark, monkeypatch, name):
    from issuetime.plans import forecasters as fc

    monkeypatch.setattr(fc, "each_day", lambda *a, **k: pytest.fail("fitted day by day"))
    got = registry.queries()[name](spark, DIR)
    assert got.count() == got.select("issue_id").distinct().count() > 0
