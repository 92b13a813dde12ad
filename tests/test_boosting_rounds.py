"""Boosted trees through many rounds, held by one task or grown by passes over the rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor

from issuetime.operators import boosting as bo
from issuetime.plans import forecasters as fc
from tests.test_boosting import spans_of


@pytest.mark.parametrize("absolute", [False, True])
def test_held_rows_give_the_trees_of_passes(spark, absolute):
    """m05 (F5)"""
    _, table = spans_of(spark, 400)
    codes = bo.Codes(bo.edges(table, 4, 20), 4)
    coded = bo.coded(table, codes).cache()
    held, passed = (bo.fit_boosted(coded, codes, 2, absolute, 3, 4, whole) for whole in (bo.WHOLE, 0))
    assert set(held) == set(passed) and len(held) > 5
    for k in held:
        for mine, other in zip(held[k], passed[k], strict=True):
            assert mine[0].tolist() == other[0].tolist()
            assert np.allclose(mine[2], other[2], atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("absolute", [False, True])
def test_many_rounds_equal_pyspark_ml(spark, absolute):
    """m05 (F5): trees and depth as asked for, rows in several parts and features joined to several numbers."""
    rng = np.random.default_rng(3)
    z = rng.integers(0, 9, (700, 5)).astype(float)
    y = 3 * z[:, 0] - z[:, 1] ** 2 + 5 * (z[:, 2] > z[:, 3]) + rng.normal(0, 2, 700)
    frame = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(z, y, strict=True)], "z array<double>, label double").withColumn("features", array_to_vector("z"))
    model = GBTRegressor(lossType="absolute" if absolute else "squared", maxIter=25, maxDepth=4, seed=7).fit(frame)
    want = [r["prediction"] for r in model.transform(frame).collect()]
    whole, bo.CHUNK = bo.CHUNK, 128
    try:
        trees = bo.grown(z.astype(np.uint8), y, 25, 4, absolute)
    finally:
        bo.CHUNK = whole
    assert len(trees) == 25
    assert bo.predicted(trees, z.astype(np.uint8)) == pytest.approx(want, abs=1e-6)


def test_heads_get_all_their_rounds(spark, monkeypatch):
    """m05 (F5): as many trees as the reference's ``max_iter``, at least as many leaves."""
    seen, fit = [], bo.fit_boosted
    monkeypatch.setattr(bo, "fit_boosted", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    assert fc.boosted_heads(spark, "/root/testdata/sf0.01").count() == 3334
    (trees,) = seen
    assert trees and {len(t) for t in trees.values()} == {120}
    assert {len(t[0]) for t in next(iter(trees.values()))} == {31}
