"""Exact nearest rows by pivot cells against all distances."""

import numpy as np
import pytest

from issuetime.operators.nearest import nearest_rows

SCHEMA = "vec_id bigint, embedding array<double>"


@pytest.mark.parametrize(("spread", "pivots", "size"), [(0.01, 8, 50), (1.0, 5, 7), (0.3, 400, 4096)])
def test_all_nearest_are_found(spark, spread, pivots, size):
    """Clusters and noise, copies and ties, repeated ids, cells larger than a block; a third of the rows is one vector."""
    rng = np.random.default_rng(int(spread * 100))
    centers = rng.normal(size=(6, 5)) * 5
    x = centers[rng.integers(0, 6, 400)] + spread * rng.normal(size=(400, 5))
    x[:130] = x[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(7, x[200].tolist()), (399, x[3].tolist())]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = [r for r in rows if r[0] % 20 == 0]
    got = {}
    for r in nearest_rows(spark.createDataFrame(asked, SCHEMA), table, 4, pivots, size).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["d"]))
    assert len(got) == len(asked)
    for q, v in asked:
        want = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)), 12), i) for i, w in rows if i != q)[:4]
        mine = sorted(got[q])
        assert [m[2] for m in mine] == pytest.approx([d for d, _ in want], abs=1e-9) and [m[1] for m in mine] == [i for _, i in want]


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], SCHEMA)
    assert [tuple(r) for r in nearest_rows(table, table, 5).orderBy("query_id").collect()] == [(0, 1, 1.0, 1), (1, 0, 1.0, 1)]
    assert nearest_rows(table, table.where("false"), 5).count() == 0 and nearest_rows(table.where("false"), table, 5).count() == 0
