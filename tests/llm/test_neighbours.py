import numpy as np
import pytest

from issuetime.llm import neighbours as nn


def brute(rows, k=5, every=50):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q] / norm / norm[q]
        order = [j for j in np.lexsort((ids, -s.round(12))) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_curve_steps_are_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = nn.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_recall_of_small_windows(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = found(nn.nearest_neighbours(table, block=64))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q in got:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 400, 2)] + [(i, rng.standard_normal(3).tolist()) for i in range(1, 400, 2)]
    rows += [(1000, None), (1050, [0.0, 0.0, 0.0]), (1100, [1.0, None, 2.0]), (1150, [1.0, float("nan"), 2.0]), (1200, [float("inf"), 0.0, 1.0]), (1250, []), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<double>, class string, score double")
    got, want = found(nn.nearest_neighbours(table)), brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q, v in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in v], abs=1e-12)
    assert nn.nearest_neighbours(table.where("vec_id < 3 and vec_id > 0 or vec_id = 50")).count() == 2
    assert nn.nearest_neighbours(table.where("false")).count() == 0


def test_recall_of_queries_that_set_no_window(spark):
    """The registered parameters over several blocks; most queries are not among those that the windows are measured on."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((400, 64))
    x = np.concatenate([rng.standard_normal((6000, 64)), np.repeat(centres, 15, axis=0) + 0.6 * rng.standard_normal((6000, 64))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.permutation(x))], "vec_id bigint, embedding array<double>")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()], every=10)
    got = found(nn.nearest_neighbours(table, every=10))
    assert len(want) == 1200 > 4 * nn.SAMPLE and set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_huge_tiny_and_ragged_vectors(spark):
    rows = [(0, [1e200, 0.0, 1e200]), (1, [1.0, 0.0, 1.0]), (2, [1e-300, 1e-300, 0.0]), (3, [1.0, 2.0]), (50, [0.0, 5e-324, 0.0]), (4, [-1.0, 0.0, 0.0])]
    got = found(nn.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")))
    assert [i for i, _ in got[0]] == [1, 2, 50, 4] and [s for _, s in got[0]] == pytest.approx([1.0, 0.5, 0.0, -(0.5**0.5)])
    assert 3 not in got[0] and [i for i, _ in got[50]] == [2, 0, 1, 4] and got[50][0][1] == pytest.approx(0.5**0.5)


def test_repeated_ids_and_lengths(spark):
    """Every row of an id is a query with five places of its own, and a candidate for the other rows of that id."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(120)] + [(i, rng.standard_normal(2).tolist()) for i in (50, 200, 201, 202)]
    rows += [rows[50], (100, [1.0, 2.0, 3.0, 4.0]), (7, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 50 == 0:
            near = [(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), j) for c, (j, w) in enumerate(rows) if c != q and len(w) == len(v)]
            want += [(i, r, j, round(float(s), 9)) for r, (s, j) in enumerate(sorted(near, key=lambda n: (-round(n[0], 12), n[1]))[:5], 1)]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nn.nearest_neighbours(table).collect()]
    assert sorted(got) == sorted(want) and len(got) == 5 * 5 + 2 * 3
