import hashlib
import math
import random

import numpy as np
import pytest

from issuetime.llm import vector_codes as vc
from issuetime.llm.queries import op11_vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, length int, code string"


def plain(rows, parts=4, entries=256, rounds=4):
    """The contract's rows for vectors of one length, in plain Python."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n = len(kept[0][1])
    cuts = [n * i // parts for i in range(parts + 1)]
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, b"".join(int(x).to_bytes(8, "little", signed=True) for x in k[1])))[:entries]
    books = [[v[a:b] for _, v, _ in first] for a, b in zip(cuts, cuts[1:])]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
            for j, m in members.items():
                books[p][j] = [sum(c) // len(m) for c in zip(*m)]
    out, by_label = [], {}
    for i, v, label in kept:
        best = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, label, "".join(f"{j:02x}" for _, j in best), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*r, by_label[r[1]], digest) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("values", [3, 50, 100_000, 1 << 25])
def test_walk_finds_the_nearest_entry(values, monkeypatch):
    monkeypatch.setattr(vc, "CHILDREN", 7)
    rng = np.random.default_rng(values)
    leaves, entries = np.unique(rng.integers(-values, values, (500, 6)), axis=0), rng.integers(-values, values, (40, 6))
    entries[7] = entries[3]  # ties
    far = ((leaves[:, None, :] - entries[None]) ** 2).sum(2)
    seen = []
    for at, best, distance in vc.walk(leaves, entries):
        assert (best == far[at].argmin(1)).all() and (distance == far[at].min(1)).all()
        seen += at.tolist()
    assert sorted(seen) == list(range(len(leaves)))


def test_odd_rows_equal_plain_codes(spark, monkeypatch):
    """Null, repeated and negative ids, null labels, copies by the hundred, ties, unusable vectors, clashing columns."""
    rng = random.Random(2)
    rows = [(i % 290 - 5, [rng.choice([-0.5, -0.1, 0.0, 0.2, 1.0, 0.0001]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(330)]
    rows += [(None, [0.1] * 8, 1), (None, [-0.3] * 8, None)] + [(1000 + i, [0.25, -0.75] * 4, 3) for i in range(300)]
    bad = [(1, None, 1), (2, [1.0, None, *[0.0] * 6], 1), (3, [float("nan")] * 8, 1), (4, [float("inf"), *[0.0] * 7], None)]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows + bad], SCHEMA).repartition(3)
    assert got(vc.compress_vectors(table)) == plain(rows)


def test_lengths_and_bounds(spark):
    rows = [(1, [], 1), (2, [0.5], 1), (3, [1e300, -1e300], None), (4, [0.25, 0.5], 2), (5, [], None)]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)
    found = {r[0]: r[2:5] for r in got(vc.compress_vectors(table))}
    assert found == {1: ("00000000", 0, 0), 2: ("00000000", 0, 0), 3: ("00000000", 0, 0), 4: ("00010001", 0, 0), 5: ("00000000", 0, 0)}
    assert vc.compress_vectors(table.where("false")).count() == 0 and vc.compress_vectors(table.where("vec_id = 9")).count() == 0


def test_decoded_vectors_are_near(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vc.integer_vectors(table)
    books = vc.fit_codebooks(rows, 64)
    near = vc.decoded(vc.encoded(rows, books), books).join(table.select("vec_id", "embedding"), "vec_id")
    for r in near.collect():
        off = sum((math.floor(1024 * x) - 1024 * y) ** 2 for x, y in zip(r["embedding"], r["approximation"]))
        assert off == r["error"]


def test_query_equals_plain_codes(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 300").select("vec_id", "embedding", "label").collect()]
    assert got(vc.compress_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))) == plain(rows)
    assert op11_vector_codes(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
