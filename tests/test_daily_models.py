"""Models of every day against plain Python: robust ridge, Newton steps, and refits by day on data of any month."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuetime.operators import learn as ln
from issuetime.operators import newton as nt
from issuetime.operators import ridge as rg
from issuetime.operators.nightly import nightly
from issuetime.plans import forecasters as fc
from issuetime.schemas import DAY, HOUR, STANDARD

DIR = "/root/testdata/sf0.01"
#: A day in a month that the test tables do not have.
START = 1_717_200_000_000_000


def quantile(values, p):
    return sorted(values)[max(1, math.ceil(p * len(values))) - 1]


def plain_ridge(x, y, alpha, clip=4.0, least=0.6):
    """Normal equations on robust-scaled columns; x may hold None and NaN."""
    z, scales = np.zeros((len(x), len(x[0]))), []
    for j in range(len(x[0])):
        known = [r[j] for r in x if r[j] is not None and math.isfinite(r[j])]
        if len(known) < least * len(x) or not known:
            scales.append(None)
            continue
        middle, width = quantile(known, 0.5), quantile(known, 0.75) - quantile(known, 0.25) or 1.0
        scales.append((middle, width))
        z[:, j] = [0.0 if r[j] is None or not math.isfinite(r[j]) else min(clip, max(-clip, (r[j] - middle) / width)) for r in x]
    y = np.array(y, float)
    centred = z - z.mean(0)
    w = np.linalg.solve(centred.T @ centred + alpha * np.eye(z.shape[1]), centred.T @ (y - y.mean()))
    return w, y.mean() - z.mean(0) @ w, scales


def test_twelve_columns_equal_the_normal_equations(spark):
    """Missing and non-finite values, columns that are mostly missing or constant, far values; one key holds most rows."""
    rng = np.random.default_rng(1)
    rows, names = [], [f"x{j}" for j in range(12)]
    for i in range(900):
        x = rng.standard_normal(12) * 3
        y = float(x[0] - 2 * x[1] + 0.5 * x[5] + rng.standard_normal())
        x = [float(v) for v in x]
        x[2], x[3], x[4] = 7.0, None if rng.random() < 0.5 else x[3], x[4] * (1000 if rng.random() < 0.05 else 1)
        x[6] = float("nan") if rng.random() < 0.2 else float("inf") if rng.random() < 0.1 else x[6]
        rows.append(("hot" if i % 9 else "cold", [k for k in (1, 2, 3) if rng.random() < 0.6], None if i % 50 == 0 else y, *x))
    table = spark.createDataFrame(rows, "k string, serves array<long>, y double, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r["k"], r["model"]): r for r in rg.ridge_models(table, ["k"], "serves", names, "y", 5.0).collect()}
    assert len(got) == 6
    for (k, m), r in got.items():
        mine = [row for row in rows if row[0] == k and m in row[1] and row[2] is not None]
        w, intercept, scales = plain_ridge([row[3:] for row in mine], [row[2] for row in mine], 5.0)
        assert r["n"] == len(mine) and r["coefficients"] == pytest.approx(w.tolist(), abs=1e-8) and r["intercept"] == pytest.approx(intercept, abs=1e-8)
        assert [c is not None for c in r["widths"]] == [s is not None for s in scales] and scales[3] is None
    first = table.where("k = 'hot'").withColumn("model", F.lit(1).cast("long")).join(rg.ridge_models(table, ["k"], "serves", names, "y", 5.0), ["k", "model"]).withColumn("p", rg.ridge_prediction(names)).select("p", *names).first()
    w, intercept, scales = plain_ridge([row[3:] for row in rows if row[0] == "hot" and 1 in row[1] and row[2] is not None], [row[2] for row in rows if row[0] == "hot" and 1 in row[1] and row[2] is not None], 5.0)
    z = [0.0 if s is None or first[n] is None or not math.isfinite(first[n]) else min(4, max(-4, (first[n] - s[0]) / s[1])) for n, s in zip(names, scales)]
    assert first["p"] == pytest.approx(intercept + float(np.dot(w, z)), abs=1e-7)
    assert rg.ridge_models(table.where("false"), ["k"], "serves", names, "y", 5.0).count() == 0


def plain_softmax(design, factors, x, y, w, penalty):
    """Gradient descent with backtracking on the whole objective: no second derivatives."""
    theta, total = np.zeros(len(factors)), w.sum()

    def value(t):
        p = nt.chances(design, x, t)
        return -(w * np.log(p[np.arange(len(y)), y])).sum() / total + penalty / 2 * (factors * t * t).sum()

    step = 1.0
    for _ in range(20_000):
        g = nt.derivatives(design, x, y, w, theta)[0] / total + penalty * factors * theta
        if np.abs(g).max() < 1e-8:
            break
        while value(theta - step * g) > value(theta) - step / 2 * (g @ g):
            step /= 2
        theta, step = theta - step * g, step * 1.5
    return theta


@pytest.mark.parametrize("kind", ["multinomial", "temperature", "stack"])
def test_newton_equals_plain_descent(spark, kind):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((400, 6 if kind == "stack" else 3)), rng.integers(0, 3, 400)
    x[np.arange(400), y] += 0.8
    w, keys = rng.uniform(0.5, 2, 400), ["a" if i % 5 else "b" for i in range(400)]
    design, factors = nt.multinomial(3, 3) if kind == "multinomial" else nt.stack(3, 2 if kind == "stack" else 1)
    table = spark.createDataFrame([(k, a.tolist(), int(b), float(c)) for k, a, b, c in zip(keys, x, y, w)], "key string, z array<double>, y int, w double").repartition(3)
    got = nt.fit_softmax(table, "key", design, factors, 0.05)
    said = nt.predict_softmax(table.withColumn("i", F.lit(1)), "key", design, got, ["a", "b", "c"], ["i", "z", "key"]).collect()
    for k in ("a", "b"):
        mine = np.array([key == k for key in keys])
        want = plain_softmax(design, factors, x[mine], y[mine], w[mine], 0.05)
        p = nt.chances(design, x[mine], want)
        mine_said = {tuple(r["z"]): (r["a"], r["b"], r["c"]) for r in said if r["key"] == k}
        assert all(mine_said[tuple(a.tolist())] == pytest.approx(tuple(q), abs=1e-6) for a, q in zip(x[mine], p))
    assert nt.fit_softmax(table.where("false"), "key", design, factors, 0.05) == {}


def ledger(spark, days=40):
    rng, rows = np.random.default_rng(3), []
    for i in range(days * 6):
        us = START + i * 4 * HOUR + int(rng.integers(0, HOUR))
        if us // DAY % 17 != 3:  # a day without issues
            rows.append(("ab"[i % 2], i, us, float(rng.normal()), None if i % 11 == 0 else us + 12 * HOUR, None if i % 11 == 0 else float(rng.normal() + i / 50)))
    return rows, spark.createDataFrame(rows, "series string, issue_id bigint, issue_us bigint, ref double, complete bigint, target double")


def test_every_day_of_another_month_is_predicted_from_rows_closed_before_it(spark, tmp_path):
    rows, table = ledger(spark)

    def fit(train, test, day):
        sums = train.agg(F.avg("target").alias("m"), F.count(F.lit(1)).alias("c"), F.max("complete").alias("last"))
        return test.crossJoin(F.broadcast(sums)).select("issue_id", F.col("m").alias("pred"), "c", "last")

    got = {r["issue_id"]: r for r in nightly(table, table, fit, "issue_id bigint, pred double, c bigint, last bigint", ["issue_id"], str(tmp_path), least=5).collect()}
    assert set(got) == {r[1] for r in rows}
    some = 0
    for _, i, us, *_ in rows:
        day = us // DAY * DAY
        train = [r for r in rows if r[5] is not None and r[4] < day and r[2] + STANDARD.embargo < day and r[2] > day - STANDARD.lookback]
        if len(train) >= 5:
            assert got[i]["c"] == len(train) and got[i]["pred"] == pytest.approx(np.mean([r[5] for r in train])) and got[i]["last"] < day
            some += 1
        else:
            assert got[i]["pred"] is None
    assert some > 150


def test_fits_by_day_equal_a_plain_loop(spark):
    """The forest of two days, fitted by hand on the rows that the rule of training rows names."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    from issuetime import registry

    rows = fc.model_rows(spark, DIR)
    got = {r["issue_id"]: (r["fall"], r["none"], r["rise"]) for r in registry.queries()["m08_class_forest"](spark, DIR).collect()}
    assert set(got) == {r["issue_id"] for r in rows.select("issue_id").collect()}
    spans = fc.kept(ln.training_spans(rows), "plain-spans")
    for day in (19734, 19750):
        start = day * DAY
        train = spans.where((F.col("complete") < start) & (F.col("issue_us") + STANDARD.embargo < start) & (F.col("issue_us") > start - STANDARD.lookback)).drop("first", "last")
        train, test = fc.scaled(train, rows.where(F.col("issue_us").between(start, start + DAY - 1)))
        known = train.withColumn("y", fc.three_classes(F.col("d")).cast("double"))
        model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=fc.TREES, maxDepth=5, minInstancesPerNode=10, seed=7).fit(known.select("x", "y"))
        said = model.transform(test).select("issue_id", vector_to_array("probability").alias("p")).collect()
        assert len(said) > 50 and all(got[r["issue_id"]] == pytest.approx(tuple(r["p"]), abs=1e-9) for r in said)


@pytest.fixture(scope="module")
def ledger_rows(spark):
    return fc.model_rows(spark, DIR), [r.asDict() for r in fc.model_rows(spark, DIR).collect()]


def of_day(rows, day, target, complete):
    """Training and test rows of a day by the rule of training rows."""
    start = day * DAY
    train = [r for r in rows if r[target] is not None and complete(r) < start and start - STANDARD.lookback < r["issue_us"] < start - STANDARD.embargo]
    return train, [r for r in rows if r["issue_us"] // DAY == day]


def scaled_plainly(rows, scales, columns):
    return np.array([[0.0 if s is None or r[c] is None else min(4, max(-4, (r[c] - s[0]) / s[1])) for c, s in zip(columns, scales)] for r in rows])


def test_ridge_heads_equal_the_normal_equations_of_their_days(spark, ledger_rows):
    from issuetime import registry

    got = {r["issue_id"]: r["arrival"] for r in registry.queries()["m04_ridge_heads"](spark, DIR).collect()}
    for day in (19735, 19748):
        train, test = of_day(ledger_rows[1], day, "target", lambda r: r["complete"])
        w, intercept, scales = plain_ridge([[r[c] for c in fc.COLUMNS] for r in train], [r["target"] - r["ref"] for r in train], 10.0)
        for r, z in zip(test, scaled_plainly(test, scales, fc.COLUMNS)):
            assert got[r["issue_id"]] == pytest.approx(r["ref"] + intercept + z @ w, abs=1e-6)


def test_calibration_equals_plain_descent_of_its_days(spark):
    from issuetime import registry

    rows = [r.asDict() for r in fc.base_chances(spark, DIR).collect()]
    got = {r["issue_id"]: r for r in registry.queries()["m15_stacked_chances"](spark, DIR).collect()}
    for name, x, (design, factors) in (("temperature", ["a0", "a1", "a2"], nt.stack(3)), ("stack", ["a0", "a1", "a2", "b0", "b1", "b2"], nt.stack(3, 2))):
        train, test = of_day(rows, 19740, "target", lambda r: r["complete"])
        theta = plain_softmax(design, factors, np.array([[r[c] for c in x] for r in train]), np.array([r["y"] for r in train]), np.ones(len(train)), 0.01)
        for r, p in zip(test, nt.chances(design, np.array([[r[c] for c in x] for r in test]), theta)):
            assert [got[r["issue_id"]][f"{name}_{c}"] for c in ("fall", "none", "rise")] == pytest.approx(p.tolist(), abs=1e-6)


def test_leaf_quantiles_are_within_a_cell(spark):
    rng = np.random.default_rng(8)
    leaf = {(t, k): rng.normal(0, 30, rng.integers(15, 60)).tolist() for t in range(fc.TREES) for k in (1, 2)}
    rows = spark.createDataFrame([(t, k, v) for (t, k), vs in leaf.items() for v in vs], "tree int, leaf int, d double")
    asked = [(i, t, int(rng.integers(1, 3))) for i in range(20) for t in range(fc.TREES)]
    levels = (0.05, 0.25, 0.5, 0.9)
    got = fc.leaf_quantiles(rows, rows.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")), spark.createDataFrame(asked, "issue_id int, tree int, leaf int"), levels).collect()
    assert len(got) == 20
    for r in got:
        weighted = sorted((v, 1 / len(leaf[t, k]) / fc.TREES) for i, t, k in asked if i == r["issue_id"] for v in leaf[t, k])
        total = np.cumsum([w for _, w in weighted])
        assert r["q"] == pytest.approx([weighted[int(np.searchsorted(total, p - 1e-9))][0] for p in levels], abs=fc.CELL)
        assert r["fell"] == pytest.approx(sum(w for v, w in weighted if v <= -20))


def test_issues_of_another_month_get_forecasts(spark, tmp_path):
    """The whole of two forecasters on tables moved by five months: same forecasts as before."""
    import shutil

    from issuetime import registry

    moved = tmp_path / "moved"
    moved.mkdir()
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.withColumn("ts", F.col("ts") + F.expr("interval 151 days")).coalesce(1).write.parquet(str(moved / "events.parquet"))
    shutil.copy(f"{DIR}/orders.parquet", moved / "orders.parquet")
    for name in ("m04_ridge_heads", "m27_log_linear"):
        here, there = (sorted(tuple(r) for r in registry.queries()[name](spark, d).select("issue_id", "arrival" if name[2] == "4" else "pred").collect() if r[1] is not None) for d in (DIR, str(moved)))
        assert len(here) > 1000 and [r[0] for r in here] == [r[0] for r in there] and [r[1] for r in here] == pytest.approx([r[1] for r in there], rel=1e-9 if name[1:3] == "04" else 1e-3)  # past SKETCH rows quartiles are approximate
