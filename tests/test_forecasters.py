"""Queries that SQL can't express, against plain Python on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuetime import registry
from issuetime.plans import forecasters as fc
from issuetime.plans.targets import arrival_targets
from issuetime.schemas import DAY, HOUR, readings
from issuetime.streaming import buckets as st
from issuetime.streaming import detector

DIR, Q = "/root/testdata/sf0.01", registry.queries()


@pytest.fixture(scope="module")
def rows(spark):
    return fc.model_rows(spark, DIR)


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Three weeks of one series, dense enough that most buckets are closed."""
    at = tmp_path_factory.mktemp("dense")
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    events.where("event_type = 'click' and ts < timestamp'2024-01-12'").coalesce(1).write.parquet(str(at / "events.parquet"))
    return str(at)


def test_change_chances_equal_newtons_method(spark, rows):
    """One head of one day against Newton's method on its training rows."""
    levels = {(r["series"], r["label"]): r["med"] for r in fc.bk.closed_series(readings(spark, DIR)).collect()}
    got = {r["issue_id"]: r["fall_4"] for r in Q["m07_change_chances"](spark, DIR).collect()}
    base = [r.asDict() | {"med": levels.get((r["series"], r["label"] + 4 * fc.B))} for r in rows.collect()]
    assert set(got) == {r["issue_id"] for r in base}
    start = 19742 * DAY
    train = [r for r in base if r["med"] is not None and r["label"] + 4 * fc.B < start and start - 14 * DAY < r["issue_us"] < start - 44 * HOUR]
    scales = []
    for c in fc.COLUMNS:
        known = sorted(r[c] for r in train if r[c] is not None)
        q = [known[max(1, int(np.ceil(p * len(known)))) - 1] for p in (0.25, 0.5, 0.75)] if len(known) >= 0.6 * len(train) else None
        scales.append(q and (q[1], q[2] - q[0] or 1.0))
    z = lambda frame: np.array([[1.0] + [0.0 if s is None or r[c] is None else np.clip((r[c] - s[0]) / s[1], -4, 4) for c, s in zip(fc.COLUMNS, scales)] for r in frame])
    x, y = z(train), np.array([r["med"] - r["ref"] <= -20 for r in train], float)
    # two classes with weights of opposite sign: a penalty on both is one on half the difference
    w, ridge = np.zeros(x.shape[1]), 0.005 * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(y) + ridge + 1e-12 * np.eye(len(w)), x.T @ (p - y) / len(y) + ridge @ w)
    test = [r for r in base if r["issue_us"] // DAY == 19742]
    assert [got[r["issue_id"]] for r in test] == pytest.approx((1 / (1 + np.exp(-z(test) @ w))).tolist(), abs=1e-6) and len(test) > 50


def test_thin_support_gives_no_chance(spark, rows):
    """A head without events, or with hardly any rows, has no model."""
    few = rows.withColumns({"y": F.lit(0), "w": F.lit(1.0)})
    said = fc.softmax_days(few, few, fc.COLUMNS, *fc.nt.multinomial(2, len(fc.COLUMNS)), ["no", "yes"], ["issue_id"])
    assert {r["yes"] for r in said.collect()} == {None}


def test_leaf_weights_give_the_forests_mean(spark):
    got = [r for r in Q["m10_leaf_distribution"](spark, DIR).collect() if r["mean"] is not None]
    assert len(got) > 2500
    for r in got:
        assert r["mean"] == pytest.approx(r["forest"], abs=1e-6) and 0 <= r["p_fall"] <= 1 and r["q25"] <= r["q50"] <= r["q75"]


def test_quantiles_and_extrema_are_ordered(spark, dense):
    got = [r for r in Q["m13_quantile_forest"](spark, dense).collect() if r["q5"] is not None]
    assert len(got) > 500
    for r in got:
        q = [r[c] for c in ("q5", "q10", "q25", "q40", "q50", "q60", "q75", "q90", "q95")]
        assert q == sorted(q) and 0 <= r["p70"] <= 1
    both = [r for r in Q["m28_joint_extrema"](spark, dense).collect() if r["low"] is not None]
    assert len(both) > 500 and all(r["low"] <= r["high"] for r in both)


def test_incidence_is_the_fold_of_the_hazards(spark, dense):
    got = [r for r in Q["m09_hazards"](spark, dense).collect() if r["fall"] is not None]
    assert len(got) > 50
    for r in got:
        alive, fall, rise = 1.0, 0.0, 0.0
        for k in range(1, 7):
            f, s = r[f"fall_{k}"], r[f"rise_{k}"]
            assert f >= 0 and s >= 0 and f + s <= 1 + 1e-9
            alive, fall, rise = alive * (1 - f - s), fall + alive * f, rise + alive * s
        assert (r["fall"], r["rise"]) == pytest.approx((fall, rise))


def test_fitted_heads_beat_the_level(spark, rows):
    truth = {r["issue_id"]: (r["target"], r["ref"]) for r in rows.where("target is not null").collect()}
    for name, column in (("m05_boosted_heads", "arrival"), ("m04_ridge_heads", "arrival"), ("m25_class_medians", "pred")):
        met = [(r[column], *truth[r["issue_id"]]) for r in Q[name](spark, DIR).collect() if r["issue_id"] in truth and r[column] is not None]
        assert len(met) > 700 and np.mean([abs(p - y) for p, y, _ in met]) < np.mean([abs(ref - y) for _, y, ref in met])


@pytest.mark.parametrize("name", ["m08_class_forest", "m06_logistic_change"])
def test_chances_of_classes(spark, name):
    got = Q[name](spark, DIR).collect()
    truth = {r["issue_id"]: r["target"] - r["ref"] for r in arrival_targets(spark, DIR).where("target is not null").collect()}
    columns = ("p_fall", "p_none", "p_rise") if name == "m06_logistic_change" else ("fall", "none", "rise")
    assert len(got) == readings(spark, DIR).where("obs_id % 3 = 0").count()
    if name == "m06_logistic_change":
        assert all(min(r[f"c{k}"] for k in range(5)) >= fc.FLOOR / 1.05 and r["c0"] + r["c1"] == pytest.approx(r["p_fall"]) for r in got if r["c0"] is not None)
    chances = {r["issue_id"]: [r[c] for c in columns] for r in got if r[columns[0]] is not None}
    assert len(chances) > 2500 and all(sum(p) == pytest.approx(1) and min(p) >= 0 for p in chances.values())
    fell = [p[0] for i, p in chances.items() if i in truth and truth[i] <= -20]
    assert np.mean(fell) > np.mean([p[0] for i, p in chances.items() if i in truth and truth[i] > -20])


def test_calibrated_chances_score_better_than_issued(spark):
    truth = {r["issue_id"]: (float(r["target"] - r["ref"] <= -20), r["p_fall"]) for r in arrival_targets(spark, DIR).where("target is not null").collect()}
    got = [(r["stack_fall"], r["stack_none"], r["stack_rise"], *truth[r["issue_id"]]) for r in Q["m15_stacked_chances"](spark, DIR).collect() if r["issue_id"] in truth and r["stack_fall"] is not None]
    assert len(got) > 700 and all(sum(r[:3]) == pytest.approx(1) for r in got)
    assert np.mean([(p - y) ** 2 for p, _, _, y, _ in got]) < np.mean([(q - y) ** 2 for *_, y, q in got])


def test_log_linear_windows(spark):
    got = Q["m27_log_linear"](spark, DIR).collect()
    assert {r["step"] for r in got} == set(range(1, 7)) and all(np.isfinite(r["pred"]) for r in got if r["pred"] is not None) and sum(r["pred"] is not None for r in got) > 15_000


def test_sessions_are_named_whole_and_nearer_than_persistence(spark):
    got = {(r["issue_id"], r["session"]): r for r in Q["m26_session_regressor"](spark, DIR).collect()}
    assert {i for i, _ in got} == {r["issue_id"] for r in arrival_targets(spark, DIR).collect()}
    got = {k: r for k, r in got.items() if r["pred"] is not None}
    issue = {r["issue_id"]: r for r in arrival_targets(spark, DIR).collect()}
    levels = {(r["series"], r["label"]): r["med"] for r in fc.bk.closed_series(readings(spark, DIR)).collect()}
    assert len(got) > 5000
    ours, still = [], []
    for (i, session), r in got.items():
        end = issue[i]["issue_us"] // fc.B * fc.B + r["step"] * fc.B
        assert fc.SESSIONS[end % DAY // HOUR] == session
        if (issue[i]["series"], end) in levels:
            level = levels[issue[i]["series"], end]
            ours.append(abs(level - r["pred"]))
            still.append(abs(level - issue[i]["ref"]))
    assert len(ours) > 100 and np.mean(ours) < np.mean(still)


def test_isotonic_map_pools_adjacent_violators(spark):
    got = Q["m16_isotonic_quality"](spark, DIR).collect()
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    y = {r["doc_id"]: float(r["quality"]) for r in docs.join(labels, "doc_id").collect()}
    groups = {}
    for r in got:
        groups.setdefault(r["p"], []).append(y[r["doc_id"]])
    blocks = []
    for p in sorted(groups):
        blocks.append([sum(groups[p]), len(groups[p]), [p]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    want = {p: s / n for s, n, ps in blocks for p in ps}
    assert all(r["calibrated"] == pytest.approx(want[r["p"]], abs=1e-9) for r in got)


def test_separated_nearest_and_sample(spark):
    r = readings(spark, DIR).select("series", "us", "v", "obs_id").collect()
    got = {}
    for x in Q["l05_separated_nearest"](spark, DIR).collect():
        got.setdefault(x["series"], set()).add(x["us"])
    for s in {x["series"] for x in r}:
        chosen = []
        for _, us in sorted((abs(x["v"] - 50), x["us"]) for x in r if x["series"] == s):
            if len(chosen) < 5 and all(abs(us - c) >= 12 * HOUR for c in chosen):
                chosen.append(us)
        assert got[s] == set(chosen)
    from issuetime.plans.evidence import case_features

    cases, found = {}, {}
    for x in case_features(readings(spark, DIR)).dropna().collect():
        cases.setdefault(x["series"], []).append(x)
    for x in Q["l05_separated_cases"](spark, DIR).collect():
        found.setdefault(x["series"], {})[x["rank"]] = x["us"]
    for s, mine in cases.items():
        now = max(mine, key=lambda x: x["us"])
        chosen = []
        for _, us in sorted((sum((x[n] - now[n]) ** 2 for n in ("level", "change", "sin", "cos")), x["us"]) for x in mine if x["us"] <= now["us"] - DAY):
            if len(chosen) < 5 and all(abs(us - c) >= 12 * HOUR for c in chosen):
                chosen.append(us)
        assert [found[s][k] for k in sorted(found[s])] == chosen and len(chosen) == 5
    first, again = (sorted(map(str, Q["l11_hash_sample"](spark, DIR).collect())) for _ in range(2))
    assert first == again and 0 < len(first) < len(r)


def test_detector_equals_its_fold_over_batches(spark, tmp_path):
    r = readings(spark, DIR)
    source = r.select("series", F.timestamp_micros("us").alias("ts"), "obs_id", "v")
    for day in range(3):  # one file a batch, in the order of time
        source.where((F.expr(f"unix_micros(ts) div {10 * DAY}") == 1_704_067_200_000_000 // (10 * DAY) + day)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with detector.timer_states(spark):
        st.run_to_end(detector.detected(stream, 60.0, 6 * HOUR, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    for found, rows in ((spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(str(tmp_path / "in")).select("series", F.unix_micros("ts").alias("us"), "v")), (Q["t07_stream_detector"](spark, DIR), r)):
        found, rows = found.collect(), sorted(rows.select("series", "us", "v").collect(), key=lambda x: x["us"])
        by_series, want = {}, []
        for x in rows:
            by_series.setdefault(x["series"], []).append((x["us"], x["v"]))
        for s, values in by_series.items():
            want += [(s, us, round(fall, 6)) for us, fall in detector.steps(values, None, 60.0, 6 * HOUR)[0]]
        armed = sorted((s, -(-(us + 6 * HOUR) // 1000) * 1000) for s, us, _ in want if us + 6 * HOUR < rows[-1]["us"] - HOUR)
        assert sorted((x["series"], x["us"], round(x["fall"], 6)) for x in found if x["what"] == "fall") == sorted(want) and len(want) > 10
        assert sorted((x["series"], x["us"]) for x in found if x["what"] == "armed") == armed and len(armed) > 10


def test_late_rows_change_no_earlier_read(spark):
    """A row a delivery late is in the side table and not in the ledger; a repeated run of the stream adds nothing."""
    from issuetime.plans import streams
    from issuetime.sources.ingest import existing

    at = streams.work_dir(spark)
    stream = streams.deliveries(spark, DIR)
    for _ in range(2):
        detector.set_late_aside(stream, at, f"{at}/state", HOUR)
    ledger, late = (existing(spark, f"{at}/{p}") for p in ("ledger", "late"))
    newest = {r["batch"]: r["us"] for r in ledger.groupBy("batch").agg(F.max("us").alias("us")).collect()}
    assert ledger.count() + late.count() == readings(spark, DIR).count() and late.count() > 100
    for batch, low in ledger.groupBy("batch").agg(F.min("us")).collect():
        assert all(low > n - HOUR for b, n in newest.items() if b < batch)
    assert late.where(F.col("obs_id") % streams.WITHHELD != 0).count() == 0
