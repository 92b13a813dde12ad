import random

import pytest
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.operators import joins as jn
from issuetime.operators import learn as ln
from issuetime.operators import selection as sel
from issuetime.schemas import DAY, HOUR, SECOND, STANDARD, readings
from issuetime.streaming import buckets as st

B = STANDARD.bucket


def rows(spark, values):
    return spark.createDataFrame([("s", t, i, float(v)) for i, (t, v) in enumerate(values)], "series string, us bigint, obs_id bigint, v double")


def test_reading_on_a_label_ends_its_bucket(spark):
    got = {r["us"]: r["label"] for r in rows(spark, [(B, 1), (B + 1, 2), (0, 3)]).withColumn("label", bk.bucket_label(F.col("us"), B)).collect()}
    assert got == {B: B, B + 1: 2 * B, 0: 0}


@pytest.mark.parametrize(("clocks", "closed"), [((600, 3600, 6600), True), ((600, 6600), False), ((1921, 3600, 6600), False), ((600, 4441, 6600), False), ((600, 4440, 6600), True)])
def test_coverage_limits(spark, clocks, closed):
    data = rows(spark, [(t * SECOND, 5) for t in clocks])
    assert bk.closed_series(data).count() == int(closed)


def test_target_needs_every_touched_bucket(spark):
    buckets = spark.createDataFrame([("s", 6 * B, 10.0), ("s", 7 * B, 30.0)], "series string, label bigint, med double")
    issues = spark.createDataFrame([("s", 1, 0), ("s", 2, B // 4), ("s", 3, B + 1)], "series string, issue_id int, issue_us bigint")
    got = {r["issue_id"]: (r["target"], r["complete"]) for r in bk.point_target(issues, buckets, 6 * B, B).collect()}
    assert got == {1: (10.0, 6 * B), 2: (15.0, 7 * B), 3: (None, 8 * B)}


def test_asof_ties_and_strictness(spark):
    left = spark.createDataFrame([("s", 10), ("s", 5), ("t", 10)], "series string, at bigint")
    right = spark.createDataFrame([("s", 10, 1), ("s", 10, 2), ("s", 7, 9)], "series string, seen bigint, id int")
    pick = lambda **k: {(r["series"], r["at"]): r["right"] and r["right"]["id"] for r in jn.asof_join(left, right, "at", "seen", tie="id", **k).collect()}
    assert pick() == {("s", 10): 2, ("s", 5): None, ("t", 10): None}
    assert pick(strict=True)["s", 10] == 9


def test_later_receipts_change_nothing_earlier(spark):
    """Truncating the readings at the issue leaves every as-of feature the same."""
    r = readings(spark, "/root/testdata/sf0.001")
    issue = r.agg(F.percentile("us", 0.5)).first()[0]
    left = r.where(F.col("us") <= int(issue)).select("series", "obs_id", F.col("us").alias("at"))
    pick = lambda right: sorted((x["obs_id"], x["right"] and x["right"]["obs_id"]) for x in jn.asof_join(left, right.select("series", "obs_id", "visible_us"), "at", "visible_us", tie="obs_id").collect())
    assert pick(r) == pick(r.where(F.col("visible_us") <= int(issue)))


def test_spacing_limit(spark):
    got = sel.choose_spaced(rows(spark, [(0, 1), (HOUR - 1, 1), (HOUR, 1), (2 * HOUR, 1)]), "us", HOUR).select("us").collect()
    assert sorted(r["us"] for r in got) == [0, HOUR, 2 * HOUR]


def test_spacing_across_blocks_is_that_of_one_fold(spark):
    """Ends of uneven length over short blocks, some of them empty, in two keys; rows without clock are not chosen."""
    rng = random.Random(3)
    data = [(k, t, t + rng.choice([0, 1, 7, 40, 300])) for k in "ab" for t in sorted(rng.sample(range(-500, 4000), 900)) if not 1000 < t < 1400]
    want, free = [], {}
    for k, t, e in data:
        if t >= free.get(k, t):
            want.append((k, t))
            free[k] = e + 3
    df = spark.createDataFrame([*data, ("a", None, 5), (None, 7, 7)], "series string, us bigint, e bigint")
    for block, whole in ((50, 0), (1000, 0), (10**6, 0), (50, 1000)):
        got = sel.choose_spaced(df, "us", 3, end="e", block=block, whole=whole).select("series", "us").collect()
        assert sorted((r["series"], r["us"]) for r in got) == want


def test_training_spans_hold_the_days_that_the_rule_names(spark):
    c, rng = STANDARD, random.Random(5)
    data = [("s", i, t, t + rng.choice([0, HOUR, 3 * DAY, 20 * DAY]), rng.choice([1.0, None])) for i, t in enumerate(rng.sample(range(-5 * DAY, 5 * DAY, HOUR // 2), 150))]
    data += [("s", 900, 0, None, 1.0), ("s", 901, None, 0, 1.0), ("s", 902, DAY - c.embargo, 0, 1.0), ("s", 903, 2 * DAY - c.lookback, 0, 1.0)]
    got = ln.training_rows(spark.createDataFrame(data, "series string, id int, issue_us bigint, complete bigint, target double")).select("id", "day").collect()
    want = [(i, d) for _, i, t, done, y in data if None not in (t, done, y) for d in range(-10, 40) if d * DAY - c.lookback < t < d * DAY - c.embargo and done < d * DAY]
    assert sorted((r["id"], r["day"]) for r in got) == sorted(want)


def test_streamed_buckets_equal_batch(spark, tmp_path):
    source = readings(spark, "/root/testdata/sf0.01").select("series", F.timestamp_micros("us").alias("ts"), "obs_id", "v")
    source.repartitionByRange(6, "ts").write.parquet(str(tmp_path / "in"))
    stream = st.closed_buckets(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in")), "1 hour")
    st.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r["series"], r["label"]): r["med"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["series"], r["label"]): r["med"] for r in bk.closed_series(readings(spark, "/root/testdata/sf0.01")).collect()}
    last = max(k[1] for k in want) - 2 * B
    assert {k: v for k, v in got.items() if k[1] < last} == {k: v for k, v in want.items() if k[1] < last}


def test_trailing_stats_over_blocks_equal_plain_windows(spark):
    """Equal clocks, rows on the edges of blocks, negative clocks, missing values, a hot key and a single row."""
    from issuetime.operators.frames import trailing_stats

    rng, span = random.Random(9), 1000
    data = [("hot", rng.choice([t, t // 250 * 250]), rng.choice([None, 5.0, rng.uniform(-50, 50)])) for t in (rng.randint(-5000, 5000) for _ in range(700))] + [("b", 17, 3.0)]
    got = trailing_stats(spark.createDataFrame(data, "series string, us bigint, v double"), span).collect()
    assert len(got) == len(data)
    for r in got:
        near = [(t / 60e6, v) for s, t, v in data if s == r["series"] and r["us"] - span < t <= r["us"] and v is not None]
        values = [v for _, v in near]
        assert r["n"] == len(near) and (r["low"], r["high"]) == ((min(values), max(values)) if near else (None, None))
        if near:
            mean, at = sum(values) / len(near), sum(t for t, _ in near) / len(near)
            assert r["sd"] == pytest.approx((sum((v - mean) ** 2 for v in values) / len(near)) ** 0.5, abs=1e-6)
            spread = sum((t - at) ** 2 for t, _ in near)
            if spread * (60e6) ** 2 > 1:
                assert r["slope"] == pytest.approx(sum((t - at) * (v - mean) for t, v in near) / spread, rel=1e-4, abs=1e-2)


def test_spare_slots_split_the_largest_gaps(spark):
    """Against the same greedy rule over all rows, which is what few rows between kept ones come to; keys with too few rows stay short."""
    rng = random.Random(4)
    data = {"a": sorted(rng.sample(range(0, 30 * DAY, HOUR), 300)), "b": [0, HOUR, 3 * HOUR, 9 * HOUR], "c": [5]}
    chosen = {"a": data["a"][::60] + data["a"][-1:], "b": [0, 9 * HOUR], "c": [5]}
    frame = lambda d: spark.createDataFrame([(k, t) for k, ts in d.items() for t in ts], "series string, us bigint")
    got = {}
    for r in sel.fill_slots(frame(chosen), frame(data), 40, "us", "series", tries=100_000).collect():
        got.setdefault(r["series"], []).append(r["us"])
    for k, ts in data.items():
        held = sorted(chosen[k])
        while len(held) < 40:
            split = [(a - b, a, b) for a, b in zip(held, held[1:]) if any(a < t < b for t in ts)]
            if not split:
                break
            _, a, b = min(split)
            held = sorted([*held, min((t for t in ts if a < t < b), key=lambda t: (abs(2 * t - a - b), t))])
        assert sorted(got[k]) == held
    few = sel.fill_slots(frame(chosen), frame(data), 40, "us", "series", tries=8).where("series = 'a'").collect()
    assert len(few) == 40 and {r["us"] for r in few} <= set(data["a"])


def test_quantiles_by_ranges_are_interpolated(spark):
    from issuetime.operators.ranks import quantiles

    rng = random.Random(6)
    data = [("a", rng.choice([1.0, 2.0, rng.uniform(0, 9), None])) for _ in range(301)] + [("b", 5.0), ("c", None)]
    got = {r["series"]: (r["low"], r["mid"], r["high"]) for r in quantiles(spark.createDataFrame(data, "series string, v double"), "series", "v", {"low": 0.05, "mid": 0.5, "high": 1.0}, parts=7).collect()}
    values = sorted(v for k, v in data if k == "a" and v is not None)
    at = lambda q: values[int(q * (len(values) - 1))] + (q * (len(values) - 1) % 1) * (values[min(len(values) - 1, int(q * (len(values) - 1)) + 1)] - values[int(q * (len(values) - 1))])
    assert got["a"] == pytest.approx((at(0.05), at(0.5), at(1.0))) and got["b"] == (5.0, 5.0, 5.0) and "c" not in got


def test_sized_as_of_join_gives_the_same_rows_either_way(spark):
    rng = random.Random(8)
    left = spark.createDataFrame([("a" if i % 5 else "b", rng.randint(-100, 5000), i) for i in range(300)], "series string, t bigint, i int")
    right = spark.createDataFrame([("a" if i % 7 else "b", rng.randint(0, 4000) // 10 * 10, i) for i in range(400)], "series string, u bigint, k int")
    plain, blocks = (sorted((r["i"], r["right"] and (r["right"]["u"], r["right"]["k"])) for r in jn.asof_join_sized(left, right, "t", "u", 300, tie="k", whole=w).collect()) for w in (1000, 10))
    assert plain == blocks and len(plain) == 300 and any(x is None for _, x in plain)
