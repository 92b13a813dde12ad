"""Grids, cohorts, distributions from quantiles, display labels and evidence tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.operators import scores as sc
from issuetime.operators.weather import explode_grid
from issuetime.plans.scoring import EVENTS, SCORED, event_rows, scored
from issuetime.plans.targets import B, r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, MINUTE, issues, once, readings, receipts, run_hours, spread_by, table

GRID = """pts AS (SELECT s_suppkey AS run, i, j, CASE WHEN s_suppkey % 17 = 3 AND i = 1 AND j = 1 THEN 48 ELSE 49 END AS n FROM supplier, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)),
  grid AS (SELECT run, i, j, t, 20 + 5 * i + 3 * j + (run + t) % 7 AS pm FROM pts, (SELECT unnest(range(49)) AS t) WHERE run NOT IN (SELECT run FROM pts GROUP BY run HAVING min(n) <> max(n)))"""


#: Lattices that a task may build.
GRID_RUNS = 5_000


def grid(spark, sf_dir):
    """run, i (latitude), j (longitude), t, pm: one issued lattice per supplier, of whose runs a few hold a series that is too short."""
    run, axis = F.col("run"), F.sequence(F.lit(0), F.lit(2))
    hours = lambda i, j: F.sequence(F.lit(0), F.when((run % 17 == 3) & (i == 1) & (j == 1), 47).otherwise(48))
    point = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.transform(hours(i, j), lambda t: 20 + 5 * i + 3 * j + (run + t) % 7).alias("pm"))
    points = F.flatten(F.transform(axis, lambda i: F.transform(axis, lambda j: point(i, j))))
    # a run becomes 441 rows: runs are dealt to the tasks before, as few bytes of them would be read by one task
    dealt = spread_by(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run")), ["run"], GRID_RUNS)
    return explode_grid(dealt.select("run", once(points).alias("points")))


@query("s04_grid_runs", f"WITH {GRID} SELECT run, t, count(*) AS points, sum(pm)::BIGINT AS pm FROM grid GROUP BY run, t", inputs=False)
def grid_runs(spark, sf_dir):
    return grid(spark, sf_dir).groupBy("run", "t").agg(F.count(F.lit(1)).alias("points"), F.sum("pm").alias("pm"))


@query("a22_grid_gradient", f"WITH {GRID} SELECT run, t, round(avg(pm) FILTER (i > 1) - avg(pm) FILTER (i < 1), 6) AS north_south, round(avg(pm) FILTER (j > 1) - avg(pm) FILTER (j < 1), 6) AS east_west, round(avg(pm), 6) AS mean, max(pm) AS top FROM grid GROUP BY run, t", inputs=False)
def grid_gradient(spark, sf_dir):
    part = lambda c: F.avg(F.when(c, F.col("pm")))
    i, j = F.col("i"), F.col("j")
    return grid(spark, sf_dir).groupBy("run", "t").agg(r6(part(i > 1) - part(i < 1)).alias("north_south"), r6(part(j > 1) - part(j < 1)).alias("east_west"), r6(F.avg("pm")).alias("mean"), F.max("pm").alias("top"))


@query("f14_trilinear", f"""WITH {GRID}, q AS (SELECT event_id, user_id AS run, (event_id % 20) / 10.0::DOUBLE AS y, ((event_id * 7) % 20) / 10.0::DOUBLE AS x, (event_id * 3) % 48 + 0.25::DOUBLE AS h FROM events)
  SELECT q.event_id, round(sum(pm * (1 - abs(y - i)) * (1 - abs(x - j)) * (1 - abs(h - t))), 6) AS pm FROM q LEFT JOIN grid g ON g.run = q.run AND t IN (floor(h)::BIGINT, floor(h)::BIGINT + 1) AND abs(y - i) < 1 AND abs(x - j) < 1 GROUP BY q.event_id""", inputs=False)
def trilinear(spark, sf_dir):
    """Every event's point meets its (at most) eight corners by equal keys; null where its run has no lattice."""
    n = F.col("event_id")
    q = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"), (n % 20 / 10.0).alias("y"), (n * 7 % 20 / 10.0).alias("x"), (n * 3 % 48 + 0.25).alias("h"))
    corner = lambda c: F.explode(F.array(F.floor(c).cast("int"), F.floor(c).cast("int") + 1))
    corners = q.withColumn("i", corner("y")).withColumn("j", corner("x")).withColumn("t", corner("h"))
    weight = (1 - F.abs(F.col("y") - F.col("i"))) * (1 - F.abs(F.col("x") - F.col("j"))) * (1 - F.abs(F.col("h") - F.col("t")))
    corners = corners.withColumn("w", weight).where("w > 0")
    met = corners.join(grid(spark, sf_dir), ["run", "i", "j", "t"], "left")
    return met.groupBy("event_id").agg(r6(F.when(F.count("pm") == F.count(F.lit(1)), F.sum(F.col("pm") * F.col("w")))).alias("pm"))


#: Reports (one a station and hour) that are sent to every task.
REPORTS = 200_000


@query("j10_station_match", f""", names AS (SELECT series AS station, row_number() OVER (ORDER BY series) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT series FROM readings)),
  rep AS (SELECT series AS station, us - us % {HOUR} AS at, arg_max(20 + v % 15, (us, obs_id)) AS temp, arg_max(us - us % {HOUR} + k * 60000000, (us, obs_id)) AS seen FROM readings GROUP BY 1, 2)
  SELECT r.station, h.h, count(*) AS n, round(avg(h.temp - r.temp), 6) AS bias, round(avg(abs(h.temp - r.temp)), 6) AS mae FROM run_hours h JOIN names s ON s.i = h.run_id % s.c JOIN rep r ON r.at = h.valid AND r.station = s.station WHERE r.seen <= h.valid + {2 * HOUR} AND h.temp IS NOT NULL GROUP BY ALL""")
def station_match(spark, sf_dir):
    """Every run's hours against the newest report of its station in that hour, if seen within two hours: errors by station and lead."""
    r, last = readings(spark, sf_dir), F.struct("us", "obs_id")
    hour = F.col("us") - F.col("us") % HOUR
    rep = r.groupBy(F.col("series").alias("station"), hour.alias("valid")).agg(F.max_by(20 + F.col("v") % 15, last).alias("was"), F.max_by(hour + F.col("k") * MINUTE, last).alias("seen"))
    names = r.select(F.col("series").alias("station")).distinct().withColumn("i", (F.row_number().over(Window.orderBy("station")) - 1).cast("long"))  # a row a station
    hours = run_hours(spark, sf_dir).where("temp is not null").withColumn("i", F.col("run_id") % max(names.count(), 1))  # one number
    rep = rep.join(F.broadcast(names), "station").where(F.col("seen") <= F.col("valid") + 2 * HOUR)
    rep = F.broadcast(rep) if rep.count() <= REPORTS else rep  # counted first: few reports go to the hours, many meet them by a sort
    met = hours.join(rep, ["i", "valid"])
    error = F.col("temp") - F.col("was")
    return met.groupBy("station", F.col("h").cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(error)).alias("bias"), r6(F.avg(F.abs(error))).alias("mae"))


STATIONS = """, names AS (SELECT series, 3.0::DOUBLE + 0.05 * i AS lat, 101.5::DOUBLE + 0.07 * ((i * 3) % 5) AS lon FROM (SELECT series, row_number() OVER (ORDER BY series) - 1 AS i FROM (SELECT DISTINCT series FROM readings))),
  near AS (SELECT a.series, b.series AS station, (b.lon - a.lon) * 111.32 * cos(radians(3.0::DOUBLE)) AS east, (b.lat - a.lat) * 110.57 AS north FROM names a JOIN names b ON a.series <> b.series),
  st AS (SELECT series, station, sqrt(east * east + north * north) AS km, east / sqrt(east * east + north * north) AS ue, north / sqrt(east * east + north * north) AS un FROM near)"""


def station_pairs(spark, sf_dir):
    """series, station, km and unit vector (ue, un) towards it, of each two stations: the fixed handful of series names."""
    place = readings(spark, sf_dir).select("series").distinct().withColumn("i", F.row_number().over(Window.orderBy("series")) - 1)
    place = place.select("series", (3.0 + 0.05 * F.col("i")).alias("lat"), (101.5 + 0.07 * (F.col("i") * 3 % 5)).alias("lon"))
    other = place.toDF("station", "lat2", "lon2")
    east, north = (F.col("lon2") - F.col("lon")) * 111.32 * F.cos(F.radians(F.lit(3.0))), (F.col("lat2") - F.col("lat")) * 110.57
    km = F.sqrt(east * east + north * north)
    return place.join(other, F.col("series") != F.col("station")).select("series", "station", km.alias("km"), F.try_divide(east, km).alias("ue"), F.try_divide(north, km).alias("un"))


@query("j15_stations", f"{STATIONS} SELECT issue_id, station, round(km, 6) AS km, round(ue, 6) AS ue, round(un, 6) AS un FROM issues JOIN st USING (series)")
def stations(spark, sf_dir):
    """Every issue with each neighbour of its station: distance and unit vector."""
    return issues(spark, sf_dir).join(station_pairs(spark, sf_dir), "series").select("issue_id", "station", *(r6(c).alias(c) for c in ("km", "ue", "un")))


@query("p10_common_rows", f"{SCORED} SELECT issue_id FROM scored WHERE target IS NOT NULL AND pred IS NOT NULL AND ref > 5")
def common_rows(spark, sf_dir):
    return scored(spark, sf_dir).dropna(subset=["target", "pred", "ref"]).where("ref > 5").select("issue_id")


@query("p04_finite", " SELECT obs_id, CASE WHEN obs_id % 5 = 0 THEN NULL ELSE v END AS v FROM readings")
def finite_values(spark, sf_dir):
    from issuetime.sources.ingest import finite

    spoiled = F.when(F.col("obs_id") % 10 == 0, float("nan")).when(F.col("obs_id") % 5 == 0, float("inf")).otherwise(F.col("v"))
    return readings(spark, sf_dir).select("obs_id", finite(spoiled).alias("v"))


@query("u01_receipts_and_rows", " SELECT obs_id, receipt_id FROM receipts UNION ALL SELECT obs_id, NULL FROM readings WHERE obs_id % 13 = 0")
def receipts_and_rows(spark, sf_dir):
    return receipts(spark, sf_dir).select("obs_id", "receipt_id").unionByName(readings(spark, sf_dir).where("obs_id % 13 = 0").select("obs_id"), allowMissingColumns=True)


@query("f09_directions", f"{EVENTS} SELECT issue_id, truth::BIGINT AS truth, said::BIGINT AS said FROM ev")
def directions(spark, sf_dir):
    return event_rows(spark, sf_dir).select("issue_id", F.col("truth").cast("long").alias("truth"), F.col("said").cast("long").alias("said"))


@query("f16_cdf_from_quantiles", " SELECT obs_id, round(CASE WHEN v <= 20 THEN 0.1 * exp((v - 20) / 10) WHEN v <= 40 THEN 0.1 + (v - 20) / 20 * 0.4 WHEN v <= 80 THEN 0.5 + (v - 40) / 40 * 0.4 ELSE 1 - 0.1 * exp(-(v - 80) / 10) END, 6) AS p FROM readings")
def cdf_from_quantiles(spark, sf_dir):
    from issuetime.functions.probability import cdf

    return readings(spark, sf_dir).select("obs_id", r6(cdf(F.col("v"), (20.0, 40.0, 80.0), (0.1, 0.5, 0.9), 10.0)).alias("p"))


@query("f17_class_masses", " SELECT obs_id, round(c1, 6) AS m0, round(c2 - c1, 6) AS m1, round(1 - c2, 6) AS m2 FROM (SELECT obs_id, CASE WHEN v < 60 THEN 0.2 ELSE 0.1 END::DOUBLE AS c1, CASE WHEN v < 60 THEN 0.9 ELSE 0.7 END::DOUBLE AS c2 FROM readings)")
def class_masses(spark, sf_dir):
    from issuetime.functions.probability import masses

    low = F.col("v") < 60
    m = masses([F.when(low, 0.2).otherwise(0.1), F.when(low, 0.9).otherwise(0.7)])
    return readings(spark, sf_dir).select("obs_id", *(r6(x).alias(f"m{i}") for i, x in enumerate(m)))


@query("f18_nested_tails", " SELECT issue_id, round(p_fall, 6) AS fall, round(p_fall * 0.4, 6) AS big_fall, round(p_rise * 0.25, 6) AS big_rise FROM issues")
def nested_tails(spark, sf_dir):
    from issuetime.functions.probability import tails

    p = [F.col("p_fall") * 0.4, F.col("p_fall") * 0.6, F.col("p_none"), F.col("p_rise") * 0.75, F.col("p_rise") * 0.25]
    big_fall, fall, _, big_rise = tails(p)
    return issues(spark, sf_dir).select("issue_id", r6(fall).alias("fall"), r6(big_fall).alias("big_fall"), r6(big_rise).alias("big_rise"))


@query("f22_display_labels", f"{EVENTS} SELECT issue_id, CASE WHEN said < 0 THEN 'Likely clearer by ' || round(-call)::BIGINT WHEN said > 0 THEN 'Likely worse by ' || round(call)::BIGINT ELSE 'Little change' END AS label FROM ev")
def display_labels(spark, sf_dir):
    n = lambda c: F.round(c).cast("long").cast("string")
    label = F.when(F.col("said") < 0, F.concat(F.lit("Likely clearer by "), n(-F.col("call")))).when(F.col("said") > 0, F.concat(F.lit("Likely worse by "), n(F.col("call")))).otherwise("Little change")
    return event_rows(spark, sf_dir).select("issue_id", label.alias("label"))


@query("f25_particle_mix", " SELECT obs_id, round(greatest(k - v, 0), 6) AS coarse, round(CASE WHEN k <> 0 THEN least(greatest(100 * v / k, 0), 100) END, 6) AS fine_share FROM readings")
def particle_mix(spark, sf_dir):
    v, k = F.col("v"), F.col("k")
    return readings(spark, sf_dir).select("obs_id", r6(F.greatest(k - v, F.lit(0.0))).alias("coarse"), r6(F.when(k != 0, F.least(F.greatest(F.try_divide(100 * v, k), F.lit(0.0)), F.lit(100.0)))).alias("fine_share"))


@query("a45_manifest", f" , x AS (SELECT r.series, r.us // {DAY} AS day, r.obs_id, x.receipt_id FROM readings r LEFT JOIN receipts x USING (obs_id)), d AS (SELECT series, day, count(*) AS n, count(receipt_id) AS known, max(receipt_id) AS last, sha256(string_agg(obs_id || ':' || coalesce(receipt_id, -1), ',' ORDER BY obs_id, receipt_id)) AS digest FROM x GROUP BY ALL) SELECT series, sum(n)::BIGINT AS n, sum(known)::BIGINT AS known, max(last) AS last, sha256(string_agg(digest, ',' ORDER BY day)) AS digest FROM d GROUP BY series")
def manifest(spark, sf_dir):
    """Digests of each day's inputs, and the digest of these per series: no more than a day's rows are ever gathered."""
    rows = readings(spark, sf_dir).select("series", F.expr(f"us div {DAY}").alias("day"), "obs_id").join(receipts(spark, sf_dir).select("obs_id", "receipt_id"), "obs_id", "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("obs_id", F.coalesce("receipt_id", F.lit(-1)).alias("r")))), lambda x: F.concat_ws(":", x["obs_id"], x["r"])), ",")
    days = rows.groupBy("series", "day").agg(F.count(F.lit(1)).alias("n"), F.count("receipt_id").alias("known"), F.max("receipt_id").alias("last"), F.sha2(text, 256).alias("digest"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "digest"))), lambda x: x["digest"]), ",")
    return days.groupBy("series").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.max("last").alias("last"), F.sha2(whole, 256).alias("digest"))


@query("a47_pair_decisions", f""", d AS (SELECT series, (label - 1) // {DAY} AS day, avg(med) FILTER ((label - 1) % {DAY} < {12 * HOUR}) AS am, avg(med) FILTER ((label - 1) % {DAY} >= {12 * HOUR}) AS pm FROM closed GROUP BY ALL), c AS (SELECT *, abs(am - pm) >= greatest(5, 0.1 * least(am, pm)) AS call FROM d WHERE am IS NOT NULL AND pm IS NOT NULL)
  SELECT series, count(*) AS days, count(*) FILTER (call) AS calls, count(*) FILTER (call AND am < pm) AS mornings FROM c GROUP BY series""")
def pair_decisions(spark, sf_dir):
    half = (F.col("label") - 1) % DAY < 12 * HOUR
    d = bk.closed_series(readings(spark, sf_dir)).groupBy("series", F.expr(f"(label - 1) div {DAY}").alias("day")).agg(F.avg(F.when(half, F.col("med"))).alias("am"), F.avg(F.when(~half, F.col("med"))).alias("pm"))
    call = F.abs(F.col("am") - F.col("pm")) >= F.greatest(F.lit(5.0), 0.1 * F.least("am", "pm"))
    return d.dropna().groupBy("series").agg(F.count(F.lit(1)).alias("days"), F.count_if(call).alias("calls"), F.count_if(call & (F.col("am") < F.col("pm"))).alias("mornings"))


@query("e16_case_table", f"""{EVENTS}, f AS (SELECT *, CASE WHEN issue_us - lag(issue_us) OVER w > {4 * HOUR} OR truth <> lag(truth) OVER w THEN 1 ELSE 0 END AS j FROM ev WHERE truth <> 0 WINDOW w AS (PARTITION BY series ORDER BY issue_us)), g AS (SELECT *, sum(j) OVER (PARTITION BY series ORDER BY issue_us) AS g FROM f)
  SELECT series, min(issue_us) AS onset, round(max(abs(d)), 6) AS peak, arg_min(round(pred, 6), issue_us) AS first_pred, min(issue_us) FILTER (said = truth) AS first_hit FROM g GROUP BY series, g HAVING max(abs(d)) >= 40""")
def case_table(spark, sf_dir):
    g = sc.islands(event_rows(spark, sf_dir).where("truth <> 0"), 4 * HOUR, "issue_us", "series", "truth")
    hit = F.min(F.when(F.col("said") == F.col("truth"), F.col("issue_us")))
    out = g.groupBy("series", "island").agg(F.min("issue_us").alias("onset"), F.max(F.abs("d")).alias("top"), F.min_by(r6("pred"), "issue_us").alias("first_pred"), hit.alias("first_hit"))
    return out.where("top >= 40").select("series", "onset", r6("top").alias("peak"), "first_pred", "first_hit")


@query("v01_as_issued_backtest", f""", hit AS (SELECT * FROM issues QUALIFY row_number() OVER (PARTITION BY series, version, issue_us // {DAY} ORDER BY abs(issue_us % {DAY} - {12 * HOUR}), issue_us, issue_id) = 1),
  t AS (SELECT h.*, (issue_us + {12 * HOUR}) // {B} * {B} AS lo, ((issue_us + {12 * HOUR}) % {B}) / {B}::DOUBLE AS share FROM hit h),
  y AS (SELECT t.*, CASE WHEN share > 0 THEN a.med * (1 - share) + b.med * share ELSE a.med END AS target FROM t LEFT JOIN closed a ON a.series = t.series AND a.label = lo LEFT JOIN closed b ON b.series = t.series AND b.label = lo + {B})
  SELECT series, version, count(*) AS issued, count(target) AS scored, round(avg(abs(pred - target)), 6) AS mae, round(avg(abs(ref - target)), 6) AS ref_mae FROM y GROUP BY series, version""")
def as_issued_backtest(spark, sf_dir):
    """One issue a day nearest to noon, scored against covered buckets only."""
    from issuetime.operators.selection import first_by

    day = issues(spark, sf_dir).withColumn("day", F.expr(f"issue_us div {DAY}"))
    chosen = first_by(day, ["series", "version", "day"], F.abs(F.col("issue_us") % DAY - 12 * HOUR), "issue_us", "issue_id")
    y = bk.point_target(chosen, bk.closed_series(readings(spark, sf_dir)), 12 * HOUR, B)
    return y.groupBy("series", "version").agg(F.count(F.lit(1)).alias("issued"), F.count("target").alias("scored"), r6(F.avg(F.abs(F.col("pred") - F.col("target")))).alias("mae"), r6(F.avg(F.abs(F.col("ref") - F.col("target")))).alias("ref_mae"))


@query("v14_prespecified", f"{SCORED}, c AS (SELECT k / 100.0::DOUBLE AS tau, count(*) FILTER (day < 19737 AND d > -20 AND p_fall >= k / 100.0::DOUBLE) AS f FROM scored CROSS JOIN (SELECT unnest(range(0, 34)) AS k) GROUP BY k), b AS (SELECT min(tau) AS tau FROM c WHERE f <= 10) SELECT b.tau, count(*) FILTER (d <= -20 AND p_fall >= b.tau) AS caught, count(*) FILTER (d > -20 AND p_fall >= b.tau) AS false_calls FROM scored CROSS JOIN b WHERE day >= 19737 GROUP BY b.tau")
def prespecified(spark, sf_dir):
    """The least threshold with at most ten false calls before the split, applied after it."""
    rows = scored(spark, sf_dir)
    before = rows.where("day < 19737").select((F.floor(F.col("p_fall") * 100 + 1e-9)).alias("k"), (F.col("d") > -20).cast("int").alias("wrong")).groupBy("k").agg(F.sum("wrong").alias("wrong"))
    taus = spark.range(34).withColumnRenamed("id", "tau_k")
    curve = taus.join(F.broadcast(before), F.col("k") >= F.col("tau_k"), "left").groupBy("tau_k").agg(F.coalesce(F.sum("wrong"), F.lit(0)).alias("f"))  # at most 34 rows each
    tau = curve.where("f <= 10").agg((F.min("tau_k") / 100).alias("tau"))
    said = F.col("p_fall") >= F.col("tau")
    return rows.where("day >= 19737").join(F.broadcast(tau)).groupBy("tau").agg(F.count_if((F.col("d") <= -20) & said).alias("caught"), F.count_if((F.col("d") > -20) & said).alias("false_calls"))
