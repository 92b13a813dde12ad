"""Aggregates over readings, reference tables and stations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.operators import scores as sc
from issuetime.operators.ranks import average_ranks, quantiles, ranked
from issuetime.plans.targets import B, r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, MINUTE, readings, table


@query("a07_collection_summary", f", g AS (SELECT *, us - lag(us) OVER (PARTITION BY series ORDER BY us) AS gap FROM readings) SELECT series, count(DISTINCT us) AS clocks, count(*) FILTER (gap > {HOUR}) AS gaps, max(gap) AS longest, max(us) AS latest FROM g GROUP BY series")
def collection_summary(spark, sf_dir):
    g = readings(spark, sf_dir).withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy("series").orderBy("us")))
    return g.groupBy("series").agg(F.count_distinct("us").alias("clocks"), F.count_if(F.col("gap") > HOUR).alias("gaps"), F.max("gap").alias("longest"), F.max("us").alias("latest"))


@query("a08_statistics", " SELECT series, min(v) AS low, max(v) AS high, round(avg(v), 5) AS mean, round(median(v), 6) AS med, arg_min(v, (us, obs_id)) AS first, arg_max(v, (us, obs_id)) AS last FROM readings GROUP BY series")
def statistics(spark, sf_dir):
    order = F.struct("us", "obs_id")
    return readings(spark, sf_dir).groupBy("series").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 5).alias("mean"), r6(F.median("v")).alias("med"), F.min_by("v", order).alias("first"), F.max_by("v", order).alias("last"))


@query("a09_day_summary", f""", d AS (SELECT series, label, med, (label - 1) // {DAY} AS day FROM closed), w AS (SELECT *, count(*) OVER x AS n3, avg(med) OVER x AS worst FROM d WINDOW x AS (PARTITION BY series, day ORDER BY label RANGE BETWEEN {2 * B} PRECEDING AND CURRENT ROW))
  SELECT series, day, count(*) AS n, round(avg(med), 7) AS mean, round(max(CASE WHEN n3 = 3 THEN worst END), 7) AS worst FROM w GROUP BY series, day HAVING count(*) >= 6""")
def day_summary(spark, sf_dir):
    d = bk.closed_series(readings(spark, sf_dir)).withColumn("day", F.expr(f"(label - 1) div {DAY}"))
    three = Window.partitionBy("series", "day").orderBy("label").rangeBetween(-2 * B, 0)
    d = d.withColumn("worst", F.when(F.count("med").over(three) == 3, F.avg("med").over(three)))
    return d.groupBy("series", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("med"), 7).alias("mean"), F.round(F.max("worst"), 7).alias("worst")).where("n >= 6")


@query("a11_weighted_quantiles", ", c AS (SELECT series, v, sum(k) OVER (PARTITION BY series ORDER BY v) AS c, sum(k) OVER (PARTITION BY series) AS t FROM readings WHERE k > 0) SELECT series, min(v) FILTER (c >= 0.25 * t) AS q25, min(v) FILTER (c >= 0.5 * t) AS q50, min(v) FILTER (c >= 0.9 * t) AS q90 FROM c GROUP BY series")
def weighted_quantiles(spark, sf_dir):
    r = readings(spark, sf_dir)
    # rows of one value are one weight, so that a value is reached as a whole
    r = r.groupBy("series", "v").agg(F.sum("k").alias("k"))
    out = [sc.weighted_quantile(r, ["series"], "v", "k", q, f"q{int(100 * q)}") for q in (0.25, 0.5, 0.9)]
    return out[0].join(out[1], "series").join(out[2], "series")


@query("a10_decayed_baseline", f", d AS (SELECT series, v, pow(0.5::DOUBLE, (max(us // {DAY}) OVER (PARTITION BY series) - us // {DAY}) / 7.0::DOUBLE) AS w FROM readings), e AS (SELECT series, v, sum(w) AS w FROM d GROUP BY ALL), c AS (SELECT series, v, sum(w) OVER (PARTITION BY series ORDER BY v) AS c, sum(w) OVER (PARTITION BY series) AS t FROM e) SELECT series, min(v) FILTER (c >= 0.5 * t) AS med FROM c GROUP BY series")
def decayed_baseline(spark, sf_dir):
    day = F.expr(f"us div {DAY}")
    age = F.max(day).over(Window.partitionBy("series")) - day
    r = readings(spark, sf_dir).withColumn("w", F.pow(F.lit(0.5), age / 7.0)).groupBy("series", "v").agg(F.sum("w").alias("w"))
    return sc.weighted_quantile(r, ["series"], "v", "w", 0.5, "med")


@query("a12_interpolated_quantiles", " SELECT series, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS q{int(100 * q)}" for q in (0.05, 0.5, 0.95)) + " FROM readings GROUP BY series")
def interpolated_quantiles(spark, sf_dir):
    found = quantiles(readings(spark, sf_dir), "series", "v", {f"q{int(100 * q)}": q for q in (0.05, 0.5, 0.95)})
    return found.select("series", *(r6(c).alias(c) for c in found.columns[1:]))


@query("a13_conservative_quantile", ", r AS (SELECT series, v, row_number() OVER (PARTITION BY series ORDER BY v) AS i, count(*) OVER (PARTITION BY series) AS n FROM readings) SELECT series, max(v) FILTER (i = least(n, ceil((n + 1) * 0.9::DOUBLE))) AS upper, round(max(least(n, ceil((n + 1) * 0.9::DOUBLE)) / (n + 1)), 6) AS covers FROM r GROUP BY series")
def conservative_quantile(spark, sf_dir):
    rank = F.least(F.col("total").cast("double"), F.ceil((F.col("total") + 1) * 0.9).cast("double"))
    r = ranked(readings(spark, sf_dir).select("series", "v"), "series", "v")
    return r.groupBy("series").agg(F.max(F.when(F.col("place") == rank, F.col("v"))).alias("upper"), r6(F.max(rank / (F.col("total") + 1))).alias("covers"))


@query("a14_wilson_bound", "SELECT lang, n::BIGINT AS n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lower FROM (SELECT lang, avg(quality) AS p, count(*)::DOUBLE AS n, 1.96::DOUBLE AS z FROM documents JOIN labels USING (doc_id) GROUP BY lang)", inputs=False)
def wilson_bound(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    good = rows.groupBy("lang").agg(F.sum("quality").alias("hits"), F.count(F.lit(1)).alias("m"))
    return good.select("lang", F.col("m").alias("n"), r6(sc.wilson_lower(F.col("hits"), F.col("m"))).alias("lower"))


@query("a20_network_medians", f", s AS (SELECT label, series, med FROM closed), m AS (SELECT label, median(med) AS m, min(med) AS low, max(med) AS high, count(*) AS n FROM s GROUP BY label) SELECT m.label, round(max(m), 6) AS med, max(low) AS low, max(high) AS high, max(n) AS n, round(median(abs(s.med - m)), 6) AS mad FROM m JOIN s USING (label) GROUP BY m.label")
def network_medians(spark, sf_dir):
    s = bk.closed_series(readings(spark, sf_dir)).select("label", "med")
    m = s.groupBy("label").agg(F.median("med").alias("m"), F.min("med").alias("low"), F.max("med").alias("high"), F.count(F.lit(1)).alias("n"))
    mad = s.join(m, "label").groupBy("label").agg(r6(F.median(F.abs(F.col("med") - F.col("m")))).alias("mad"))
    return m.join(mad, "label").select("label", r6("m").alias("med"), "low", "high", "n", "mad")


@query("a23_spearman", "WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem) SELECT g, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY g", inputs=False)
def spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    pairs = rows.groupBy("g", "q", "p").agg(F.count(F.lit(1)).alias("c"))
    apart = F.col("average") - (F.col("total") + 1) / 2  # from the mean place, which ties leave as it is

    def places(value: str, name: str):
        return average_ranks(pairs.groupBy("g", value).agg(F.sum("c").alias("c")), "g", value, "c").select(F.col("g").alias(f"g_{name}"), F.col(value).alias(f"{value}_{name}"), apart.alias(name))

    met = pairs.join(places("q", "x"), (F.col("g") == F.col("g_x")) & F.col("q").eqNullSafe(F.col("q_x"))).join(places("p", "y"), (F.col("g") == F.col("g_y")) & F.col("p").eqNullSafe(F.col("p_y")))
    total = lambda a, b: F.sum(F.col("c") * F.col(a) * F.col(b))
    rho = F.coalesce(F.try_divide(total("x", "y"), F.sqrt(total("x", "x")) * F.sqrt(total("y", "y"))), F.lit(float("nan")))
    return met.groupBy("g").agg(F.sum("c").alias("n"), r6(rho).alias("rho"))


@query("a43_effective_n", " SELECT series, round(pow(sum(k), 2) / sum(k * k), 6) AS effective FROM readings GROUP BY series")
def effective_n(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("series").agg(r6(F.pow(F.sum("k"), 2) / F.sum(F.col("k") * F.col("k"))).alias("effective"))


@query("a48_decayed_bias", f""", e AS (SELECT a.series, a.label, a.med - b.med AS r FROM closed a JOIN closed b ON a.series = b.series AND b.label = a.label - {B}), d AS (SELECT series, max(label) AS now FROM closed GROUP BY series)
  SELECT series, round(sum(r * exp(-ln(2) * (now - label) / {12 * HOUR}::DOUBLE)) / sum(exp(-ln(2) * (now - label) / {12 * HOUR}::DOUBLE)), 6) AS bias FROM e JOIN d USING (series) WHERE label > now - {3 * DAY} GROUP BY series""")
def decayed_bias(spark, sf_dir):
    e = bk.at_offset(bk.closed_series(readings(spark, sf_dir)), -1, B, "b").withColumn("now", F.max("label").over(Window.partitionBy("series"))).where(F.col("b").isNotNull() & (F.col("label") > F.col("now") - 3 * DAY))
    w = F.exp(-F.log(F.lit(2.0)) * (F.col("now") - F.col("label")) / (12 * HOUR))
    return e.groupBy("series").agg(r6(F.sum((F.col("med") - F.col("b")) * w) / F.sum(w)).alias("bias"))


@query("f04_local_clock", f" SELECT obs_id, ((us + {8 * HOUR}) % {DAY}) // {HOUR} AS hour, ((us + {8 * HOUR}) % {DAY}) // {MINUTE} AS minute, (us + {8 * HOUR}) // {DAY} AS day, ((us + {8 * HOUR}) // {DAY} + 3) % 7 AS weekday, ((us + {8 * HOUR}) // {DAY} + 3) % 7 >= 5 AS weekend FROM readings")
def local_clock(spark, sf_dir):
    from issuetime.functions.clock import local_fields

    return readings(spark, sf_dir).select("obs_id", *local_fields(F.col("us")))


@query("f05_cyclic", f" SELECT obs_id, round(sin(2 * pi() * (us % {DAY}) / {DAY}::DOUBLE), 6) AS s, round(cos(2 * pi() * (us % {DAY}) / {DAY}::DOUBLE), 6) AS c FROM readings")
def cyclic_clock(spark, sf_dir):
    from issuetime.functions.clock import cyclic

    s, c = cyclic(F.col("us"), DAY)
    return readings(spark, sf_dir).select("obs_id", r6(s).alias("s"), r6(c).alias("c"))


@query("f06_next_session", f" SELECT obs_id, list_min(list_filter([us // {DAY} * {DAY} + {9 * HOUR}, us // {DAY} * {DAY} + {14 * HOUR}, us // {DAY} * {DAY} + {33 * HOUR}], lambda x: x >= us + {90 * MINUTE})) AS start FROM readings")
def next_session(spark, sf_dir):
    from issuetime.functions.clock import next_session_start

    return readings(spark, sf_dir).select("obs_id", next_session_start(F.col("us"), (9, 14), 90 * MINUTE).alias("start"))


LEVELS = """ SELECT obs_id, round(greatest(CASE WHEN v = 0 THEN 0 WHEN v < 30 THEN 0.524 * v - 0.0862 * rh + 5.75 WHEN v < 50 THEN (0.786 * (v / 20 - 1.5) + 0.524 * (1 - (v / 20 - 1.5))) * v - 0.0862 * rh + 5.75
  WHEN v < 210 THEN 0.786 * v - 0.0862 * rh + 5.75 WHEN v < 260 THEN (0.69 * s + 0.786 * (1 - s)) * v - 0.0862 * rh * (1 - s) + 2.966 * s + 5.75 * (1 - s) ELSE 2.966 + 0.69 * v + 8.84e-4 * v * v END, 0), 5) AS c
  FROM (SELECT obs_id, v, 40 + k / 2.0::DOUBLE AS rh, v / 50 - 21 / 5.0::DOUBLE AS s FROM readings)"""


@query("f10_all_levels", LEVELS)
def corrected_level(spark, sf_dir):
    from issuetime.functions.clock import corrected_everywhere

    return readings(spark, sf_dir).select("obs_id", F.round(corrected_everywhere(F.col("v"), 40 + F.col("k") / 2), 5).alias("c"))


@query("f12_geo_offset", f" SELECT event_id, round((lon - 101.5) * 111.32 * cos(radians(3.0)), 5) AS east, round((lat - 3.0) * 110.57, 5) AS north FROM (SELECT event_id, 3.0::DOUBLE + (event_id % 200 - 100) / 100.0::DOUBLE AS lat, 101.5::DOUBLE + ((event_id * 7) % 200 - 100) / 100.0::DOUBLE AS lon FROM events)")
def geo_offset(spark, sf_dir):
    e = F.col("event_id")
    lat, lon = 3.0 + (e % 200 - 100) / 100.0, 101.5 + (e * 7 % 200 - 100) / 100.0
    east, north = (lon - 101.5) * 111.32 * F.cos(F.radians(F.lit(3.0))), (lat - 3.0) * 110.57
    return table(spark, sf_dir, "events").select("event_id", F.round(east, 5).alias("east"), F.round(north, 5).alias("north"))


@query("f21_text_flags", "SELECT doc_id, regexp_matches(upper(text), 'RAIN|SHOWER|THUNDER') AS wet, regexp_matches(upper(text), 'HAZE|SMOKE') AS haze FROM documents", inputs=False)
def text_flags(spark, sf_dir):
    t = F.upper("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike("RAIN|SHOWER|THUNDER").alias("wet"), t.rlike("HAZE|SMOKE").alias("haze"))


@query("f23_payload_hash", " SELECT obs_id, sha256(series || '|' || us || '|' || k) AS digest FROM readings")
def payload_hash(spark, sf_dir):
    return readings(spark, sf_dir).select("obs_id", F.sha2(F.concat_ws("|", "series", "us", "k"), 256).alias("digest"))


@query("f24_masked_keys", r"SELECT doc_id, length(regexp_replace(text, '[0-9a-f]{32,}', '***', 'g')) AS n, md5(regexp_replace(text, '[0-9a-f]{32,}', '***', 'g')) AS digest FROM documents", inputs=False)
def masked_keys(spark, sf_dir):
    masked = F.regexp_replace("text", "[0-9a-f]{32,}", "***")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(masked).cast("long").alias("n"), F.md5(masked).alias("digest"))


@query("f15_log_ratio", " SELECT obs_id, round(ln((v + 5) / (k + 5)), 6) AS z, round(exp(ln((v + 5) / (k + 5))) * (k + 5) - 5, 6) AS back FROM readings")
def log_ratio(spark, sf_dir):
    z = F.log((F.col("v") + 5) / (F.col("k") + 5))
    return readings(spark, sf_dir).select("obs_id", r6(z).alias("z"), r6(F.exp(z) * (F.col("k") + 5) - 5).alias("back"))
