"""Sampling, thinning, nearest cases and canonical clocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuetime.operators import frames as fr
from issuetime.operators import selection as sel
from issuetime.plans.targets import r6
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, MINUTE, issues, readings, table


@query("l01_spaced", f""", c AS (SELECT series, us FROM readings), s AS (SELECT series, min(us) AS us FROM c GROUP BY series UNION ALL SELECT s.series, (SELECT min(c.us) FROM c WHERE c.series = s.series AND c.us >= s.us + {6 * HOUR}) FROM s WHERE s.us IS NOT NULL) SELECT series, us FROM s WHERE us IS NOT NULL""", recursive=True)
def spaced(spark, sf_dir):
    return sel.choose_spaced(readings(spark, sf_dir), "us", 6 * HOUR).select("series", "us")


@query("l02_nonoverlapping", f""", c AS (SELECT series, us, us + (k % 5 + 1) * {HOUR} AS e FROM readings), s AS (SELECT * FROM (SELECT series, min(us) AS us, arg_min(e, us) AS e FROM c GROUP BY series) UNION ALL SELECT n.series, n.us, n.e FROM (SELECT s.series, (SELECT min(c.us) FROM c WHERE c.series = s.series AND c.us >= s.e + 1) AS u FROM s) q JOIN c n ON n.series = q.series AND n.us = q.u) SELECT series, us, e FROM s""", recursive=True)
def nonoverlapping(spark, sf_dir):
    rows = readings(spark, sf_dir).select("series", "us", (F.col("us") + (F.col("k") % 5 + 1) * HOUR).alias("e"))
    return sel.choose_spaced(rows, "us", 1, end="e")


@query("l04_first_per_slot", f" SELECT series, version, recorded_us // {4 * HOUR} AS slot, arg_min(issue_id, (recorded_us, issue_id)) AS issue_id FROM issues GROUP BY ALL")
def first_per_slot(spark, sf_dir):
    rows = issues(spark, sf_dir).withColumn("slot", F.expr(f"recorded_us div {4 * HOUR}"))
    return sel.first_by(rows, ["series", "version", "slot"], "recorded_us", "issue_id").select("series", "version", "slot", "issue_id")


NEAR = """WITH e AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY i),
  z AS (SELECT vec_id, list((v - m) / s * CASE WHEN i <= 32 THEN 1.0 ELSE 0.5 END ORDER BY i) AS x FROM e JOIN st USING (i) GROUP BY vec_id),
  d AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: pow(q.x[i] - e.x[i], 2))) AS d FROM z q JOIN z e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d)"""


def standardised(spark, sf_dir):
    """Vectors with each column standardised over all rows; the second half of the columns is a block of half weight."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    st = e.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()  # one row per column
    scales = F.array(*(F.struct(F.lit(r["m"]).alias("m"), F.lit((r["s"] or 1.0) / (1.0 if r["i"] < 32 else 0.5)).alias("w")) for r in st)) if st else F.array()
    return e.select("vec_id", F.zip_with("embedding", scales, lambda v, c: (v - c["m"]) / c["w"]).alias("embedding")) if st else e


@query("l06_kernel_neighbours", f"{NEAR} SELECT query_id, vec_id, rank, round(exp(-d / max(d) OVER (PARTITION BY query_id)), 6) AS weight FROM r WHERE rank <= 10", inputs=False)
def kernel_neighbours(spark, sf_dir):
    """The ten nearest rows of every query (ids divisible by 50), cells that cannot hold one ruled out, weighed by their distance."""
    near = nearest_ten(spark, sf_dir)
    far = F.max("d").over(Window.partitionBy("query_id"))
    return near.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), r6(F.exp(-F.col("d") / far)).alias("weight"))


def nearest_ten(spark, sf_dir):
    from issuetime.operators.nearest import nearest_rows

    e = standardised(spark, sf_dir)
    return nearest_rows(e.where("vec_id % 50 = 0"), e, 10)


@query("m17_analogue_forecast", f"{NEAR}, k AS (SELECT query_id, vec_id, exp(-d / max(d) OVER (PARTITION BY query_id)) AS w FROM r WHERE rank <= 10) SELECT query_id, round(sum(w * label) / sum(w), 6) AS mean, round((sum(w) FILTER (label = 0) + 2 * 0.1) / (sum(w) + 2), 6) AS share FROM (SELECT k.*, e.label FROM k JOIN embeddings e USING (vec_id)) GROUP BY query_id".replace("sum(w) FILTER (label = 0)", "coalesce(sum(w) FILTER (label = 0), 0)"), inputs=False)
def analogue_forecast(spark, sf_dir):
    """From the kernel-weighted nearest cases: the weighted mean of their outcome, and the share of one class shrunk to its prior."""
    near = nearest_ten(spark, sf_dir)
    w = F.exp(-F.col("d") / F.max("d").over(Window.partitionBy("query_id")))
    cases = near.select("query_id", "vec_id", w.alias("w")).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    share = (F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("w"))), F.lit(0.0)) + 2 * 0.1) / (F.sum("w") + 2)
    return cases.groupBy("query_id").agg(r6(F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("mean"), r6(share).alias("share"))


@query("m17_transferred_median", f"""{NEAR}, k AS (SELECT query_id, vec_id, exp(-d / max(d) OVER (PARTITION BY query_id)) AS w FROM r WHERE rank <= 10),
  c AS (SELECT k.query_id, k.w, e.label - 10 * e.embedding[1]::DOUBLE AS moved, k.vec_id FROM k JOIN embeddings e USING (vec_id)),
  t AS (SELECT *, sum(w) OVER (PARTITION BY query_id ORDER BY moved, vec_id ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY query_id) AS whole FROM c)
  SELECT query_id, round(10 * any_value(q.embedding[1]::DOUBLE) + min(moved) FILTER (upto >= whole / 2 - 1e-12), 6) AS forecast FROM t JOIN embeddings q ON q.vec_id = t.query_id GROUP BY query_id""", inputs=False)
def transferred_median(spark, sf_dir):
    """The nearest cases' outcomes less their own level, their weighted median, moved to the level of the query (ten times the first column)."""
    near = nearest_ten(spark, sf_dir)
    w = F.exp(-F.col("d") / F.max("d").over(Window.partitionBy("query_id")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", (10 * F.col("embedding")[0].cast("double")).alias("level"))
    cases = near.select("query_id", "vec_id", w.alias("w")).join(e, "vec_id").withColumn("moved", F.col("label") - F.col("level"))
    order = Window.partitionBy("query_id").orderBy("moved", "vec_id").rowsBetween(Window.unboundedPreceding, 0)  # ten cases
    reached = cases.withColumn("upto", F.sum("w").over(order)).withColumn("whole", F.sum("w").over(Window.partitionBy("query_id"))).where("upto >= whole / 2 - 1e-12")
    own = e.select(F.col("vec_id").alias("query_id"), "level")
    return reached.groupBy("query_id").agg(F.min("moved").alias("moved")).join(own, "query_id").select("query_id", r6(F.col("level") + F.col("moved")).alias("forecast"))


@query("l07_bin_extremes", """, x AS (SELECT *, min(us) OVER w AS f, max(us) OVER w AS l FROM readings WINDOW w AS (PARTITION BY series)), b AS (SELECT *, least(floor((us - f) * 24 / (l - f + 1)::DOUBLE), 23) AS bin FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY series, bin ORDER BY v, us) AS lo, row_number() OVER (PARTITION BY series, bin ORDER BY v DESC, us) AS hi FROM b) SELECT series, us, v FROM r WHERE lo = 1 OR hi = 1 OR us IN (f, l)""")
def bin_extremes(spark, sf_dir):
    return sel.bin_extremes(readings(spark, sf_dir), "us", "v", 24, "series").select("series", "us", "v")


SLOTS = 60


@query("l07_filled_slots")
def filled_slots(spark, sf_dir):
    """The extremes of each bin, and rows that split the largest gaps in time until every series has sixty."""
    r = readings(spark, sf_dir)
    chosen = sel.bin_extremes(r, "us", "v", 24, "series").select("series", "us")
    return sel.fill_slots(chosen, r, SLOTS, "us", "series")


@query("l08_stride", f""", j AS (SELECT *, sum(j) OVER (PARTITION BY series ORDER BY us) AS seg FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY series ORDER BY us) > {HOUR} THEN 1 ELSE 0 END AS j FROM readings)),
  r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us) - 1 AS i, min(us) OVER (PARTITION BY series, seg) AS a, max(us) OVER (PARTITION BY series, seg) AS b FROM j) SELECT series, us FROM r WHERE i % 10 = 0 OR us IN (a, b)""")
def stride(spark, sf_dir):
    return sel.stride(fr.segments(readings(spark, sf_dir), HOUR), 10, "us", "series", "segment").select("series", "us")


@query("l10_origin_grid", f" SELECT series, unnest(range(min(us) // {HOUR} * {HOUR} + {HOUR}, max(us) + 1, {HOUR})) AS origin FROM readings GROUP BY series")
def origin_grid(spark, sf_dir):
    bounds = readings(spark, sf_dir).groupBy("series").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    start = F.col("a") - F.col("a") % HOUR + HOUR
    return bounds.select("series", F.explode(F.sequence(start, F.col("b"), F.lit(HOUR))).alias("origin"))


@query("l11_hash_sample")
def hash_sample(spark, sf_dir):
    """A sampling operator: a fixed number of issues by the hash of their id, the same whatever the partitioning."""
    return issues(spark, sf_dir).orderBy(F.xxhash64("issue_id", F.lit(7)), "issue_id").limit(200).select("series", "issue_id", "issue_us")


@query("p08_valid_clock", f" SELECT issue_id FROM issues WHERE recorded_us - issue_us BETWEEN 0 AND 120000000 AND (recorded_us + {12 * HOUR} + {2 * HOUR - 1}) // {2 * HOUR} = (issue_us + {12 * HOUR} + {2 * HOUR - 1}) // {2 * HOUR}")
def valid_clock(spark, sf_dir):
    """Issues recorded within two minutes whose target closes at the same label by the recorded clock, from which it was stored, and by the issue's."""
    from issuetime.operators.buckets import bucket_label

    closes = lambda c: bucket_label(F.col(c) + 12 * HOUR, 2 * HOUR)
    prompt = (F.col("recorded_us") - F.col("issue_us")).between(0, 2 * MINUTE)
    return issues(spark, sf_dir).where(prompt & (closes("recorded_us") == closes("issue_us"))).select("issue_id")


@query("p09_unsealed", f" SELECT issue_id FROM issues WHERE NOT (issue_us + {12 * HOUR} < {1_705_708_800_000_000} AND issue_us + {28 * HOUR} > {1_705_449_600_000_000})")
def unsealed(spark, sf_dir):
    hit = (F.col("issue_us") + 12 * HOUR < 1_705_708_800_000_000) & (F.col("issue_us") + 28 * HOUR > 1_705_449_600_000_000)
    return issues(spark, sf_dir).where(~hit).select("issue_id")


@query("p12_validated_heads", " SELECT issue_id, CASE WHEN recorded_us - issue_us > 120000000 THEN 'late' WHEN p_fall + p_rise > 0.329 AND p_fall > 0.3 THEN 'unsure' ELSE 'ok' END AS reason, CASE WHEN recorded_us - issue_us <= 120000000 AND NOT (p_fall + p_rise > 0.329 AND p_fall > 0.3) THEN round(pred, 6) END AS value FROM issues")
def validated_heads(spark, sf_dir):
    late, unsure = F.col("recorded_us") - F.col("issue_us") > 2 * MINUTE, (F.col("p_fall") + F.col("p_rise") > 0.329) & (F.col("p_fall") > 0.3)
    return issues(spark, sf_dir).select("issue_id", F.when(late, "late").when(unsure, "unsure").otherwise("ok").alias("reason"), r6(F.when(~late & ~unsure, F.col("pred"))).alias("value"))


@query("p13_cadence", f" SELECT issue_id, issue_us % {10 * MINUTE} < {5 * MINUTE} AS on_grid, CASE WHEN issue_us % {10 * MINUTE} < {5 * MINUTE} THEN CASE WHEN p_fall > p_rise THEN 'fall' ELSE 'rise' END END AS published FROM issues")
def cadence(spark, sf_dir):
    on = F.col("issue_us") % (10 * MINUTE) < 5 * MINUTE
    return issues(spark, sf_dir).select("issue_id", on.alias("on_grid"), F.when(on, F.when(F.col("p_fall") > F.col("p_rise"), "fall").otherwise("rise")).alias("published"))


@query("f07_session_cohort", f" SELECT issue_id, CASE WHEN abs(issue_us % {DAY} - {7 * HOUR + 15 * MINUTE}) <= {20 * MINUTE} THEN 'morning' WHEN abs(issue_us % {DAY} - {12 * HOUR}) <= {20 * MINUTE} THEN 'noon' ELSE 'moving' END AS cohort FROM issues")
def session_cohort(spark, sf_dir):
    near = lambda t: F.abs(F.col("issue_us") % DAY - t) <= 20 * MINUTE
    return issues(spark, sf_dir).select("issue_id", F.when(near(7 * HOUR + 15 * MINUTE), "morning").when(near(12 * HOUR), "noon").otherwise("moving").alias("cohort"))
