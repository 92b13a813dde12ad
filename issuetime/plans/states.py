"""Air states of closed series: rules over changes, a second channel and the state of the running event, first match wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.operators import frames as fr
from issuetime.operators.joins import asof_join_blocks
from issuetime.operators.machine import run_machine
from issuetime.plans.targets import B
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, newest_runs, readings, run_hours_of

#: States of the event and what a bucket says of it.
IDLE, FORMING, HELD_ONCE, CONFIRMED, REBOUND = range(5)
PLAIN, GAP, TRIGGER, LOW, ABOVE = range(5)
#: The state that follows, by state and symbol (PLAIN, GAP, TRIGGER, LOW, ABOVE): a fall triggers, two buckets near the low confirm, a rise over it rebounds.
MOVES = [
    [IDLE, IDLE, FORMING, IDLE, IDLE],
    [FORMING, IDLE, FORMING, HELD_ONCE, IDLE],
    [HELD_ONCE, IDLE, CONFIRMED, CONFIRMED, REBOUND],
    [CONFIRMED, IDLE, CONFIRMED, CONFIRMED, REBOUND],
    [IDLE, IDLE, FORMING, HELD_ONCE, REBOUND],
]


def companions(spark, sf_dir) -> DataFrame:
    """series, other: each series' second channel, the one named after it (the last one's is the first), as a table of the series there are."""
    names = readings(spark, sf_dir).select("series").distinct().withColumn("i", F.row_number().over(Window.orderBy("series")) - 1)  # a row a series
    sized = names.crossJoin(names.agg(F.count(F.lit(1)).alias("c")))
    return sized.select("series", ((F.col("i") + 1) % F.col("c")).alias("j")).join(names.select(F.col("series").alias("other"), F.col("i").alias("j")), "j").select("series", "other")


def event_symbols(levels: DataFrame, bucket: int = B) -> DataFrame:
    """``levels`` with changes over one, two and three buckets, and the symbol that a bucket is for the event."""
    out = levels
    for k in (1, 2, 3):
        out = bk.at_offset(out, -k, bucket, f"b{k}")
    falls = F.coalesce(F.sum((F.col("med") < F.col("b1")).cast("int")).over(fr.steps_back(3, bucket)), F.lit(0))
    low = F.min("med").over(fr.steps_back(12, bucket))
    out = out.withColumns({"falls": falls, "low12": low, "d1": F.col("med") - F.col("b1"), "d2": F.col("med") - F.col("b2"), "d3": F.col("med") - F.col("b3")})
    trigger = (F.col("d3") <= -15) & (F.col("falls") >= 2) & (F.col("med") <= F.col("low12") + 5)
    symbol = F.when(F.col("d1").isNull(), GAP).when(trigger, TRIGGER).when(F.col("med") > F.greatest(F.col("low12") + 10, 1.2 * F.col("low12")), ABOVE).when(F.col("med") <= F.col("low12") + 5, LOW).otherwise(PLAIN)
    return out.withColumn("symbol", symbol)


_ROWS = f""", names AS (SELECT series, row_number() OVER (ORDER BY series) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT series FROM readings)),
  pairs AS (SELECT a.series, b.series AS other FROM names a JOIN names b ON b.i = (a.i + 1) % a.c),
  x AS (SELECT a.series, a.label, a.med, a.med - b1.med AS d1, a.med - b2.med AS d2, a.med - b3.med AS d3 FROM closed a
    LEFT JOIN closed b1 ON b1.series = a.series AND b1.label = a.label - {B} LEFT JOIN closed b2 ON b2.series = a.series AND b2.label = a.label - {2 * B} LEFT JOIN closed b3 ON b3.series = a.series AND b3.label = a.label - {3 * B}),
  y AS (SELECT *, count(*) FILTER (d1 < 0) OVER (PARTITION BY series ORDER BY label RANGE BETWEEN {2 * B} PRECEDING AND CURRENT ROW) AS falls, min(med) OVER (PARTITION BY series ORDER BY label RANGE BETWEEN {11 * B} PRECEDING AND CURRENT ROW) AS low12 FROM x),
  z AS (SELECT *, CASE WHEN d1 IS NULL THEN 1 WHEN d3 <= -15 AND falls >= 2 AND med <= low12 + 5 THEN 2 WHEN med > greatest(low12 + 10, 1.2 * low12) THEN 4 WHEN med <= low12 + 5 THEN 3 ELSE 0 END AS symbol,
    row_number() OVER (PARTITION BY series ORDER BY label) AS i FROM y),
  walk AS (
    SELECT z.series, z.i, z.label, {MOVES}[1][symbol + 1] AS state, z.med AS ewm FROM z WHERE i = 1
    UNION ALL
    SELECT z.series, z.i, z.label, {MOVES}[w.state + 1][z.symbol + 1], CASE WHEN z.symbol = 1 THEN z.med ELSE w.ewm * (1 - 2.0::DOUBLE / 5) + z.med * (2.0::DOUBLE / 5) END FROM walk w JOIN z ON z.series = w.series AND z.i = w.i + 1)"""


@query("e12_event_states", f"{_ROWS} SELECT z.series, z.label, z.symbol::BIGINT AS symbol, walk.state::BIGINT AS state FROM z JOIN walk USING (series, label)", recursive=True)
def event_states(spark, sf_dir):
    """What every bucket says of the event, and the state it leaves: idle, forming, held once, confirmed, rebound."""
    rows = event_symbols(bk.closed_series(readings(spark, sf_dir)))
    states = run_machine(rows, MOVES, IDLE, 7 * DAY)
    return rows.join(states, ["series", "label"]).select("series", "label", F.col("symbol").cast("long").alias("symbol"), F.col("state").cast("long").alias("state"))


@query("e12_air_states", f"""{_ROWS}, f AS (SELECT z.*, walk.state, z.med - walk.ewm AS gap, CASE WHEN z.med + c.med > 0 THEN c.med / (z.med + c.med) END AS mix FROM z JOIN walk USING (series, label) JOIN pairs USING (series) LEFT JOIN closed c ON c.series = pairs.other AND c.label = z.label)
  SELECT series, label, CASE WHEN d1 IS NULL OR d2 IS NULL THEN 'collecting' WHEN d1 >= 20 THEN 'fast_rise' WHEN state = 4 THEN 'rebound' WHEN state = 3 AND (mix IS NULL OR mix <= 0.8) THEN 'confirmed' WHEN state IN (1, 2) THEN 'forming' WHEN d1 <= -20 THEN 'rapid_improvement'
    WHEN d2 >= 10 OR gap >= 8 THEN 'rising' WHEN d2 <= -10 OR gap <= -8 THEN 'improving' WHEN med > 55 THEN 'stable_high' ELSE 'steady' END AS state FROM f""", recursive=True)
def air_states(spark, sf_dir):
    """All ten states: changes of the level, its distance from an average that restarts at gaps, the share of the second channel, and the event's state."""
    levels = bk.closed_series(readings(spark, sf_dir))
    rows = event_symbols(levels)
    event = run_machine(rows, MOVES, IDLE, 7 * DAY).withColumnRenamed("state", "event")
    slow = fr.segmented_ewm(levels, 4, B).select("series", "label", "ewm")
    other = companions(spark, sf_dir).join(levels.select(F.col("series").alias("other"), "label", F.col("med").alias("second")), "other").drop("other")
    f = rows.join(event, ["series", "label"]).join(slow, ["series", "label"]).join(other, ["series", "label"], "left")
    d1, d2, gap = F.col("d1"), F.col("d2"), F.col("med") - F.col("ewm")
    mix = F.when(F.col("med") + F.col("second") > 0, F.col("second") / (F.col("med") + F.col("second")))
    state = (
        F.when(d1.isNull() | d2.isNull(), "collecting").when(d1 >= 20, "fast_rise").when(F.col("event") == REBOUND, "rebound").when((F.col("event") == CONFIRMED) & (mix.isNull() | (mix <= 0.8)), "confirmed")
        .when(F.col("event").isin(FORMING, HELD_ONCE), "forming").when(d1 <= -20, "rapid_improvement").when((d2 >= 10) | (gap >= 8), "rising").when((d2 <= -10) | (gap <= -8), "improving").when(F.col("med") > 55, "stable_high").otherwise("steady")
    )
    return f.select("series", "label", state.alias("state"))


AHEAD = 6 * HOUR


@query("e15_dry_dispersion", f""", x AS (SELECT a.series, a.label, a.med - b.med AS d1, b.med - c.med AS d2 FROM closed a LEFT JOIN closed b ON b.series = a.series AND b.label = a.label - {B} LEFT JOIN closed c ON c.series = a.series AND c.label = a.label - {2 * B}),
  o AS (SELECT fetched, max(run_id) AS run_id FROM runs GROUP BY fetched), w AS (SELECT x.*, o.run_id FROM x ASOF LEFT JOIN o ON x.label >= o.fetched),
  h AS (SELECT w.series, w.label, count(precip) AS n, max(precip) AS wet, arg_max(temp, valid) - arg_min(temp, valid) AS warming, max(speed) AS wind FROM w JOIN run_hours r ON r.run_id = w.run_id AND r.valid > w.label AND r.valid <= w.label + {AHEAD} GROUP BY ALL)
  SELECT w.series, w.label, coalesce(w.label % {DAY} BETWEEN {4 * HOUR} AND {12 * HOUR} AND d1 < 0 AND d2 < 0 AND d1 + d2 <= -10, FALSE) AS falling, coalesce(n = 6 AND wet <= 0.5, FALSE) AS dry, coalesce(n = 6 AND warming > 0, FALSE) AS warming, coalesce(n = 6 AND wind >= 12, FALSE) AS ventilated,
    falling AND dry AND coalesce(n = 6 AND h.warming > 0, FALSE) AND ventilated AS watch FROM w LEFT JOIN h USING (series, label)""")
def dry_dispersion(spark, sf_dir):
    """Morning buckets after two falls, and what the newest run fetched before them says of the next six hours: dry, warming, ventilated; a watch if all hold."""
    x = bk.at_offset(bk.at_offset(bk.closed_series(readings(spark, sf_dir)), -1, B, "b"), -2, B, "c")
    d1, d2 = F.col("med") - F.col("b"), F.col("b") - F.col("c")
    sure = lambda c: F.coalesce(c, F.lit(False))
    x = x.select("series", "label", sure((F.col("label") % DAY).between(4 * HOUR, 12 * HOUR) & (d1 < 0) & (d2 < 0) & (d1 + d2 <= -10)).alias("falling")).withColumn("all", F.lit("all"))
    newest = newest_runs(spark, sf_dir)
    x = asof_join_blocks(x, newest, "label", "fetched", DAY, on="all").select("series", "label", "falling", F.col("right.run_id").alias("run_id"))
    hours = run_hours_of(newest).select("run_id", "valid", "precip", "temp", "speed")
    asked = x.where("run_id is not null").withColumn("valid", F.explode(F.sequence(F.col("label") + HOUR, F.col("label") + AHEAD, F.lit(HOUR))))  # labels are whole hours
    h = asked.join(hours, ["run_id", "valid"]).groupBy("series", "label").agg(F.count("precip").alias("n"), F.max("precip").alias("wet"), (F.max_by("temp", "valid") - F.min_by("temp", "valid")).alias("rise"), F.max("speed").alias("wind"))
    whole = F.col("n") == 6
    out = x.join(h, ["series", "label"], "left").select("series", "label", "falling", sure(whole & (F.col("wet") <= 0.5)).alias("dry"), sure(whole & (F.col("rise") > 0)).alias("warming"), sure(whole & (F.col("wind") >= 12)).alias("ventilated"))
    return out.withColumn("watch", F.col("falling") & F.col("dry") & F.col("warming") & F.col("ventilated"))
