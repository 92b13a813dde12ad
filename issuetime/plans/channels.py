"""Clearing and shower signals over channels that a table names: any series may be a level, a cooling, a moist or a further channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuetime.operators import buckets as bk
from issuetime.plans.targets import B
from issuetime.registry import query
from issuetime.schemas import DAY, HOUR, readings

#: Roles of the series in the order of their names; series past these are further channels.
ROLES = ("a", "b", "cool", "moist")


def channel_table(spark, sf_dir) -> DataFrame:
    """series, role: the two levels, the cooling and the moist channel, and gas for all others; a row for each series there is."""
    names = readings(spark, sf_dir).select("series").distinct().withColumn("i", F.row_number().over(Window.orderBy("series")))
    role = F.lit("gas")
    for i, r in enumerate(ROLES, 1):
        role = F.when(F.col("i") == i, r).otherwise(role)
    return names.select("series", role.alias("role"))


def channel_changes(levels: DataFrame, channels: DataFrame, bucket: int = B) -> DataFrame:
    """Per label what the signals ask: of both levels the change of a bucket (da, db), of two (fa, fb), of means of two buckets (sa, sb) and of the bucket before
    (pa, pb); the changes of the cooling and moist channels; how many channels besides the levels fell; how the levels' mix moved.

    Series stay rows until they are added up, so any number of them may have a role; of several in one role the largest change counts.
    """
    x = levels
    for k in (1, 2, 3):
        x = bk.at_offset(x, -k, bucket, f"m{k}")
    x = x.join(channels, "series").withColumns({"d1": F.col("med") - F.col("m1"), "d2": F.col("med") - F.col("m2"), "s": (F.col("med") + F.col("m1")) / 2 - (F.col("m2") + F.col("m3")) / 2, "p": F.col("m1") - F.col("m2")})
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    each = [of(r, c).alias(f"{n}{r}") for r in ("a", "b") for c, n in (("d1", "d"), ("d2", "f"), ("s", "s"), ("p", "p"), ("med", "v"), ("m2", "w"))]
    out = x.groupBy("label").agg(*each, of("cool", "d1").alias("cool"), of("moist", "d1").alias("moist"), F.count_if(~F.col("role").isin("a", "b") & (F.col("d1") < 0)).alias("support"))
    mix = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return out.withColumn("mix", mix("va", "vb") - mix("wa", "wb"))


_SIGNALS = f""", roles AS (SELECT series, CASE row_number() OVER (ORDER BY series) WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'cool' WHEN 4 THEN 'moist' ELSE 'gas' END AS role FROM (SELECT DISTINCT series FROM readings)),
  long AS (SELECT c.label, r.role, c.med, m2.med AS m2, c.med - m1.med AS d1, c.med - m2.med AS d2, (c.med + m1.med) / 2 - (m2.med + m3.med) / 2 AS s, m1.med - m2.med AS p FROM closed c JOIN roles r USING (series)
    LEFT JOIN closed m1 ON m1.series = c.series AND m1.label = c.label - {B} LEFT JOIN closed m2 ON m2.series = c.series AND m2.label = c.label - {2 * B} LEFT JOIN closed m3 ON m3.series = c.series AND m3.label = c.label - {3 * B}),
  wide AS (SELECT label, {", ".join(f"max({c}) FILTER (role = '{r}') AS {n}{r}" for r in ("a", "b") for c, n in (("d1", "d"), ("d2", "f"), ("s", "s"), ("p", "p"), ("med", "v"), ("m2", "w")))},
    max(d1) FILTER (role = 'cool') AS cool, max(d1) FILTER (role = 'moist') AS moist, count(*) FILTER (role NOT IN ('a', 'b') AND d1 < 0) AS support FROM long GROUP BY label),
  g AS (SELECT *, coalesce(da <= -5 AND db <= -5, FALSE) AS joint, coalesce(sa <= -8 AND sb <= -8 AND da <= 0 AND db <= 0 AND pa <= 0 AND pb <= 0, FALSE) AS rapid,
    coalesce(fa <= -6 AND cool < 0 AND moist > 0 AND ((label + {8 * HOUR}) % {DAY}) // {HOUR} BETWEEN 8 AND 18, FALSE) AS damp,
    coalesce(fa <= -6 AND fb <= -6 AND cool < 0 AND abs(va / nullif(va + vb, 0) - wa / nullif(wa + wb, 0)) <= 0.2, FALSE) AS wash FROM wide)
  SELECT label, joint, joint AND support >= 1 AS joint_supported, rapid, rapid AND support >= 2 AS rapid_supported, damp AS moist_cooling,
    CASE WHEN wash THEN 'active' WHEN bool_or(wash) OVER (ORDER BY label RANGE BETWEEN {3 * B} PRECEDING AND {B} PRECEDING) THEN 'recent' ELSE 'none' END AS shower FROM g"""


@query("e07_channel_signals", _SIGNALS)
def channel_signals(spark, sf_dir):
    """Joint drop, rapid clearing (smoothed over two buckets and going on from the one before), moist cooling in daytime, and the shower's state."""
    x = channel_changes(bk.closed_series(readings(spark, sf_dir)), channel_table(spark, sf_dir))
    sure = lambda c: F.coalesce(c, F.lit(False))
    joint = sure((F.col("da") <= -5) & (F.col("db") <= -5))
    rapid = sure((F.col("sa") <= -8) & (F.col("sb") <= -8) & (F.col("da") <= 0) & (F.col("db") <= 0) & (F.col("pa") <= 0) & (F.col("pb") <= 0))
    hour = F.expr(f"((label + {8 * HOUR}) % {DAY}) div {HOUR}")
    damp = sure((F.col("fa") <= -6) & (F.col("cool") < 0) & (F.col("moist") > 0) & hour.between(8, 18))
    wash = sure((F.col("fa") <= -6) & (F.col("fb") <= -6) & (F.col("cool") < 0) & (F.abs("mix") <= 0.2))
    x = x.select("label", joint.alias("joint"), rapid.alias("rapid"), damp.alias("moist_cooling"), wash.alias("wash"), "support")
    after = x.where("wash").select(F.explode(F.array(*(F.col("label") + k * B for k in (1, 2, 3)))).alias("label")).distinct().withColumn("recent", F.lit(True))
    state = F.when(F.col("wash"), "active").when(F.col("recent"), "recent").otherwise("none")
    return x.join(after, "label", "left").select("label", "joint", (F.col("joint") & (F.col("support") >= 1)).alias("joint_supported"), "rapid", (F.col("rapid") & (F.col("support") >= 2)).alias("rapid_supported"), "moist_cooling", state.alias("shower"))
