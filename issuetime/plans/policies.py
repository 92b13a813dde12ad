"""Policies as tables: every gate is a row (metric, cohort, operator, limit) that meets metrics in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuetime.operators import scores as sc
from issuetime.plans.scoring import SCORED, scored
from issuetime.plans.streams import work_dir
from issuetime.plans.targets import r6
from issuetime.registry import query
from issuetime.schemas import DAY

POLICY = "policy string, gate string, metric string, cohort string, op string, bound double"
#: The fixed policy of a release: nine gates.
RELEASE = [
    ("release", "support", "n", "all", ">=", 100.0),
    ("release", "days", "days", "all", ">=", 10.0),
    ("release", "error", "mae", "all", "<=", 35.0),
    ("release", "skill", "skill", "all", ">=", 0.0),
    ("release", "bias", "off", "all", "<=", 10.0),
    ("release", "wins", "wins", "all", ">=", 0.5),
    ("release", "chances", "brier", "all", "<=", 0.3),
    ("release", "large_changes", "mae", "big", "<=", 60.0),
    ("release", "falls", "skill", "fall", ">=", 0.0),
]
#: What a series must show at a look: a policy of its own, read by the same code.
PROSPECTIVE = [
    ("look", "support", "n", "all", ">=", 20.0),
    ("look", "days", "days", "all", ">=", 3.0),
    ("look", "better", "skill", "all", ">=", 0.02),
]
COHORTS = {"all": "TRUE", "big": "abs(d) >= 20", "fall": "d <= -20"}


def stored_policy(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A policy written as a table of the work folder and read again, as another's would be."""
    path = f"{work_dir(spark)}/policy"
    spark.createDataFrame(rows, POLICY).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def cohort_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, cohort, metric, value of scored rows (target, pred, ref, d, p_fall, issue_us), each row in every cohort whose condition holds."""
    each = rows.withColumn("cohort", F.explode(F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in COHORTS.items())))))
    better = (F.abs(F.col("pred") - F.col("target")) < F.abs("d")).cast("int")
    more = [F.count_distinct(F.expr(f"issue_us div {DAY}")).alias("days"), F.abs(F.avg(F.col("pred") - F.col("target"))).alias("off"), F.avg(better).alias("wins"), F.avg(F.pow(F.col("p_fall") - (F.col("d") <= -20).cast("int"), 2)).alias("brier")]
    wide = each.groupBy(*by, "cohort").agg(*sc.point_metrics("target", "pred", "ref"), *more)
    metrics = [c for c in wide.columns if c not in (*by, "cohort")]
    return wide.select(*by, "cohort", *(F.col(c).cast("double") for c in metrics)).unpivot([*by, "cohort"], metrics, "metric", "value")


def margin(value: Column, op: Column, bound: Column) -> Column:
    """How far a value is on the right side of its bound; negative on the wrong one, null without a value or with an unknown operator."""
    return F.when(op == ">=", value - bound).when(op == "<=", bound - value)


def judged(metrics: DataFrame, policy: DataFrame, by: list[str]) -> DataFrame:
    """``by``, policy, gate, value, bound, margin, passed, and of the whole policy verdict and failures (gates comma-joined).

    A gate whose metric is missing for a subject fails. Policies are few rows; metrics stay distributed.
    """
    subjects = metrics.select(*by).distinct()
    asked = subjects.crossJoin(F.broadcast(policy))  # a handful of gates for each subject
    met = asked.join(metrics, [*by, "metric", "cohort"], "left").withColumn("margin", margin(F.col("value"), F.col("op"), F.col("bound")))
    met = met.withColumn("passed", F.coalesce(F.col("margin") >= 0, F.lit(False)))
    whole = met.groupBy(*by, "policy").agg(F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("failures"))  # gates of one policy
    verdict = F.when(F.col("failures") == "", "qualified").otherwise("failed")
    return met.join(whole, [*by, "policy"]).select(*by, "policy", "gate", "value", "bound", "margin", "passed", verdict.alias("verdict"), "failures")


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in rows) + ") p(policy, gate, metric, cohort, op, bound)"


def _judged_sql(rows: list[tuple], source: str, by: str) -> str:
    cohorts = " UNION ALL ".join(f"SELECT *, '{n}' AS cohort FROM {source} WHERE {c}" for n, c in COHORTS.items())
    return f"""c AS ({cohorts}), w AS (SELECT {by}, cohort, count(*)::DOUBLE AS n, count(DISTINCT issue_us // {DAY})::DOUBLE AS days, avg(abs(pred - target)) AS mae, 1 - avg(abs(pred - target)) / avg(abs(d)) AS skill, abs(avg(pred - target)) AS off,
    avg((abs(pred - target) < abs(d))::INT) AS wins, avg((p_fall - (d <= -20)::INT) ** 2) AS brier FROM c GROUP BY ALL),
  m AS (SELECT * FROM w UNPIVOT (value FOR metric IN (n, days, mae, skill, off, wins, brier))),
  j AS (SELECT {", ".join(f"s.{c}" for c in by.split(", "))}, p.*, m.value, CASE op WHEN '>=' THEN value - bound ELSE bound - value END AS margin FROM (SELECT DISTINCT {by} FROM m) s CROSS JOIN {_values(rows)}
    LEFT JOIN m ON {" AND ".join(f"m.{c} = s.{c}" for c in by.split(", "))} AND m.metric = p.metric AND m.cohort = p.cohort),
  f AS (SELECT *, coalesce(margin >= 0, FALSE) AS passed FROM j),
  g AS (SELECT *, coalesce(array_to_string(list_sort(list(gate) FILTER (NOT passed) OVER (PARTITION BY {by})), ','), '') AS failures FROM f)
  SELECT {by}, policy, gate, round(value, 6) AS value, bound, round(margin, 6) AS margin, passed, CASE failures WHEN '' THEN 'qualified' ELSE 'failed' END AS verdict, failures FROM g"""


@query("a46_release_policy", f"{SCORED}, {_judged_sql(RELEASE, 'scored', 'series')}")
def release_policy(spark, sf_dir):
    """Every series against the nine gates of the release policy."""
    out = judged(cohort_metrics(scored(spark, sf_dir), ["series"]), stored_policy(spark, RELEASE), ["series"])
    return out.select("series", "policy", "gate", r6("value").alias("value"), "bound", r6("margin").alias("margin"), "passed", "verdict", "failures")


#: Days after a cohort's first issue at which its looks fall due.
DUE = (10, 15, 20)


@query("v04_policy_looks", f"""{SCORED}, b AS (SELECT series, version, min(issue_us) // {DAY} AS began FROM issues GROUP BY ALL), l AS (SELECT *, began + unnest({list(DUE)}) AS look FROM b),
  seen AS (SELECT s.*, l.look FROM scored s JOIN l USING (series, version) WHERE s.complete < l.look * {DAY}), {_judged_sql(PROSPECTIVE, 'seen', 'series, version, look')}""")
def policy_looks(spark, sf_dir):
    """Looks at every cohort, due some days after its first issue, claimed in an append-only table before outcomes are read, each judged by its policy
    on what had closed by then; a claim that is repeated is one look."""
    from issuetime.schemas import issues
    from issuetime.sources.ingest import append_issues

    path = f"{work_dir(spark)}/looks"
    began = issues(spark, sf_dir).groupBy("series", "version").agg(F.expr(f"min(issue_us) div {DAY}").alias("began"))
    claims = began.withColumn("due", F.explode(F.array(*(F.lit(d) for d in DUE)))).select("series", "version", (F.col("began") + F.col("due")).alias("look"))
    for _ in range(2):
        append_issues(claims, path, ["series", "version", "look"], "series")
    looks = spark.read.parquet(path)
    rows = scored(spark, sf_dir).join(looks, ["series", "version"]).where(F.col("complete") < F.col("look") * DAY)
    by = ["series", "version", "look"]
    out = judged(cohort_metrics(rows, by), stored_policy(spark, PROSPECTIVE), by)
    return out.select(*by, "policy", "gate", r6("value").alias("value"), "bound", r6("margin").alias("margin"), "passed", "verdict", "failures")
