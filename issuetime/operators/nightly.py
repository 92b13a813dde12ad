"""Refits of distributed models for every day of a table: each day is predicted by a model of the rows that had closed before it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuetime.operators.learn import training_spans
from issuetime.schemas import DAY, STANDARD, Clocks

THREADS, LEAST = 4, 20


def day_of(clock: str | Column) -> Column:
    c = F.col(clock) if isinstance(clock, str) else clock
    return ((c - F.pmod(c, F.lit(DAY))) / DAY).cast("long")


def nightly(rows: DataFrame, asked: DataFrame, fit_predict: Callable, schema: str, keys: list[str], folder: str, clocks: Clocks = STANDARD, least: int = LEAST, threads: int = THREADS) -> DataFrame:
    """``fit_predict(train, test, day)`` for every day on which ``asked`` has rows, with the columns of ``schema``.

    train holds the day's rows of ``learn.training_spans``: within the lookback, past the embargo, with targets closed before the day began. They
    are written once, each with the days it serves. A day with fewer than ``least`` training rows has no model: its rows are returned with their ``keys`` and nulls. ``rows`` and ``asked`` need issue_us. At most ``threads`` days are fitted at a time, each as Spark jobs over its rows;
    a day's predictions are written to ``folder`` as soon as they are there. The driver keeps one number for each day.
    """
    spark, (path, results) = rows.sparkSession, (f"{folder}/spans", f"{folder}/days")
    spans = training_spans(rows, clocks)
    spans.write.parquet(path)
    spans = spark.read.schema(spans.schema).parquet(path)
    served = spans.groupBy("first", "last").agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.explode(F.sequence("first", "last")))
    days = asked.select(day_of("issue_us").alias("day")).where("day is not null").distinct().join(served, "day", "left")
    sizes = {r["day"]: r["n"] or 0 for r in days.groupBy("day").agg(F.sum("n").alias("n")).collect()}  # a number a day
    fitted, bare = [d for d, n in sizes.items() if n >= least], [d for d, n in sizes.items() if n < least]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def one(day: int) -> str:
        train = spans.where((F.col("first") <= day) & (F.col("last") >= day)).drop("first", "last")
        test = asked.where((F.col("issue_us") >= day * DAY) & (F.col("issue_us") < (day + 1) * DAY))
        at = f"{results}/day={day}"
        fit_predict(train, test, day).select(*names).write.mode("overwrite").parquet(at)
        return at

    with ThreadPoolExecutor(threads) as pool:
        written = list(pool.map(one, sorted(fitted)))
    rest = asked.where(day_of("issue_us").isin(*bare)) if bare else asked.where(F.lit(False))
    kinds = dict(c.strip().split(" ", 1) for c in schema.split(","))
    rest = rest.select(*((F.col(n) if n in keys else F.lit(None)).cast(kinds[n]).alias(n) for n in names))
    return rest.unionByName(spark.read.schema(schema).parquet(*written)) if written else rest
