"""Reading, validating and appending rows under receipt clocks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from issuetime.schemas import SECOND, micros


def read_readings(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """series, us, obs_id, v of the readings with start <= us <= end; the bounds reach the scan as a filter on ts."""
    rows = spark.read.parquet(path)
    if spark.conf.get("spark.sql.session.timeZone") == "UTC":
        at = lambda us: F.timestamp_micros(F.lit(us)).cast("timestamp_ntz")
        rows = rows.where(F.col("ts").between(at(start), at(end)))
    return rows.select(F.col("event_type").alias("series"), micros(F.col("ts")).alias("us"), F.col("event_id").alias("obs_id"), F.col("value").alias("v")).where(F.col("us").between(start, end))


def finite(value: Column) -> Column:
    """The number, or null if it is not finite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def ingest_readings(raw: DataFrame, received: int) -> tuple[DataFrame, DataFrame]:
    """Accepted readings, with non-finite values made null, and those rejected: clocks over a minute past their receipt."""
    late = F.col("us") > received + 60 * SECOND
    return raw.where(~late).withColumn("v", finite(F.col("v"))), raw.where(late)


def missing_issues(new: DataFrame, existing: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """Of the new rows the first of each key that ``existing`` lacks; what is written is never replaced."""
    first = Window.partitionBy(*keys).orderBy(order)
    once = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once if existing is None else once.join(existing.select(*keys), keys, "left_anti")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_issues(new: DataFrame, path: str, keys: list[str], order: str, partition: str | None = None) -> None:
    """Append to the table at ``path`` the rows whose key it lacks. One writer at a time; a batch that is repeated adds nothing."""
    writer = missing_issues(new, existing(new.sparkSession, path), keys, order).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
