"""File sources and sinks: CSV exports, JSON-lines ledgers, detection lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuetime.schemas import MINUTE, micros, once


def export_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """The columns in their order, with a header, sorted by the first within and across files."""
    rows.select(*columns).orderBy(columns[0]).write.option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, before: int, clock: str = "recorded_us") -> DataFrame:
    """Records of a JSON-lines ledger recorded before a clock; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where((F.col(clock) < before) & F.col(clock).isNotNull())


def load_detections(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, acq_us, frp of a detection list: valid positions only, HHMM with or without leading zeros, null bad numbers.

    Columns: latitude, longitude, acq_date, acq_time, frp. Rows of one natural key are one detection.
    """
    raw = spark.read.option("header", True).schema("latitude string, longitude string, acq_date string, acq_time string, frp string").csv(path)
    number = lambda c: F.expr(f"try_cast({c} as double)")
    clock = F.lpad("acq_time", 4, "0")
    minutes = F.expr("try_cast(substring(lpad(acq_time, 4, '0'), 1, 2) as int)") * 60 + F.expr("try_cast(substring(lpad(acq_time, 4, '0'), 3, 2) as int)")
    rows = raw.select(number("latitude").alias("lat"), number("longitude").alias("lon"), (micros(F.expr("try_cast(acq_date as timestamp_ntz)")) + minutes.cast("long") * MINUTE).alias("acq_us"), number("frp").alias("frp"), clock.alias("_clock"))
    good = rows.where("lat between -90 and 90 and lon between -180 and 180 and acq_us is not null and length(_clock) = 4")
    return good.groupBy("lat", "lon", "acq_us").agg(F.max("frp").alias("frp"))


def decode_runs(runs: DataFrame, key: str, fields: tuple[str, ...], payload: str = "payload") -> DataFrame:
    """One row per run and hour from payloads of JSON text with an array ``hourly``; runs whose payload is malformed give none."""
    kinds = ", ".join(f"{f} {'bigint' if f in ('h', 'valid') else 'double'}" for f in fields)
    hours = once(F.from_json(payload, f"hourly array<struct<{kinds.replace(' ', ':').replace(',:', ', ')}>>")["hourly"])
    return runs.select(key, hours.alias("_hours")).select(key, F.explode("_hours").alias("_hour")).select(key, *(F.col("_hour")[f].alias(f) for f in fields))
