"""A detector that arms, holds and re-arms, as a stateful stream operator with timers and as the same fold over sorted rows."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SCHEMA = "series string, us bigint, fall double, what string"
STATE = "level double, since bigint, armed boolean"


def steps(rows, state: tuple[float, int, bool] | None, least: float, hold: int):
    """Events of rows in time order, and the state after them.

    Armed, the detector follows the highest level; a fall of ``least`` below it is an event. It then waits ``hold`` and arms again
    at the level it finds.
    """
    level, since, armed = state or (float("-inf"), 0, True)
    events = []
    for us, v in rows:
        if not armed and us >= since + hold:
            level, armed = v, True
        if armed:
            level = max(level, v)
            if v <= level - least:
                events.append((us, level - v))
                since, armed = us, False
    return events, (level, since, armed)


class Detector(StatefulProcessor):
    """One small state per series. Falls come out as they are found; when event time passes the hold, a timer arms the detector and says so,
    whether or not the series has gone on."""

    def __init__(self, least: float, hold: int) -> None:
        self.least, self.hold = least, hold

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("detector", STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        met = pd.concat(list(rows)).sort_values("us")
        events, after = steps(zip(met["us"], met["v"], strict=True), self.state.get() if self.state.exists() else None, self.least, self.hold)
        self.state.update((float(after[0]), int(after[1]), bool(after[2])))
        for us, _ in events:
            self.handle.registerTimer(-(-(int(us) + self.hold) // 1000))  # milliseconds, rounded up
        yield pd.DataFrame({"series": [key[0]] * len(events), "us": [int(e[0]) for e in events], "fall": [float(e[1]) for e in events], "what": ["fall"] * len(events)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        level, since, armed = self.state.get()
        at = since + self.hold
        if not armed and at <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.state.update((float("-inf"), since, True))  # follows from the next row on
        yield pd.DataFrame({"series": [key[0]], "us": [expiredTimerInfo.getExpiryTimeInMs() * 1000], "fall": [float("nan")], "what": ["armed"]})

    def close(self) -> None:
        pass


def detected(readings: DataFrame, least: float, hold: int, delay: str) -> DataFrame:
    """series, us, fall, what (fall, or armed when a hold has passed) of a stream of readings; rows behind the watermark are not seen."""
    rows = readings.withWatermark("ts", delay).select("series", F.unix_micros("ts").alias("us"), "v", "ts")
    return rows.groupBy("series").transformWithStateInPandas(Detector(least, hold), SCHEMA, "append", "eventTime")


@contextmanager
def timer_states(spark: SparkSession):
    """Streams started inside keep their states in the store that timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def set_late_aside(stream: DataFrame, path: str, checkpoint: str, delay: int) -> None:
    """Append a stream of rows (us) to ``path``/ledger, and rows more than ``delay`` behind the newest of earlier batches to ``path``/late instead.

    The clock of every batch is written before its rows are split, so that a repeated batch splits them the same way and writes its own folders
    again; what earlier reads of the ledger saw is never changed by a late row.
    """
    from issuetime.sources.ingest import existing

    def split(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.agg(F.max("us").alias("us")).write.mode("overwrite").parquet(f"{path}/clocks/batch={number}")
        clocks = existing(spark, f"{path}/clocks").where(F.col("batch") < number)
        newest = clocks.agg(F.max("us")).first()[0]  # a number a batch
        late = F.lit(False) if newest is None else F.col("us") <= newest - delay
        rows.where(~late).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")
        rows.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
