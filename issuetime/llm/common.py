"""What the operators of this subpackage share: patterns of white space and words, and the shared work folder."""

from __future__ import annotations

import tempfile
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of the contracts: ASCII only, the same in Java, Python and RE2.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    A machine-local folder is used only in local mode with that setting unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid4().hex}"


class OwnRows(NamedTuple):
    """Rows under private names: the caller's columns as ``_own_<i>``, ``_row`` (a number of each row, fixed once written), and more."""

    table: DataFrame
    names: dict[str, str]

    def those(self, rows: DataFrame) -> DataFrame:
        """The caller's rows, under their own names, whose ``_row`` is in ``rows``: the numbers make the hash tables, the wide rows stream
        past them unsorted."""
        return self.named(self.table.join(rows.select("_row").hint("shuffle_hash"), "_row", "left_semi"))

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(v).alias(k) for k, v in self.names.items()))


def own_rows(docs: DataFrame, label: str, **more: Column) -> OwnRows:
    """``docs`` written once under private names, with the columns ``more`` taken of them, so that no column of the caller clashes with
    those of an operator and decisions are joined back to exactly the row they were made for."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    columns = [F.col(f"`{c}`").alias(v) for c, v in names.items()]
    return OwnRows(stored(docs.select(*columns, F.monotonically_increasing_id().alias("_row"), *(c.alias(k) for k, c in more.items())), label), names)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: its lineage ends there, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """The join of two tables that grow with the input, both shuffled: Spark sizes tables by their compressed files, arrays and exploded rows
    as one value, and would broadcast by way of the driver what is many times larger in memory."""
    return left.join(right.hint("merge"), on, how)
