"""Exact dedup with a persistent index of digests.

The index is a table of digests, bucketed and sorted by digest. A batch is reduced to one winner per digest (partial
aggregation first, so that a huge group of copies is a few rows before the shuffle), the winners that the index lacks are
found by a sort-merge anti-join, which needs no shuffle of the index, and are appended.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuetime.llm.common import SPACE, met, own_rows, shared_dir, stored


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text without its white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "").cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, each with the batch that brought it, in a bucketed and sorted table at ``location``; opened again by its location.

    One writer at a time: two that append together would both take a digest for new. A batch that failed is run again under
    its own name and finds its own digests to be its own.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 32) -> None:
        self.spark, self.buckets, self.location, self.name = spark, buckets, location, f"digest_index_{uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id BIGINT, n_code_points BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows = rows.select("text_sha256", "keep_id", "n_code_points", "batch").repartition(self.buckets, "text_sha256")
        rows.write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").format("parquet").mode("append").saveAsTable(name)

    def add(self, winners: DataFrame) -> None:
        """Append the winners (text_sha256, keep_id, n_code_points, batch) whose digest the index lacks."""
        self._write(winners.hint("merge").join(self.table().hint("merge"), "text_sha256", "left_anti"), self.name)

    def compacted(self, location: str) -> DigestIndex:
        """The same digests at a new location, one sorted file per bucket instead of one per batch, so that joins need no sort."""
        out = DigestIndex(self.spark, location, self.buckets)
        self._write(self.table(), out.name)
        return out

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, n_code_points, row (a number of each row) of every row; other columns are ignored."""
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256"), length.alias("n_code_points"), F.monotonically_increasing_id().alias("row"))


def _decide(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """``rows`` (stored; columns of :func:`digests`) with keep_id, group_size and kept."""
    order = F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    groups = rows.groupBy("text_sha256").agg(F.min_by(F.struct("doc_id", "row", "n_code_points"), order).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    # what this batch itself has added, in a run that failed later, is new to it
    known = index.table().where(F.col("batch") != batch).select("text_sha256", F.col("keep_id").alias("_known"), F.lit(True).alias("_old"))
    winners = stored(groups.hint("merge").join(known.hint("merge"), "text_sha256", "left"), "winners")
    fresh = winners.where("_old is null")
    index.add(fresh.select("text_sha256", F.col("_best.doc_id").alias("keep_id"), F.col("_best.n_code_points").alias("n_code_points"), F.lit(batch).alias("batch")))
    new = F.col("_old").isNull()
    return met(rows, winners, "text_sha256").select(
        "doc_id", F.when(new, F.col("_best.doc_id")).otherwise(F.col("_known")).alias("keep_id"), "group_size",
        (new & (F.col("row") == F.col("_best.row"))).alias("kept"), "text_sha256", "n_code_points", "row",
    )


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Decide every row of ``docs`` against the index, and add the new texts to it.

    Of a new text's rows, that with the most code points, then the smallest doc_id stays (a null doc_id last); of repeated
    rows one. A text that the index already held keeps the id stored there, and its new rows are all dropped. ``batch`` names
    these rows (a new name if not given); the same batch again is decided as before.
    Null texts count as empty, and empty or blank texts are equal to each other. An empty table gives no rows.
    Returns doc_id, keep_id, group_size (rows of this text in ``docs``), kept, text_sha256, n_code_points.
    """
    return _decide(stored(digests(docs), "digests"), index, batch or uuid4().hex).drop("row")


def kept_rows(docs: DataFrame, location: str | None = None, buckets: int = 32, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`deduplicate` keeps, with their own columns.

    Rows are decided one by one on a number of their own, so null, shared or repeated ids and columns of any name are
    carried as they are; null and blank texts are one text, of which one row stays; an empty table gives no rows.
    """
    own = own_rows(docs, "rows", _digest=text_digest(F.col("text")))
    rows = own.table.select(
        F.col(own.names["doc_id"]).alias("doc_id"), F.col("_digest").alias("text_sha256"),
        F.coalesce(F.length(own.names["text"]), F.lit(0)).cast("long").alias("n_code_points"), F.col("_row").alias("row"),
    )
    index = DigestIndex(docs.sparkSession, location or shared_dir(docs.sparkSession, "digest-index"), buckets)
    decisions = _decide(stored(rows, "digests"), index, batch or uuid4().hex)
    index.close()
    return own.those(decisions.where("kept").select(F.col("row").alias("_row")))


def dedup_documents(docs: DataFrame, location: str | None = None, buckets: int = 32, batch: str | None = None) -> DataFrame:
    """:func:`deduplicate` against the index at ``location`` (new, in the shared folder, if none is given)."""
    index = DigestIndex(docs.sparkSession, location or shared_dir(docs.sparkSession, "digest-index"), buckets)
    out = deduplicate(docs, index, batch)
    index.close()
    return out
