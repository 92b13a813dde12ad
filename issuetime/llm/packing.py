"""Packing token sequences by minimum bin slack.

Documents are cut into full windows and a remainder. Remainders are planned by their lengths alone: while any are left, the
longest one opens a window and a bitset subset-sum over the lengths still there finds the multiset that fills the window
closest to its capacity (counts traced back through the bitsets). The pattern is repeated as often as the counts allow, so
the plan has a bounded size whatever the corpus. Pieces find their place in the plan by their rank within their length.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuetime.llm.common import met, stored
from issuetime.llm.tokens import PieceEncoder, blocks

CAPACITY, END_ID = 1024, 0


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum comes closest to ``room`` without passing it."""
    reach, layers, mask = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        layers.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, .. copies reach every number of copies
            take = min(step, left)
            reach |= reach << take * length & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        used = 0
        while not before >> best & 1:
            best, used = best - length, used + 1
        if used:
            chosen[length] = used
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> pieces in a window) with the number of windows that each fills, until no piece is left."""
    left, out = dict(counts), []
    while left:
        longest = max(left)
        rest = {k: v for k, v in left.items()}
        rest[longest] -= 1
        pattern = fill(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        left = {k: v - times * pattern.get(k, 0) for k, v in left.items() if v > times * pattern.get(k, 0)}
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and end id 0, cut at every multiple of ``capacity``: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        encoder, end = PieceEncoder.shared(tokenizer), np.array([END_ID], "<u4").tobytes()
        for doc_ids, texts in blocks(batches, ("doc_id", "text")):
            rows = []
            for d, b in zip(doc_ids, encoder.encode(texts), strict=True):
                raw = memoryview(b + end)
                n = len(raw) // 4
                rows += [(d, s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, buckets: int = 1024) -> DataFrame:
    """Pack every whole text of ``docs``; one row per piece.

    Columns read: doc_id, text. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id (from 0, without gaps),
    offset. Null texts are empty documents: the end id alone. Repeated rows are packed each; an empty table gives no rows.
    Pieces of one length, however many, are ranked over ``buckets`` hash buckets and the buckets' running counts.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, capacity).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets))), "pieces")
    sizes = pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows, used, sequence = [], dict.fromkeys(lengths, 0), 0
    for pattern, times in plan(lengths, capacity):
        at = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times, n, at, sequence))
            used[length] += n * times
            at += n * length
        sequence += times
    # bounded by the patterns' lengths, whatever the number of documents
    places = spark.createDataFrame(rows, "_length bigint, _from bigint, _to bigint, _each bigint, _at bigint, _sequence bigint")
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")
    ranked = met(pieces.withColumn("_row", F.row_number().over(inside) - 1), bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_row"))
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    index = F.col("_rank") - F.col("_from")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(index / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + index % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )
