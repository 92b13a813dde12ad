"""Token ids as binary files: frequency-ranked ids, one to four bytes each, their lengths in separate control bytes.

A file holds, little-endian: the magic ``RVB1``, the number of documents and of ids (two u64), then per document its doc_id
(i64), a null flag (u8) and its number of ids (u32), then one control byte for four ids (two bits each: bytes less one, the
first id lowest) and the ids' ranks in as many bytes. Rank 0 is the most frequent id of the corpus. ``ranks.npy`` beside
the files maps ranks back to ids. Files are read by table lookup on control bytes, without a loop over ids.
"""

from __future__ import annotations

import io
import struct
import zlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from issuetime.llm.common import shared_dir, stored
from issuetime.llm.tokens import PieceEncoder, blocks

MAGIC = b"RVB1"
END_ID = 2


class TokenFiles(NamedTuple):
    """Where the files are, and one row per file: file, file_start (ids before it in the corpus), file_docs, file_tokens."""

    path: str
    manifest: DataFrame


def pack_ranks(ranks) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks."""
    import numpy as np

    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int):
    """The ``n`` ranks of :func:`pack_ranks`: lengths by a table of all control bytes, then shifted gathers."""
    import numpy as np

    table = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
    size = table[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    ends = np.cumsum(size, dtype=np.int64)
    start = ends - size
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8)])
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        if (more := np.flatnonzero(size > k)).size:
            out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list[int | None], lengths: list[int], ranks) -> bytes:
    import numpy as np

    control, data = pack_ranks(ranks)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([MAGIC, struct.pack("<QQ", len(doc_ids), len(ranks)), ids.tobytes(), null.tobytes(), np.array(lengths, dtype="<u4").tobytes(), control, data])


def parse_file(content: bytes):
    """doc_ids (list with None), lengths and ranks of a file."""
    import numpy as np

    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n = struct.unpack_from("<QQ", content, 4)
    at = 20
    ids = np.frombuffer(content, "<i8", docs, at)
    null = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(content, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    controls = -(-n // 4)
    ranks = unpack_ranks(content[at : at + controls], content[at + controls :], n)
    return [None if x else int(i) for i, x in zip(ids, null, strict=True)], lengths.astype(np.int64), ranks


def _write(folder: str, name: str, content: bytes) -> None:
    """A whole file in the shared folder: written under another name, then moved, so that a repeated task leaves one file."""
    from uuid import uuid4

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/_{uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, f"{path}/{name}")


def encode_documents(docs: DataFrame, tokenizer: str, file_tokens: int = 4_000_000, partitions: int | None = None) -> TokenFiles:
    """Write every whole text of ``docs`` as ids in ascending doc_id order (null first), each document ended by id 2.

    Texts are sorted by ranges of doc_id, encoded once and kept as compressed blocks of at most about ``file_tokens`` ids;
    then ids are counted over all blocks (at most the vocabulary's size of counts reaches the driver), ranked, and each
    block becomes one file. Null texts are empty documents (the end id alone); an empty table gives no files.
    """
    spark = docs.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def encoded(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = PieceEncoder.shared(tokenizer), TaskContext.get().partitionId()
        end, block, ids, sizes, parts = np.array([END_ID], "<u4").tobytes(), 0, [], [], []

        def out():
            whole = np.frombuffer(b"".join(parts), "<u4")
            kind = "<u2" if not len(whole) or whole.max() < 1 << 16 else "<u4"
            return pa.RecordBatch.from_pydict(
                {"part": [part], "block": [block], "doc_ids": [list(ids)], "lengths": [list(sizes)], "wide": [kind == "<u4"], "ids": [whole.astype(kind).tobytes()]},
                schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("wide", pa.bool_()), ("ids", pa.binary())]),
            )

        total = 0
        for doc_ids, texts in blocks(batches, ("doc_id", "text")):
            for d, b in zip(doc_ids, encoder.encode(texts), strict=True):
                if ids and total + len(b) // 4 + 1 > file_tokens:
                    yield out()
                    block, total, ids, sizes, parts = block + 1, 0, [], [], []
                ids.append(d)
                parts.append(b + end)
                sizes.append(len(b) // 4 + 1)
                total += sizes[-1]
        if ids:
            yield out()

    path = shared_dir(spark, "token-ids")
    coded = ordered.mapInArrow(encoded, "part int, block int, doc_ids array<bigint>, lengths array<bigint>, wide boolean, ids binary")
    coded.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(coded.schema).parquet(path)

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(0, np.int64)
        for batch in batches:
            for wide, raw in zip(batch.column(0), batch.column(1), strict=True):
                more = np.bincount(np.frombuffer(raw.as_buffer(), "<u4" if wide.as_py() else "<u2"))
                counts, more = (more, counts) if len(more) > len(counts) else (counts, more)
                counts[: len(more)] += more
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(counts[ids], pa.int64())})

    # one row per id of the vocabulary at most
    ranked = kept.select("wide", "ids").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()
    files, by_rank = shared_dir(spark, "token-files"), ranked["id"].to_numpy("uint32")

    def written(batches):
        import numpy as np
        import pyarrow as pa

        rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, doc_ids, lengths, wide = (batch.column(k)[i].as_py() for k in range(5))
                ids = np.frombuffer(batch.column(5)[i].as_buffer(), "<u4" if wide else "<u2")
                name = f"tokens-{part:06d}-{block:06d}.rvb"
                _write(files, name, file_bytes(doc_ids, lengths, rank[ids]))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "file": [name], "file_docs": [len(doc_ids)], "file_tokens": [len(ids)]})

    made = stored(kept.mapInArrow(written, "part int, block int, file string, file_docs bigint, file_tokens bigint"), "token-manifest")
    buffer = io.BytesIO()
    import numpy as np

    np.save(buffer, by_rank)
    _write(files, "ranks.npy", buffer.getvalue())
    parts = made.groupBy("part").agg(F.sum("file_tokens").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    manifest = made.join(parts, "part").select("file", (F.col("_start") + F.coalesce(F.sum("file_tokens").over(within), F.lit(0))).alias("file_start"), "file_docs", "file_tokens")
    return TokenFiles(files, manifest)


def decode_documents(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, and ids (array) of every document."""
    return _decoded(spark, files, True)


def _decoded(spark: SparkSession, files: TokenFiles, with_ids: bool) -> DataFrame:
    import numpy as np
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(files.path)
    with system.open_input_stream(f"{path}/ranks.npy") as f:
        by_rank = np.load(io.BytesIO(f.read()))  # at most the vocabulary

    def decoded(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids, lengths, ranks = parse_file(content.as_py())
                ids = by_rank[ranks].astype("<u4")
                starts = np.cumsum(lengths) - lengths
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                cols = {"file": [name.as_py().rsplit("/", 1)[-1]] * len(doc_ids), "doc_id": pa.array(doc_ids, pa.int64()), "_at": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(np.append(starts, len(ids)).astype("i4"), pa.array(ids.astype("i8")))
                yield pa.RecordBatch.from_pydict(cols)

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.rvb").load(files.path) if files.manifest.take(1) else spark.createDataFrame([], "path string, content binary")
    schema = "file string, doc_id bigint, _at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    rows = content.select("path", "content").mapInArrow(decoded, schema).join(files.manifest, "file")
    return rows.select("doc_id", (F.col("file_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def document_tokens(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32 of every document."""
    return _decoded(docs.sparkSession, encode_documents(docs, tokenizer, **settings), False)
