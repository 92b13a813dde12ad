"""A content-addressed web archive: payload bytes once per digest, record headers exactly as written, joined again on reading.

An archive is a folder with two tables. ``payloads`` (sha256, packed) holds the bytes of each distinct payload once, compressed by
themselves, under a strong digest that is checked against the bytes whenever they are read. ``headers`` (record_id, sha256, header) holds the
exact WARC/1.1 header block of each record. A response record is its header, a blank line, its payload and two line ends;
a revisit record has the same without payload and names the response's record id, so readers get its payload by the join.
"""

from __future__ import annotations

import base64
import hashlib
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuetime.llm.common import shared_dir, stored

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: An extension field: the length of the payload that a record stands for, also where the record has none of its own.
LENGTH = "X-Payload-Length"
#: Digests that a task remembers to drop equal payloads early; those past it are dropped after the shuffle.
DIGESTS = 1_000_000


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base 32 (upper case, no padding needed) of a 40-digit hex string: five hex digits make four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    block = lambda i: F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda i, k: F.substring(F.lit(letters), F.shiftright(block(i), 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(i, k) for i in range(8) for k in range(4)])


def _record_id(page_id: Column, row: Column) -> Column:
    """A name of its own for every row: the page and the row's number."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Archive every row of ``pages`` (columns read: page_id, url, html); returns the folder.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id (null smallest; of repeated
    rows one) is a response and the others revisit it; smaller ones are all responses. A null html is an empty payload, a
    null url an empty target URI. Equal payloads are found by SHA-256 over partial aggregates, and each task compresses and passes on
    one of its equal payloads, so a huge group of copies moves its bytes once per task at most. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark, "archive")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    rows = stored(
        keyed.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("sha1"), F.monotonically_increasing_id().alias("row")), "pages"
    )
    largest = F.max_by(F.struct("page_id", "row"), F.struct(F.col("page_id").isNotNull(), "page_id", -F.col("row")))
    groups = rows.groupBy("sha256").agg(largest.alias("first")).select("sha256", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    response = (F.col("payload_bytes") < least_bytes) | (F.col("row") == F.col("first_row"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line(LENGTH, F.col("payload_bytes")),
        F.when(response, F.lit("")).otherwise(F.concat(_line("WARC-Refers-To", _record_id(F.col("first_id"), F.col("first_row"))), _line("WARC-Profile", F.lit(PROFILE)))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(response, F.col("payload_bytes")).otherwise(F.lit(0))),
    )
    records = rows.join(groups, "sha256").select(_record_id(F.col("page_id"), F.col("row")).alias("record_id"), "sha256", response.alias("whole"), header.cast("binary").alias("header"))
    records.write.parquet(f"{path}/headers")
    # the bytes of each digest once: a task passes on the first of its equal payloads, so that copies are neither compressed nor moved
    def compressed(batches):
        import pyarrow as pa
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=6), set()
        for batch in batches:
            names, packed = [], []
            if len(seen) > DIGESTS:
                seen.clear()
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    packed.append(pack.compress(x.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(packed, pa.binary())], names=["sha256", "packed"])

    packed = keyed.select("sha256", "payload").mapInArrow(compressed, "sha256 string, packed binary")
    packed.dropDuplicates(["sha256"]).write.parquet(f"{path}/payloads")  # a row per task and digest at most
    return path


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """record_id, record (its exact bytes) and payload of every record of the archive.

    ``payloads``: give revisits the payload of their response too; otherwise it is null there, and a huge group of copies meets no
    payload at all. A payload whose bytes do not give its digest ends the read with an error.
    """

    def rebuilt(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            records, found = [], []
            for sha256, whole, header, packed in zip(*(batch.column(i) for i in (1, 2, 3, 4)), strict=True):
                try:
                    payload = unpack.decompress(packed.as_buffer())
                except zstandard.ZstdError as e:
                    raise ValueError(f"damaged payload {sha256.as_py()}") from e
                if hashlib.sha256(payload).hexdigest() != sha256.as_py():
                    raise ValueError(f"damaged payload {sha256.as_py()}")
                records.append(b"".join([header.as_py(), b"\r\n", payload if whole.as_py() else b"", b"\r\n\r\n"]))
                found.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.binary()), pa.array(found, pa.binary())], names=["record_id", "record", "payload"])

    headers, packed = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    joined = (headers if payloads else headers.where("whole")).join(packed, "sha256").select("record_id", "sha256", "whole", "header", "packed")
    out = joined.mapInArrow(rebuilt, "record_id string, record binary, payload binary")
    if payloads:
        return out
    bare = headers.where("not whole").select("record_id", F.concat("header", F.lit("\r\n\r\n\r\n").cast("binary")).alias("record"), F.lit(None).cast("binary").alias("payload"))
    return out.union(bare)


def export_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write the archive's records as ``.warc.gz`` files, one compressed member for each record; returns file and records.

    Every task writes one file under a passing name and moves it into place, so that a repeated task leaves one file.
    """

    def written(batches):
        import gzip

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        name, passing, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", f"{at}/_{uuid4().hex}", 0
        with system.open_output_stream(passing, compression=None) as out:
            for batch in batches:
                for record in batch.column(0):
                    out.write(gzip.compress(record.as_py(), mtime=0))
                    n += 1
        if n:
            system.move(passing, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})
        else:
            system.delete_file(passing)

    return stored(read_records(spark, path, payloads=False).select("record").mapInArrow(written, "file string, records bigint"), "warc-files")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, header fields and block of every record in the ``.warc.gz`` files of a folder; a file is read a record at a time."""

    def parsed(batches):
        import gzip
        import io

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                stream = gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))
                while line := stream.readline():
                    head = [line]
                    while (line := stream.readline()) not in (b"\r\n", b""):
                        head.append(line)
                    size = next(int(x.split(b": ", 1)[1]) for x in head if x.startswith(b"Content-Length: "))
                    fields, block = parse_record(b"".join([*head, b"\r\n", stream.read(size + 4)]))
                    yield pa.RecordBatch.from_pydict({"record_id": [fields["WARC-Record-ID"]], "fields": pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), "block": pa.array([block], pa.binary())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInArrow(parsed, "record_id string, fields map<string,string>, block binary")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, block


def _page(record_id: str) -> int | None:
    name = record_id.removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return None if name == "none" else int(name)


def record_table(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, parsed from the records' bytes.

    Stated digest and length are checked against every payload that is there; revisits state those of their response.
    """

    def parsed(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for record, payload in zip(batch.column(0), batch.column(1), strict=True):
                fields, block = parse_record(record.as_py())
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields[LENGTH])
                if payload.is_valid:
                    data = payload.as_py()
                    if base64.b32encode(hashlib.sha1(data).digest()).decode() != digest or len(data) != size or block not in (data, b""):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                to = fields.get("WARC-Refers-To")
                rows.append((_page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(to) if to else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read_records(spark, path, payloads=False).select("record", "payload").mapInArrow(parsed, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
