import base64
import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuetime.llm import pii, warc

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain(text):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


@given(st.text(alphabet="aé@.0159 -+()", max_size=60) | st.lists(st.sampled_from(["a@b.c", "@", "x.y@z-1.org", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "001.02.3.4", ".5", "+49 (30) 123456", "+1", " ", "z", "٣"])).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    found = {k: s for k, _, _, s in pii.find_spans("pay to IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not GB82WEST12345698765431")}
    assert found == {"iban": 1.0} or set(found) == {"iban"}
    assert [x[0] for x in pii.find_spans("social security 123-45-6789")] == ["ssn"] and not pii.find_spans("part 123-45-6789 of it")
    assert pii.redact("mail a.b@c.org now, 1.2.3.4") == "mail <email> now, <ip>"


def test_long_runs_and_secrets():
    import time

    began = time.perf_counter()
    for text in ("1" * 1_000_000, "1." * 500_000, "0." * 300_000 + "x@" * 50_000, "+1" + "(" * 500_000, "a" * 1_000_000):
        assert [x for x in pii.base_spans(text) if x[0] == "ip"] == [("ip", i, i + 7) for i in range(0, len(text) - 7, 8) if text[i : i + 7] in ("1.1.1.1", "0.0.0.0")]
    assert time.perf_counter() - began < 60
    found = pii.find_spans('set token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and commit f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda' + " x" * 60 + " cafe0123456789cafe0123456789cafe")
    assert [(k, a, s) for k, a, _, s in found] == [("secret", 13, 0.6), ("secret", 66, 0.6)] or [(k, a) for k, a, *_ in found] == [("secret", 13)]


def test_query_rows(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.span_digest(pii.personal_data(docs)).collect()}
    some = 0
    for r in docs.collect():
        want, row = plain(r["text"]), got[r["doc_id"]]
        assert row["base_sha256"] == pii.digest_of(want)
        assert [row[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]
        spans = [tuple(x.split(":")) for x in row["spans"].split(",") if x]
        assert [x for x in spans if x[0] in pii.BASE_KINDS] == [(k, str(a), str(b)) for k, a, b in want]
        some += len(want)
    assert some > 5
    assert pii.personal_data(odd_docs).count() == odd_docs.count() and pii.personal_data(no_docs).count() == 0


PAGES = "page_id bigint, url string, html string, sha256 string, payload int"


def test_archive_round_trip(spark):
    rows = [(1, "u", "<p>ü</p>", "x", 1), (2, "v", "<p>ü</p>", None, None), (2, "v", "<p>ü</p>", None, None), (3, None, None, "x", 1), (4, "a\r\nb", "", "x", 1), (5, "w", "x" * 300_000, "x", 1), (None, "n", "<p>ü</p>", "x", 1), (7, "alone", "\r\n\r\nWARC/1.1", "x", 1)]
    pages = spark.createDataFrame(rows, PAGES)
    path = warc.write_archive(pages)
    got = warc.record_table(spark, path).collect()
    largest = {}
    for r in rows:
        largest[r[2] or ""] = max(largest.get(r[2] or "", -1), -1 if r[0] is None else r[0])
    want = []
    for i, r in enumerate(rows):
        data = (r[2] or "").encode()
        first = largest[r[2] or ""]
        response = r[0] == first and rows.index(r) == i
        want.append((str(r[0]), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first))
    assert sorted(map(str, want)) == sorted(str((str(r[0]), *r[1:])) for r in got)
    assert spark.read.parquet(f"{path}/payloads").count() == len(largest)
    for r in warc.read_records(spark, path).collect():
        fields, block = warc.parse_record(bytes(r["record"]))
        assert fields["WARC-Record-ID"] == r["record_id"] and block in (bytes(r["payload"]), b"")


def test_small_payloads_and_damage(spark):
    pages = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abcd", "", 0), (4, "u", "abcd", "", 0)], PAGES)
    path = warc.write_archive(pages, least_bytes=3)
    kinds = {r["page_id"]: r["record_type"] for r in warc.record_table(spark, path).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    spark.read.parquet(f"{path}/payloads").withColumn("packed", F.lit("zz").cast("binary")).write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.record_table(spark, f"{path}-bad").collect()
    assert warc.record_table(spark, warc.write_archive(pages.where("false"))).count() == 0


def test_records_of_one_page_have_names_of_their_own_and_files_read_back(spark):
    rows = [(1, "u", "one", "", 0), (1, "u", "two", "", 0), (1, "v", "one", "", 0), (None, None, None, None, None), (None, None, None, None, None), (9, "w", "two\r\n\r\nWARC/1.1\r\n", "", 0), (3, "z", "one", "", 0)]
    path = warc.write_archive(spark.createDataFrame(rows, PAGES))
    records = {r["record_id"]: r for r in warc.read_records(spark, path).collect()}
    assert len(records) == len(rows)
    folder = f"file://{path.removeprefix('file:')}-files" if not path.startswith("file://") else f"{path}-files"
    assert warc.export_files(spark, path, folder).agg({"records": "sum"}).first()[0] == len(rows)
    for r in warc.read_files(spark, folder).collect():
        fields, block = warc.parse_record(bytes(records[r["record_id"]]["record"]))
        assert fields == dict(r["fields"]) and block == bytes(r["block"])
        if fields["WARC-Type"] == "revisit":
            response, payload = warc.parse_record(bytes(records[fields["WARC-Refers-To"]]["record"]))
            assert response["WARC-Type"] == "response" and response["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"] and payload == bytes(records[r["record_id"]]["payload"])


def test_many_equal_rows_store_their_bytes_once(spark, monkeypatch):
    """Hundreds of rows of one id and payload, and ids without a payload of their own, over several tasks; an empty archive exports no file."""
    pages = spark.createDataFrame([(5, "u", "same", "", 0)] * 600 + [(None, "u", "same", "", 0)] * 200 + [(i, "u", f"own {i}", "", 0) for i in range(50)], PAGES).repartition(6)
    path = warc.write_archive(pages)
    assert spark.read.parquet(f"{path}/payloads").count() == 51
    got = warc.record_table(spark, path).collect()
    assert len(got) == 850 and sum(r["record_type"] == "response" for r in got) == 51 and all(r["refers_to"] == 5 for r in got if r["record_type"] == "revisit")
    empty = warc.write_archive(pages.where("false"))
    folder = f"file://{empty.removeprefix('file://')}-files"
    assert warc.export_files(spark, empty, folder).count() == 0
