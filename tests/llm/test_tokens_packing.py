import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from issuetime.llm import packing, token_files
from issuetime.llm.queries import tokenizer_path
from issuetime.llm.tokens import PieceEncoder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(tokenizer_path(), limit=2000)


def expected(docs, tokenizer, end):
    rows = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [end]) for r in docs.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.text(alphabet=st.sampled_from(" \t\n\r\x0b\x1c 　ab'sétZ9|<>.,中"), max_size=30), max_size=5))
def test_pieces_equal_whole_texts(encoder, tokenizer, texts):
    plain = tokenizer
    assert encoder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_ranks_round_trip(ranks):
    control, data = token_files.pack_ranks(np.array(ranks, "<u4"))
    assert token_files.unpack_ranks(control, data, len(ranks)).tolist() == ranks


@pytest.mark.parametrize("file_tokens", [1000, 4_000_000])
def test_files_hold_every_id(spark, odd_docs, tokenizer, file_tokens):
    files = token_files.encode_documents(odd_docs, tokenizer_path(), file_tokens=file_tokens)
    got = sorted(token_files.decode_documents(spark, files).collect(), key=lambda r: r["start"])
    want, at = expected(odd_docs, tokenizer, token_files.END_ID), 0
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (at, len(ids), ids, crc(ids))
        at += len(ids)


def test_files_of_nothing(spark, no_docs):
    assert token_files.document_tokens(no_docs, tokenizer_path()).count() == 0


def test_real_documents_read_back(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in token_files.document_tokens(docs, tokenizer_path(), file_tokens=5000).collect()}
    at = 0
    for d, ids in expected(docs, tokenizer, token_files.END_ID):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=6), st.integers(0, 60))
def test_fill_is_closest(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    chosen = packing.fill(counts, room)
    assert all(n <= counts[k] for k, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 1000), max_size=20))
def test_plan_places_every_piece(counts):
    placed = {}
    for pattern, times in packing.plan(counts, 64):
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            placed[k] = placed.get(k, 0) + n * times
    assert placed == counts


def check_packing(docs, packed, tokenizer):
    want = expected(docs, tokenizer, packing.END_ID)
    rows = packed.collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    for d, ids in want:
        pieces = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_id[d]})
        assert [p[2] for p in pieces] == [crc(ids[s : s + n]) for s, n, _, _ in pieces]
        assert [p[0] for p in pieces] == list(range(0, len(ids), 1024)) and sum(p[1] for p in pieces) == len(ids) == pieces[0][3]
    assert len(rows) == sum(-(-len(ids) // 1024) for _, ids in want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(1024 - sum(n for _, n in p) for p in sequences.values()) / (1024 * len(sequences))


def test_packing_of_odd_rows(odd_docs, no_docs, tokenizer):
    check_packing(odd_docs, packing.pack_documents(odd_docs, tokenizer_path()), tokenizer)
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_packing_wastes_little(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check_packing(docs, packing.pack_documents(docs, tokenizer_path()), tokenizer) < 0.01
