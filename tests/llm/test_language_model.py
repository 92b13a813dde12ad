import math
import re
import zlib
from collections import Counter

import pytest

from issuetime.llm import language_model as lm

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, m, order):
    tokens = [(d, [*WORDS.findall((t or "").translate(LOWER)), None]) for d, t in rows]
    train = [t for d, t in tokens if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    one, more = Counter(w for t in train for w in t), Counter()
    for t in train:
        s = ["<s>", *t]
        for k in range(2, order + 1):
            more.update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    total, types = sum(one.values()), len(one)

    def p(w, h):
        if not h:
            return (one[w] + 0.5) / (total + 0.5 * (types + 1))
        c = one[h[0]] if len(h) == 1 and h[0] != "<s>" else one[None] if h == ("<s>",) else more[h]
        return (more[(*h, w)] + m * p(w, h[1:])) / (c + m)

    out = []
    for d, t in tokens:
        s = ["<s>", *t]
        base = sum(math.log10(p(w, ())) for w in t)
        score = sum(math.log10(p(s[i], tuple(s[max(0, i - order + 1) : i]))) for i in range(1, len(s)))
        out.append((str(d), len(t), sum(one[w] > 0 for w in t), total, base, score))
    return sorted(out), p, one


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_counts(spark, sf, order):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score_texts(docs, order=order, chunk_bytes=50_000, range_bytes=100_000).collect())
    want, p, one = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 20.0, order)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    for x, y in zip(got, want, strict=True):
        assert x[4] == pytest.approx(y[4], rel=1e-9) and x[5] == pytest.approx(y[5], rel=1e-9)


def test_each_state_sums_to_one():
    rows = [(i, t) for i, t in enumerate(["a b a", "b a c", "c c", "", "a"])]
    _, p, one = brute(rows, 3.0, 2)
    for h in [(), ("a",), ("<s>",), ("zzz",)]:
        assert sum(p(w, h) for w in one) + p("unseen", h) == pytest.approx(1)


def test_held_out_texts_gain_from_contexts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score_texts(docs).where("held_out").collect()
    assert len(rows) > 100 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_odd_rows(odd_docs, no_docs):
    got = lm.score_texts(odd_docs).collect()
    want, _, _ = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 20.0, lm.ORDER)
    for x, y in zip(sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), want, strict=True):
        assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-9)
    assert lm.score_texts(no_docs).count() == 0


def test_walks_in_stretches_and_failure_arcs(spark, monkeypatch):
    """Long texts are walked in stretches from the state that their words lead to; backoff takes several failure arcs."""
    text = " ".join(f"w{i * i % 23}" for i in range(1500))
    rows = [(i, text[i:] if i % 5 else f"w{i} new{i} w1 w4 w9 w{i}") for i in range(40)] + [(40, "w1 w1 unseen w4 w9 w16")]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), order=4).collect()}
    want, _, _ = brute(rows, 20.0, 4)
    assert got == {int(w[0]): pytest.approx(w[5], rel=1e-9) for w in want}


def test_very_long_words_and_texts():
    from issuetime.llm.shingles import WordHasher

    texts = ["x" * 3000 + " a " + "é" * 900, "", " b\tB ", "a " * 500, None, "tail"]
    whole, parted = WordHasher().words(texts), WordHasher(part=64).words(texts)
    assert whole[0].tolist() == parted[0].tolist() and whole[1].tolist() == parted[1].tolist()
    assert whole[1].tolist() == [0, 3, 3, 5, 505, 505, 506] and whole[0][3] == whole[0][4]
