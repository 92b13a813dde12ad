import math
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from issuetime.llm import language_id as li
from issuetime.llm.queries import op13_language_id, vocabulary_path

PIECES = li.Pieces(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abc", "c", "A", "1", "x1"])


def cuts(word):
    """All segmentations of a word as lists of piece numbers; characters without a piece are 0."""
    marked = li.START + word
    for k in range(len(marked)):
        for inner in combinations(range(1, len(marked)), k):
            at = [0, *inner, len(marked)]
            parts = [marked[a:b] for a, b in zip(at, at[1:])]
            if all(p in PIECES.ids or len(p) == 1 for p in parts):
                yield [PIECES.ids.get(p, 0) for p in parts]


WORDS = ["a", "ab", "abab", "cabac", "zzb", "abcabcab", "b", "ébc"]


def test_forward_sums_all_segmentations():
    table = np.random.default_rng(1).uniform(0.01, 0.2, (len(PIECES.ids) + 1, 3))
    got = li.log_probabilities(WORDS, PIECES, table)
    for w, row in zip(WORDS, got):
        want = [math.log(sum(math.prod(table[p, c] for p in cut) for cut in cuts(w))) for c in range(3)]
        assert row.tolist() == pytest.approx(want, rel=1e-12)


def test_expected_counts_are_those_of_all_segmentations():
    table, n, columns = np.random.default_rng(2).uniform(0.01, 0.2, (len(PIECES.ids) + 1, 2)), np.arange(1.0, 9.0), np.array([0, 1] * 4)
    want = np.zeros(table.shape)
    for w, k, c in zip(WORDS, n, columns):
        each = [(math.prod(table[p, c] for p in cut), cut) for cut in cuts(w)]
        for share, cut in each:
            for p, times in Counter(cut).items():
                want[p, c] += k * times * share / sum(s for s, _ in each)
    assert li.expected_counts(WORDS, n, columns, PIECES, table) == pytest.approx(want, rel=1e-9)


def test_words_and_letters():
    assert [w for g in li.words_of("L'Été, 3x² a_b́ " + "q" * 70) for w in g] == ["l", "été", "x²", "a", "b", "q" * 32, "q" * 32, "q" * 6]
    assert not list(li.words_of(None)) and not list(li.words_of("")) and li.has_letter("x²") and not li.has_letter("²")
    long = "word nächste " * 200_000
    assert sum(map(len, li.words_of(long))) == 400_000


def test_odd_rows_and_clashing_columns(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("size", "lang_pred").withColumnRenamed("taken", "score").withColumnRenamed("_id", "held_out")
    rows = [tuple(r) for r in li.identify_languages(docs, vocabulary_path()).collect()]
    assert len(rows) == docs.count()
    for doc_id, held, lang, score in rows:
        assert held == (crc32(str(doc_id).encode() if doc_id is not None else b"") % 5 == 0) and 0 <= score <= 1
        assert (lang == "und") == (doc_id in (3, 4, 5)) and (lang in ("en", "fr") or score == 0)
    assert li.identify_languages(no_docs, vocabulary_path()).count() == 0
    none = li.identify_languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"), vocabulary_path())
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}


def test_small_memory_gives_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = li.fit(docs, vocabulary_path())
    a = sorted(map(tuple, model.predict(docs).collect()))
    assert a == sorted(map(tuple, model.predict(docs.repartition(7), kept_words=100_000).collect()))


def test_held_out_accuracy(spark):
    """Every text whose language is known, short and junk ones included; the label is never read for a prediction."""
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = [r for r in op13_language_id(spark, d).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert len(rows) > 150 and sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in rows) >= 0.97 * len(rows)
