import hashlib
import re

import pytest
from pyspark.sql import functions as F

from issuetime.llm import exact_dedup, mixing
from issuetime.llm.common import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]")


def filled(sizes, weights, total, cap):
    """Targets by resharing the excess again and again."""
    target, open_, left = {}, set(sizes), total
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > cap * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        left, open_ = left - sum(cap * sizes[s] for s in over), open_ - over
    return target


def check_mix(docs, **settings):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORDS.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    got = mixing.mix_sources(docs, **settings).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), len(WORDS.findall(r["text"] or ""))) for r in rows)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert targets[s] - 1.001 < n <= targets[s] + 1e-6
    return got


@pytest.mark.parametrize("digits", [1, 3])
def test_mix_of_odd_rows(odd_docs, no_docs, digits):
    assert sorted(map(str, check_mix(odd_docs, digits=digits))) == sorted(map(str, check_mix(odd_docs.repartition(3), digits=digits)))
    assert mixing.mix_sources(no_docs).count() == 0


def test_mix_of_documents_materialised(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in check_mix(docs)}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {d: n for d, n in taken.items() if n}


def check_dedup(docs, got):
    want = {}
    for r in docs.collect():
        text = r["text"] or ""
        want.setdefault(hashlib.sha256(SPACES.sub("", text).encode()).hexdigest(), []).append((-len(text), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]))
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in got) == sorted((str(x[3]), k) for k, v in want.items() for x in v)
    for r in got:
        group = want[r["text_sha256"]]
        assert r["group_size"] == len(group) and r["keep_id"] == min(group)[3]
    assert sum(r["kept"] for r in got) == len(want)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_dedup_of_odd_rows(odd_docs, no_docs):
    got = exact_dedup.dedup_documents(odd_docs)
    check_dedup(odd_docs, got.collect())
    rows, kept = [tuple(r) for r in odd_docs.collect()], [tuple(r) for r in exact_dedup.kept_rows(odd_docs).collect()]
    assert all(r in rows for r in kept) and sorted(str(r[0]) for r in kept) == sorted(str(r["doc_id"]) for r in got.where("kept").collect())
    assert exact_dedup.kept_rows(no_docs).columns == odd_docs.columns and exact_dedup.kept_rows(no_docs).count() == 0
    assert exact_dedup.dedup_documents(no_docs).count() == 0


def test_index_persists(spark, odd_docs):
    location = shared_dir(spark, "index")
    exact_dedup.dedup_documents(odd_docs.where("doc_id <= 2"), location, 4)
    later = {r["doc_id"]: r for r in exact_dedup.dedup_documents(odd_docs.where("doc_id in (1, 8)"), location, 4).collect()}
    assert not later[1]["kept"] and later[1]["keep_id"] == 2 and later[8]["kept"]
    assert spark.read.parquet(location).count() == 2


def test_a_batch_run_again_is_decided_as_before(spark, odd_docs):
    location = shared_dir(spark, "index")
    exact_dedup.dedup_documents(odd_docs.where("doc_id = 1"), location, 4, "first")
    runs = [sorted(map(str, exact_dedup.dedup_documents(odd_docs, location, 4, "second").collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    index = exact_dedup.DigestIndex(spark, location, 4)
    small = index.compacted(shared_dir(spark, "compact"))
    assert sorted(map(str, small.table().collect())) == sorted(map(str, index.table().collect())) and small.table().count() == 7
