import random
import re

import numpy as np
from pyspark.sql import functions as F

from issuetime.llm import minhash
from issuetime.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    rank = lambda d: (d is None, d or 0)
    label = {}
    for i, (d, _) in enumerate(sets):
        label[find(i)] = min([d, label.get(find(i), d)], key=rank)
    return sorted(((str(d), len(s), str(label[find(i)])) for i, (d, s) in enumerate(sets)))


def check(docs):
    got = minhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    return got


def test_documents_against_all_pairs(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    kept = minhash.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "8", "9", "None"]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_chains_around_the_threshold_and_a_common_passage(spark):
    """Chains of slowly drifting copies (links just above and below 0.75), and texts that are mostly one passage."""
    rng = random.Random(7)
    rows, word = [], lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    for _ in range(12):
        text = [word() for _ in range(rng.choice([8, 20, 60, 150]))]
        for _ in range(12):
            rows.append(" ".join(text))
            for _ in range(rng.choice([1, 1, 2])):
                text[rng.randrange(len(text))] = word()
    rows += [" ".join([word() for _ in range(rng.randrange(1, 40))] + passage + [word()]) for _ in range(60)]
    rng.shuffle(rows)
    got = check(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"))
    sizes = {}
    for r in got:
        sizes[r["component_id"]] = sizes.get(r["component_id"], 0) + 1
    assert max(sizes.values()) > 5


def test_components_of_paths(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 70), (60, 70)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([50, 60, 70, 100], 50)}


def test_copies_changed_too_much_form_no_pairs(spark):
    """op2, pipeline (round 3): a large group of copies of which two have a similarity of about 0.7; two true links among them are found."""
    rng = np.random.default_rng(43)
    whole = rng.integers(0, 1 << 63, 300)
    sets = []
    for _ in range(120):  # each lacks some other shingles of the whole, so that no shingle is common to all
        own = whole.copy()
        own[rng.choice(300, 28, replace=False)] = rng.integers(0, 1 << 63, 28)
        sets.append(np.unique(own.astype(np.uint64)))
    for i in (5, 70):  # a link: a twentieth changed
        twin = sets[i].copy()
        twin[:15] = rng.integers(0, 1 << 63, 15).astype(np.uint64)
        sets.append(np.unique(twin))
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "id long, shingles binary")
    pairs = {(r["u"], r["v"]) for r in minhash.rare_pairs(table.select("id", F.col("id").alias("label")), table).collect()}
    similar = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    links = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if similar(a, b)}
    assert {(5, 120), (70, 121)} <= links <= pairs and len(pairs) < 60


def test_parities_bound_the_difference():
    rng = np.random.default_rng(47)
    for n, m in ((0, 3), (40, 2), (900, 300), (5000, 4000)):
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        a, b = np.concatenate([common, rng.integers(0, 1 << 63, m).astype(np.uint64)]), np.concatenate([common, rng.integers(0, 1 << 63, m + 1).astype(np.uint64)])
        apart = sum(int(x).bit_count() for x in (minhash.parities(a) ^ minhash.parities(b)).view(np.uint64))
        assert 0 < apart <= 2 * m + 1
