"""Decisions of the pipeline's stages reach their own rows where doc_id is null or shared by different texts."""

import random

from pyspark.sql import functions as F

from issuetime.llm import minhash, mixing


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_near_copies_without_id_and_one_id_on_two_texts(spark):
    rng = random.Random(3)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    copy = lambda text, i: " ".join([*text[:-1], f"end{i}"])
    rows = [(None, copy(a, i)) for i in range(3)]  # near copies of each other, none with an id
    rows += [(5, copy(b, 0)), (5, copy(c, 0)), (6, copy(b, 1)), (7, copy(c, 1)), (None, copy(c, 2)), (4, copy(c, 3))]
    rows += [(None, " ".join(d)), (8, None), (None, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r["doc_id"], r["text"]) for r in minhash.kept_documents(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [next(k for k in kept if k in rows[:3]), (5, copy(b, 0)), (4, copy(c, 3)), *rows[-4:]]))
    component = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).where("n_shingles > 0").collect()}
    assert component == {(None, None), (5, 5), (6, 5), (5, 4), (7, 4), (None, 4), (4, 4)}


def test_mix_of_rows_without_id_and_shared_ids(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, None, 1, 2, i]), " ".join(words(rng, rng.randrange(0, 30))) or None, rng.choice(["a", "b", None])) for i in range(10, 90)]
    rows += [(None, "four words of text", "b")] * 6 + [(1, "four words of text", "a"), (1, "four words of text", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    given = {r["source"]: r["n"] for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    out = mixing.mixed_documents(docs).collect()
    got, cut, times = dict.fromkeys(given, 0), dict.fromkeys(given, 0), {}
    whole = {(r[0], r[1], r[2]) for r in rows}
    for r in out:
        got[r["source"]] += len(r["text"].split())
        cut[r["source"]] += tuple(r) not in whole
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert got == given and max(cut.values()) <= 1
    assert all(n <= 2 * rows.count(k) for k, n in times.items() if k in whole)
