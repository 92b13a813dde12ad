"""Joins of tables that grow with the input are shuffled; Spark's sizes of compressed files and exploded arrays would have them broadcast."""

import random

import pytest

from issuetime.llm import common, components, exact_dedup, minhash, mixing


@pytest.fixture
def plans(monkeypatch):
    """The physical plans of all that is written meanwhile."""
    seen = []

    def stored(df, label):
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return common.stored(df, label)

    for module in (components, exact_dedup, minhash):
        monkeypatch.setattr(module, "stored", stored)
    return seen


def near_copies(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
        rows += [(3 * i + k, " ".join([*words[: 80 - k], *(f"n{i}{k}{j}" for j in range(k))]), f"s{i % 3}") for k in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_near_copies_meet_without_the_driver(spark, plans):
    """op2, pipeline (F1, F2): tokens, signatures, prefixes, links and labels grow with the documents."""
    out = minhash.near_duplicates(near_copies(spark))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert {(r["component_id"], r["kept"]) for r in out.collect()} == {(3 * i, k) for i in range(60) for k in (True, False)}
    assert len(plans) > 8 and sum(p.count("SortMergeJoin") for p in plans) > 8
    assert not any("Broadcast" in p for p in plans)


def test_exact_copies_meet_without_the_driver(spark, plans):
    """pipeline (F1): winners grow with the documents."""
    docs = near_copies(spark)
    out = exact_dedup.kept_rows(docs.union(docs))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert out.count() == 180 and not any("Broadcast" in p for p in plans)


def test_cuts_meet_their_rows_without_the_driver(spark):
    """pipeline (F1): as many cuts as sources have key buckets; a source's target may be broadcast."""
    plan = mixing.mixed_documents(near_copies(spark))._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_bucket" in line]
