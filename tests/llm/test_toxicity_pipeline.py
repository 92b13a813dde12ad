from issuetime.llm import packing, toxicity
from issuetime.llm.queries import tokenizer_path

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0").withColumnRenamed("toxic", "y"), "doc_id").collect()
    hits = sum(r["toxic"] for r in got if r["y"])
    false = sum(r["toxic"] for r in got if not r["y"])
    assert hits >= 0.85 * sum(r["y"] for r in got) and false <= 0.005 * len(got)


def test_odd_rows_and_nothing_to_learn(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (8, 1, 0), (3, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["p_toxic"] <= 1 for r in got)
    none = toxicity.toxicity(odd_docs, labels.where("false")).collect()
    assert not any(r["toxic"] for r in none) and len(none) == len(got)
    assert toxicity.clean_documents(odd_docs, labels.where("false")).columns == odd_docs.columns
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DIR).cache()
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    left = {r["doc_id"] for r in now.select("doc_id").collect()}
    clean = [d for d, t in labels.items() if not t]
    assert len(left & {d for d, t in labels.items() if t}) < 0.2 * sum(labels.values())
    assert len(left) > 0.5 * len(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DIR)
    tokens = packing.token_pieces(now, tokenizer_path()).groupBy().sum("length").first()[0]
    assert packed.groupBy().sum("length").first()[0] == tokens


def test_the_bound_is_one_of_rows(spark):
    """One id on many rows gives one row to learn from, so that no more than the bound reach the driver."""
    docs = spark.range(5000).selectExpr("1L as doc_id", "concat('text ', id) as text").union(spark.createDataFrame([(2, "b"), (3, None), (4, "d")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 5)], "doc_id bigint, quality int, toxic int")
    assert toxicity.labelled(docs, labels, 2).count() == 2
    assert [tuple(r) for r in toxicity.labelled(docs, labels, 10).orderBy("doc_id").collect()] == [(1, "text 0", 0, 1), (2, "b", 0, 0), (3, None, 0, 1), (4, "d", 0, 0)]
    assert toxicity.toxicity(docs, labels).count() == docs.count()
