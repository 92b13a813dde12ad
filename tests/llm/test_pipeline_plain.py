"""The toxicity chain, every stage of the pipeline, and the stages' handling of odd rows, against plain Python."""

import hashlib
import math
import re
import struct

import numpy as np
import pytest
import xxhash
from test_minhash import WORDS, shingles
from test_mixing_exact import SPACES, filled
from test_tokens_packing import check_packing

from issuetime.llm import exact_dedup, minhash, mixing, toxicity
from issuetime.llm.queries import tokenizer_path

RUNS = re.compile(r"[^\W_]+")


def fold(doc_id):
    h = xxhash.xxh64_intdigest(b"fold", seed=xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42))
    return (h - (1 << 64) * (h >> 63)) % toxicity.FOLDS


def features(text):
    return {f for w in set(RUNS.findall((text or "").lower())) for f in [w, *("^" + w[:n] for n in (5, 6, 7, 8) if len(w) > n)]}


def regress(x, y, penalised):
    """Logistic regression by the documented steps, on a dense matrix with a last column of ones before the unpenalised ones."""
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, toxicity.STEPS + 1):
        e = (1 / (1 + np.exp(-(x @ w))) - y) / len(y)
        g = x.T @ e
        g[:penalised] += toxicity.PENALTY * w[:penalised]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def plain_chain(docs, labels):
    """docs: (doc_id, text); labels: (doc_id, quality, toxic). Probabilities of (low quality, toxic) of every text."""
    worst = {}
    for d, q, x in labels:
        worst.setdefault(d, []).append((q, x))
    marks = {d: (1 - min(q for q, _ in v if q is not None), max(x for _, x in v if x is not None)) for d, v in worst.items() if d is not None and any(q is not None for q, _ in v) and any(x is not None for _, x in v)}
    train = sorted((d, t) for d, t in docs if d in marks)
    y = np.array([marks[d] for d, _ in train], float)
    found = [features(t) for _, t in train]
    counts = {}
    for row, have in zip(y, found, strict=True):
        for f in have:
            c = counts.setdefault(f, np.zeros(3))
            c += [1, *row]
    chosen = set()
    for i in (1, 2):
        share = y[:, i - 1].sum() / len(y)
        stat = [((c[i] - c[0] * share) ** 2 / (c[0] * share) if share else 0, f) for f, c in counts.items() if c[0] >= toxicity.LEAST_DOCS]
        chosen.update(f for _, f in sorted(stat, key=lambda s: (-s[0], s[1]))[: toxicity.FEATURES])
    names = sorted(chosen)

    def matrix(texts):
        out = np.zeros((len(texts), len(names) + 1))
        for row, text in zip(out, texts, strict=True):
            have, n = features(text), len(set(RUNS.findall((text or "").lower())))
            row[:-1] = [10 / math.sqrt(n + 1) * (f in have) for f in names]
            row[-1] = 1
        return out

    x, every = matrix([t for _, t in train]), matrix([t for _, t in docs])
    folds = np.array([fold(d) for d, _ in train])
    first = 1 / (1 + np.exp(-(every @ regress(x, y[:, 0], len(names)))))
    held = np.zeros(len(train))
    for k in range(toxicity.FOLDS):
        held[folds == k] = 1 / (1 + np.exp(-(x[folds == k] @ regress(x[folds != k], y[folds != k, 0], len(names)))))
    second = regress(np.column_stack([x, held]), y[:, 1], len(names))
    return first, 1 / (1 + np.exp(-(np.column_stack([every, first]) @ second)))


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    return read("documents").where("doc_id % 3 <> 0"), read("labels")


def test_chain_equals_plain(tables):
    docs, labels = tables
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    low, toxic = plain_chain(rows, [tuple(r) for r in labels.collect()])
    want = {d: (a, b) for (d, _), a, b in zip(rows, low, toxic, strict=True)}
    for r in toxicity.toxicity(docs, labels).collect():
        assert (r["p_low_quality"], r["p_toxic"]) == pytest.approx(want[r["doc_id"]], abs=1e-6)


def plain_exact(rows, at):
    best = {}
    for r in rows:
        text = r[at["text"]] or ""
        rank = (-len(text), r[at["doc_id"]] is None, r[at["doc_id"]] or 0)
        key = SPACES.sub("", text)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    return [r for _, r in best.values()]


def plain_near(rows, at):
    sets, parent = [shingles(r[at["text"]]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 4 * min(len(a), len(sets[j])) >= 3 * max(len(a), len(sets[j])) and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, r in enumerate(rows):
        rank = (r[at["doc_id"]] is None, r[at["doc_id"]] or 0, i)
        best[root(i)] = min(best.get(root(i), (rank, r)), (rank, r), key=lambda x: x[0])
    return [r for _, r in best.values()]


def plain_mix(rows, at):
    sized = [(r, len(WORDS.findall(r[at["text"]] or ""))) for r in rows]
    sizes = {}
    for r, n in sized:
        sizes[r[at["source"]]] = sizes.get(r[at["source"]], 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2.0)
    out = []
    for s in names:
        mine = [(hashlib.md5(f"mix:{'' if r[at['doc_id']] is None else r[at['doc_id']]}".encode()).hexdigest(), r, n) for r, n in sized if r[at["source"]] == s and n]
        left = math.floor(targets[s] + 1e-9)
        while mine and left > 0:
            for _, r, n in sorted(mine, key=lambda x: x[0]):
                take, left = min(n, left), left - min(n, left)
                if take == n:
                    out.append(r)
                elif take:
                    end = list(WORDS.finditer(r[at["text"]]))[take - 1].end()
                    out.append(tuple(r[at["text"]][:end] if i == at["text"] else end if i == at.get("n_chars") else x for i, x in enumerate(r)))
    return out


def test_every_stage_equals_its_plain_version(spark, tables, tmp_path, monkeypatch):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, labels = tables
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages, at = dict(corpus_pipeline.STAGES), {c: i for i, c in enumerate(docs.columns)}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in now.collect()]
    _, toxic = plain_chain([(r[0], r[1]) for r in rows], [tuple(r) for r in labels.collect()])
    want = [r for r, p in zip(rows, toxic, strict=True) if p < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(want) < len(rows) / 4
    for name, plain in (("toxicity", None), ("exact_dedup", plain_exact), ("near_dedup", plain_near), ("mixing", plain_mix)):
        want = plain(want, at) if plain else want
        now = stages[name](spark, now, str(tmp_path))
        assert sorted(map(str, map(tuple, now.collect()))) == sorted(map(str, want)), name
    now.write.parquet(str(tmp_path / "mixed"))
    now = spark.read.parquet(str(tmp_path / "mixed"))
    first, tokenizer = now.dropDuplicates(["doc_id"]), Tokenizer.from_file(tokenizer_path())
    check_packing(first, stages["packing"](spark, first, str(tmp_path)), tokenizer)
    packed = stages["packing"](spark, now, str(tmp_path))
    assert packed.groupBy().sum("length").first()[0] == sum(len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in want)


CLASH = "doc_id bigint, text string, source string, n_chars int, _row string, _n string, _own_0 string, _own_1 int, _size string, _digest string, taken int, `a.b` string, row string, best int"


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(40))
    texts = [words, words + " more", words.upper(), words, None, "", "  ", "one two three", "one  two three", "other words here"]
    rows = [(d, t, s, None if t is None else len(t), f"r{i}", f"n{i}", "o", i, "s", None, -i, "dot", "row", i) for i, (d, t, s) in enumerate(zip([7, 5, 5, 7, None, 1, None, 3, 3, None], texts, ["a", None, "a", "a", "b", "b", None, None, "a", "a"], strict=True))]
    docs = spark.createDataFrame(rows, CLASH)
    exact = [tuple(r) for r in exact_dedup.kept_rows(docs).collect()]
    assert all(r in rows for r in exact) and sorted(str(r[1]) for r in exact) == sorted([words, words + " more", words.upper(), "  ", "one  two three", "other words here"])
    near = [tuple(r) for r in minhash.kept_documents(docs).collect()]
    assert all(r in rows for r in near) and sorted(str(r[1]) for r in near if r[0] != 5) == sorted(["None", "", "  ", near[[r[0] for r in near].index(3)][1], "other words here"]) and len(near) == 6
    mixed = [tuple(r) for r in mixing.mixed_documents(docs).collect()]
    given = {s: 0 for s in ("a", "b", None)}
    for r in mixed:
        base = next(x for x in rows if x[4] == r[4])
        assert r[4:] == base[4:] and r[0] == base[0] and r[2] == base[2] and base[1].startswith(r[1]) and r[3] == len(r[1])
        given[r[2]] += len(r[1].split())
    taken = {r["source"]: r["n"] for r in mixing.mix_sources(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    assert given == taken
    spark.createDataFrame([(7, 1, 0), (5, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, docs.where("false")):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count() and (frame is docs) == (now.count() > 0)
