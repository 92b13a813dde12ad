"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another, low quality before toxic, which is all that the labels tell: each model sees a text's features and the probabilities of the categories before
it. While training, those probabilities are out of fold, from models that have not seen the row, so that a later model learns from
estimates as good as it gets when scoring. Models are fitted on a bounded sample of labelled rows; every document is scored.

A text's features are its distinct words and the beginnings of longer words (abuse is often an inflected or compounded stem).
The features that tell a category best (chi-square over the sample) make its linear model. Each weighs a text by the inverse
root of its number of words, so that long clean texts do not gather weight by their length.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuetime.llm.common import stored
from issuetime.llm.tokens import blocks

CATEGORIES = ("low_quality", "toxic")
TRAIN_ROWS, FOLDS, FEATURES, LEAST_DOCS, PENALTY, STEPS, THRESHOLD = 20_000, 3, 300, 3, 1e-4, 200, 0.4
BEGINNINGS = (5, 6, 7, 8)
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters and digits; null counts as empty."""
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


class Numbering:
    """Numbers of a text's chosen features, with those of each word kept."""

    def __init__(self, numbers: dict[str, int], limit: int = 100_000) -> None:
        self.numbers, self.limit, self.known = numbers, limit, {}

    def of(self, text: str | None) -> tuple[list[int], float]:
        """The numbers in ascending order, and what each of them weighs."""
        found, known, mine = set(), self.known, words(text)
        if len(known) > self.limit:
            known.clear()
        for w in mine:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = tuple(i for i in map(self.numbers.get, word_features(w)) if i is not None)
            found.update(ids)
        return sorted(found), 10 / math.sqrt(len(mine) + 1)


class Chain(NamedTuple):
    """A fitted chain: feature numbers, and per category its weights, intercept and weights of earlier categories."""

    numbers: dict
    models: list
    categories: tuple

    def probabilities(self, docs: DataFrame, keep: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
        """The columns ``keep`` of ``docs`` with p_<category> of every category; 0 without models."""
        numbers, models, types = self.numbers, self.models, dict(docs.dtypes)
        names = [f"p_{c}" for c in self.categories]
        if not models:
            return docs.select(*keep, *(F.lit(0.0).alias(n) for n in names))

        def scored(batches):
            import numpy as np
            import pyarrow as pa

            numbering, weights = Numbering(numbers), np.array([m[0] for m in models])
            for batch in batches:
                out = [[] for _ in models]
                for (texts,) in blocks([batch], (text_col,), text_col):
                    for text in texts:
                        ids, weight = numbering.of(text)
                        sums, before = weights[:, ids].sum(axis=1) * weight, []
                        for s, (_, intercept, earlier) in zip(sums, models, strict=True):
                            before.append(float(_sigmoid(np.array(s + intercept + sum(a * b for a, b in zip(earlier, before, strict=True))))))
                        for column, value in zip(out, before, strict=True):
                            column.append(value)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.float64()) for c in out)], names=[*keep, *names])

        columns = list(dict.fromkeys([*keep, text_col]))
        return docs.select(*columns).mapInArrow(scored, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{n} double" for n in names)]))


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _linear(rows, extra, y, n: int):
    """Logistic regression by full gradients with adaptive steps. ``rows``: (row, feature, value) of the sparse part;
    ``extra``: dense columns. Returns weights, intercept, weights of the dense columns."""
    import numpy as np

    at, feature, value = rows
    w, m, v = (np.zeros(n + 1 + extra.shape[1]) for _ in range(3))
    for t in range(1, STEPS + 1):
        x = np.bincount(at, weights=w[feature] * value, minlength=len(y)) + w[n] + extra @ w[n + 1 :]
        error = (_sigmoid(x) - y) / max(1, len(y))
        g = np.concatenate([np.bincount(feature, weights=error[at] * value, minlength=n) + PENALTY * w[:n], [error.sum()], error @ extra])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:n], float(w[n]), w[n + 1 :].tolist()


def labelled(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """doc_id, text, low_quality, toxic of at most ``train_rows`` labelled documents, chosen by the hash of their id; of rows that share an id
    the one with the least text, so that the bound is one of rows."""
    sure = labels.groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic")).dropna()
    some = sure.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most train_rows small rows
    return found.groupBy("doc_id", "low_quality", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "low_quality", "toxic")


def telling_features(rows: DataFrame, categories: tuple, least_docs: int, n: int) -> list[str]:
    """For each category the ``n`` features with the highest chi-square, counted over all of ``rows`` before they meet."""
    k = len(categories)

    def counted(batches):
        from collections import Counter

        import pyarrow as pa

        counts = [Counter() for _ in range(k + 1)]
        for batch in batches:
            marks = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in categories]
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                found = {f for w in words(text) for f in word_features(w)}
                counts[0].update(found)
                for c, mark in zip(counts[1:], marks, strict=True):
                    if mark[i]:
                        c.update(found)
        names = list(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)], names=["f", *(f"n{i}" for i in range(k + 1))])

    all_, *positive = rows.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in categories)).first()
    sums = [F.sum(f"n{i}").cast("double").alias(f"n{i}") for i in range(k + 1)]
    table = stored(rows.mapInArrow(counted, ", ".join(["f string", *(f"n{i} bigint" for i in range(k + 1))])).groupBy("f").agg(*sums).where(F.col("n0") >= least_docs), "features")
    out: dict[str, None] = {}
    for i, p in enumerate(positive, 1):
        expected = F.col("n0") * F.lit(p / max(1, all_))
        best = table.orderBy(F.desc(F.try_divide(F.pow(F.col(f"n{i}") - expected, 2), expected)), "f").limit(n)
        out.update(dict.fromkeys(r["f"] for r in best.select("f").collect()))  # at most n rows
    return sorted(out)


def fit_chain(rows: DataFrame, categories: tuple = CATEGORIES, folds: int = FOLDS, least_docs: int = LEAST_DOCS, n: int = FEATURES) -> Chain:
    """Fit the chain on rows with doc_id, text and a 0/1 column per category (bounded by the caller)."""
    import numpy as np

    rows = stored(rows, "labelled")
    numbers = {f: i for i, f in enumerate(telling_features(rows, categories, least_docs, n))}
    if not numbers:
        return Chain({}, [], tuple(categories))

    def numbered(batches):
        import pyarrow as pa

        numbering = Numbering(numbers)
        for batch in batches:
            found = [numbering.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, 3 + len(categories))), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found])], names=["doc_id", *categories, "fold", "ids", "weight"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds))
    schema = ", ".join(["doc_id bigint", *(f"{c} int" for c in categories), "fold bigint", "ids array<int>", "weight double"])
    sample = rows.select("doc_id", "text", *categories, fold.alias("fold")).mapInArrow(numbered, schema).toPandas().sort_values("doc_id")  # bounded sample of numbers
    sizes = sample["ids"].map(len).to_numpy()
    at = np.repeat(np.arange(len(sample)), sizes)
    feature = np.concatenate([*sample["ids"], np.zeros(0, np.int64)]).astype(np.int64)
    value, folded = np.repeat(sample["weight"].to_numpy(), sizes), sample["fold"].to_numpy()
    models, extra = [], np.zeros((len(sample), 0))
    for i, name in enumerate(categories):
        y = sample[name].to_numpy(float)
        models.append(_linear((at, feature, value), extra, y, len(numbers)))
        if i + 1 < len(categories):
            p = np.zeros(len(sample))
            for k in range(folds):
                own = folded == k
                place, inside = np.cumsum(~own) - 1, ~own[at]
                w, intercept, earlier = _linear((place[at[inside]], feature[inside], value[inside]), extra[~own], y[~own], len(numbers))
                x = np.bincount(at, weights=w[feature] * value, minlength=len(y)) + intercept + extra @ np.array(earlier)
                p[own] = _sigmoid(x)[own]
            extra = np.column_stack([extra, p])
    return Chain(numbers, models, tuple(categories))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic of every row of ``docs`` (columns read: doc_id, text).

    toxic: p_toxic is at least ``threshold``. ``labels``: doc_id, quality, toxic (0/1; rows with nulls are not learned from; of
    repeated ids the worst counts). A null or empty text gets the models' base rates; without labelled rows all
    probabilities are 0 and nothing is toxic; an empty table gives no rows. Nothing but the bounded sample is shuffled.
    """
    chain = fit_chain(labelled(docs, labels, train_rows))
    return chain.probabilities(docs.select("doc_id", "text")).withColumn("toxic", F.col("p_toxic") >= threshold)


def clean_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their own columns whatever their names, that the chain does not reject.

    Null and empty texts have the models' base rates, far below the threshold, and stay; so does every row without labels to
    learn from. Repeated rows and rows without doc_id are scored each; an empty table gives no rows.
    """
    chain = fit_chain(labelled(docs, labels, train_rows))
    inner = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{k}`").alias(v) for k, v in inner.items()))
    scored = chain.probabilities(renamed, tuple(inner.values()), inner["text"])
    return scored.where(F.col("p_toxic") < threshold).select(*(F.col(v).alias(k) for k, v in inner.items()))
