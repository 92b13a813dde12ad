"""Random forests of many training sets at once, by histograms that merge.

Every level of all trees is one pass over the rows for all models: a task counts the rows it holds by model, tree, node, feature and bin, those of a
model's tree meet in partial sums, and its best splits are chosen there. No rows are gathered or repeated. The rules are those of ``pyspark.ml``'s
forests: rows drawn with replacement (or all of them), a third or the root of the features for each node, up to 32 bins a feature, splits by the
largest fall of the Gini impurity or the variance. Draws come from hashes of a row's key, so they do not hang on how rows are dealt.
Bins and codes of rows are those of ``operators.boosting``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuetime.operators.boosting import BINS, Codes
from issuetime.operators.newton import numbers

#: Seed of the draws, and one more than the most times that a tree draws a row (16 times or more has a chance of 2e-14).
SEED, DRAWS = 7, 16


def drawn(keys, trees: int):
    """How often each tree draws the rows of these keys (int64): Poisson numbers of mean 1, by row and tree."""
    import math

    import numpy as np

    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] + (np.arange(trees, dtype=np.uint64) + np.uint64(1 + SEED * 1000)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(DRAWS)])
    return np.searchsorted(upto, (h >> np.uint64(11)).astype(float) * 2.0**-53, side="right")


def chosen(model: int, tree: int, level: int, features: int, k: int):
    """The features that each node of a level may split by."""
    import numpy as np

    return np.argsort(np.random.default_rng([SEED, model % 2**32, tree, level]).random((2**level, features)), axis=1)[:, :k]


def ends(feature, cut, binned, levels: int):
    """The node (numbered as a heap) that each row has reached after so many levels of a tree."""
    import numpy as np

    flat, base = binned.ravel(), np.arange(len(binned)) * binned.shape[1]
    node = np.zeros(len(binned), np.int64)
    for _ in range(levels):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (flat[base + np.maximum(f, 0)] > cut[node]), node)
    return node


def _served(batches, codes: Codes, models):
    """(model, codes of its bins, y, keys) of the rows of each batch with a known first outcome, model by model."""
    import numpy as np

    for batch in batches:
        first, last, y, c, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy(), numbers(batch.column(2)), numbers(batch.column(3)).astype(np.int32), batch.column(4).to_numpy()
        known = np.isfinite(y[:, 0]) if len(first) else np.zeros(0, bool)
        for m in range(first.min(), last.max() + 1) if len(first) else ():
            mine = np.flatnonzero((first <= m) & (last >= m) & known) if m in models else ()
            if len(mine):
                yield m, codes.binned(m, c[mine]), y[mine], keys[mine]


def _totals(rows: DataFrame, summed) -> DataFrame:
    """m, t and the sum ``s`` of the vectors that ``summed`` (batches -> {(m, t): numbers}) gives for every task."""

    def said(batches):
        import numpy as np
        import pyarrow as pa

        for k, v in summed(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([k[0]], pa.int64()), pa.array([k[1]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(np.ascontiguousarray(v, float).ravel()))], names=["m", "t", "s"])

    return rows.mapInArrow(said, "m bigint, t bigint, s array<double>").groupBy("m", "t").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))


def fit_forest(rows: DataFrame, codes: Codes, trees: int, depth: int, least: int, classes: dict | int = 0, bootstrap: bool = True) -> dict:
    """(features, cuts, values) by model, each along its trees and their nodes; a model without outcomes has none.

    ``rows``: first, last, y (the outcome first, null where not known), c (see ``boosting.coded``), key (bigint). ``classes``: 0 to fit the outcome's mean, or the
    number of classes of an outcome that is one (0, 1, ...), or for every model its classes' weights; a value is the mean or the classes' shares. Nodes hold ``least``
    drawn rows at least. The driver holds the trees, some numbers a node; tasks hold one histogram for each tree that their rows serve.
    """
    import numpy as np

    features, size = len(codes.ends), 2 ** (depth + 1) - 1
    k = -(-features // 3) if not classes else int(np.ceil(np.sqrt(features)))
    weights = classes if isinstance(classes, dict) else {m: np.ones(classes) for m in codes.bins} if classes else {}
    kinds = max((len(w) for w in weights.values()), default=0)
    slots, models = kinds or 2, [m for m in codes.bins if not classes or m in weights]
    grown = {m: (np.full((trees, size), -1, np.int64), np.zeros((trees, size), np.int64), np.full((trees, size, kinds or 1), np.nan)) for m in models}

    def histograms(batches):
        sums, picked, width = {}, {}, 2**level
        for m, binned, y, keys in _served(batches, codes, grown):
            often = drawn(keys, trees) if bootstrap else None
            for t in range(trees):
                node = ends(grown[m][0][t], grown[m][1][t], binned, level) - (width - 1)
                here = np.flatnonzero((node >= 0) & (often[:, t] > 0) if bootstrap else node >= 0)
                if not len(here):
                    continue
                if (m, t) not in sums:
                    sums[m, t], picked[m, t] = np.zeros((width * k * BINS, slots)), chosen(m, t, level, features, k)
                node = node[here, None]
                place = ((node * k + np.arange(k)) * BINS + binned[here[:, None], picked[m, t][node[:, 0]]]).ravel()
                times = np.repeat(often[here, t], k).astype(float) if bootstrap else np.ones(len(place))
                value = np.repeat(y[here, 0], k)
                if kinds:
                    sums[m, t] += np.bincount(place * slots + value.astype(np.int64), times, width * k * BINS * slots).reshape(-1, slots)
                else:
                    sums[m, t][:, 0] += np.bincount(place, times, width * k * BINS)
                    sums[m, t][:, 1] += np.bincount(place, times * value, width * k * BINS)
        return sums

    def best(frames):
        for frame in frames:
            out = []
            for m, t, s in zip(frame["m"], frame["t"], frame["s"], strict=True):
                s = np.asarray(s).reshape(2**level, k, BINS, slots)
                raw = s.sum(axis=3) if kinds else s[..., 0]
                s = s * weights[m] if kinds else s
                left, whole, rows_left = s.cumsum(axis=2), s.sum(axis=2, keepdims=True), raw.cumsum(axis=2)
                right, rows_right = whole - left, raw.sum(axis=2, keepdims=True) - rows_left
                held = lambda x: x.sum(axis=3) if kinds else x[..., 0]
                # what a part adds to the fit: its rows' purity, or their sum's square by their number
                pure = lambda x: ((x**2).sum(axis=3) if kinds else x[..., 1] ** 2) / held(x)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = (pure(left) + pure(right) - pure(whole)) / held(whole)
                    scale = pure(whole) / held(whole)
                gain = np.where((rows_left >= max(least, 1)) & (rows_right >= max(least, 1)), gain, -1.0)
                features_of = chosen(m, t, level, features, k)
                share = lambda x: (x / x.sum() if kinds else x[1:] / x[0]).tolist()
                for node in np.flatnonzero(raw[:, 0].sum(axis=1) > 0):
                    at, cut = divmod(int(gain[node].argmax()), BINS)
                    # a gain within the rounding of the sums is none
                    split = gain[node, at, cut] > 1e-9 * max(1e-9, scale[node, 0, 0])
                    low, high = (share(x[node, at, cut]) for x in (left, right)) if split else ([], [])
                    out.append((m, t, node, int(features_of[node, at]) if split else -1, cut, share(whole[node, 0, 0]), low, high))
            yield type(frame)(out, columns=["m", "t", "node", "f", "cut", "value", "low", "high"])

    for level in range(depth):
        for r in _totals(rows, histograms).mapInPandas(best, "m bigint, t bigint, node bigint, f bigint, cut bigint, value array<double>, low array<double>, high array<double>").collect():  # a row for each node
            (feature, cut, value), t, node = grown[r["m"]], r["t"], 2**level - 1 + r["node"]
            feature[t, node], cut[t, node], value[t, node] = r["f"], r["cut"], r["value"]
            if r["f"] >= 0:
                value[t, 2 * node + 1], value[t, 2 * node + 2] = r["low"], r["high"]
    for feature, _, value in grown.values() if kinds else ():
        for node in range(size // 2 - 1, -1, -1):
            # leaves that say one class are their parent, as in ``pyspark.ml``
            low, high = 2 * node + 1, 2 * node + 2
            feature[(feature[:, low] < 0) & (feature[:, high] < 0) & (value[:, low].argmax(axis=1) == value[:, high].argmax(axis=1)), node] = -1
    return {m: v for m, v in grown.items() if np.isfinite(v[2][:, 0, 0]).any()}


def leaf_means(rows: DataFrame, codes: Codes, forest: dict, outcomes: int) -> dict:
    """The forest with the means of the rows' ``outcomes`` after the first one, over all rows of a leaf, as its leaves' values."""
    import numpy as np

    def summed(batches):
        sums = {}
        for m, binned, y, _ in _served(batches, codes, forest):
            feature, cut, _ = forest[m]
            for t in range(len(feature)):
                node, size = ends(feature[t], cut[t], binned, depth), feature.shape[1]
                mine = sums.setdefault((m, t), np.zeros((size, 1 + outcomes)))
                mine += np.stack([np.bincount(node, w, size) for w in (None, *y[:, 1 : 1 + outcomes].T)], axis=1)
        return sums

    depth = max((v[0].shape[1] + 1 for v in forest.values()), default=2).bit_length() - 2
    out = {m: (f, c, np.full((*f.shape, outcomes), np.nan)) for m, (f, c, _) in forest.items()}
    for r in _totals(rows, summed).toLocalIterator():  # some numbers a leaf
        s = np.asarray(r["s"]).reshape(-1, 1 + outcomes)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[r["m"]][2][r["t"]] = s[:, 1:] / s[:, :1]
    return out


def predict_forest(rows: DataFrame, codes: Codes, forest: dict, names: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and ``names`` (the values' means over the trees) of the rows (model, z), null without a model."""

    def said(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            z, out = numbers(batch.column(1)), np.full((batch.num_rows, len(names)), np.nan)
            model, c = batch.column(0).to_numpy(zero_copy_only=False), codes.of(z) if batch.num_rows else None
            for m in np.unique(model):
                if m in forest:
                    mine, (feature, cut, value) = np.flatnonzero(model == m), forest[m]
                    binned, depth = codes.binned(m, c[mine]), (feature.shape[1] + 1).bit_length() - 2
                    out[mine] = np.mean([v[ends(f, k, binned, depth)] for f, k, v in zip(feature, cut, value, strict=True)], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(o, from_pandas=True) for o in out.T)], names=[*keep, *names])

    types = dict(rows.dtypes)
    return rows.select("model", "z", *keep).mapInArrow(said, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{n}` double" for n in names)]))
