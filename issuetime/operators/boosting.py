"""Boosted regression trees of many training sets at once, by histograms that merge.

Where rounds are many, the rows of a model and head meet as bytes, a byte a feature, in one task that grows all its trees over them, in place.
Models of more than ``WHOLE`` rows and few rounds go without that: every level of a tree is one pass over the rows, a task counts the rows it holds and sums their
residuals by model, node, feature and bin, those of a model meet in partial sums, and its best splits are chosen there. The rules of both are those of
``pyspark.ml``'s GBTRegressor: up to 32 bins a feature, splits by the largest fall of the variance, first tree in full, later ones by the learning rate.
A feature's bins end at quantiles of the model's rows, from merged sketches.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuetime.operators.newton import numbers
from issuetime.operators.ridge import SKETCH

BINS, ROUNDS, DEPTH, RATE = 32, 5, 3, 0.1
#: Passes that cost less than to move each model's rows to a task.
PASSES = 30
#: Rows of a model that one task holds (about 30 bytes each and a few for each feature), and rows that it takes at a time.
WHOLE, CHUNK = 8_000_000, 131_072


def edges(rows: DataFrame, features: int, least: int) -> dict:
    """(medians, ends of bins) by model, along the features ``z`` of the rows, for models of at least ``least`` rows; a feature without values has median 0.

    ``rows``: first, last (the models that a row serves, one after another), z (array of double, null where missing).
    """
    import numpy as np

    at = [0.0, 0.5, *(i / BINS for i in range(1, BINS))]
    parts = rows.groupBy("first", "last").agg(
        F.count(F.lit(1)).alias("n"), *(F.count(F.get("z", F.lit(i))).alias(f"n{i}") for i in range(features)), *(F.kll_sketch_agg_double(F.get("z", F.lit(i)), SKETCH).alias(f"q{i}") for i in range(features))
    )
    each = parts.withColumn("model", F.explode(F.sequence("first", "last"))).groupBy("model").agg(
        F.sum("n").alias("n"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(features)), *(F.kll_merge_agg_double(f"q{i}", SKETCH).alias(f"q{i}") for i in range(features))
    )
    ranks = F.array(*(F.lit(p) for p in at))
    each = each.where(F.col("n") >= least).select("model", *(F.kll_sketch_get_quantile_double(F.when(F.col(f"n{i}") > 0, F.col(f"q{i}")), ranks).alias(f"q{i}") for i in range(features)))
    found = {}
    for r in each.collect():  # some numbers a model
        q = [r[f"q{i}"] for i in range(features)]
        ends = [np.unique(v[2:]) if v else np.zeros(0) for v in q]
        found[r["model"]] = ([v[1] if v else 0.0 for v in q], [np.unique([v[0], *e]) if v and len(e) < BINS - 1 else e for v, e in zip(q, ends, strict=True)])
    return found


class Codes:
    """Places of values among all models' ends of bins, and from these to each model's bins; a missing value has a place of its own, the bin of the median."""

    def __init__(self, edges: dict, features: int) -> None:
        import numpy as np

        self.ends = [np.unique(np.concatenate([np.zeros(0), *(e[i] for _, e in edges.values())])) for i in range(features)]
        self.bins = {m: [np.concatenate([[0], np.cumsum(np.isin(all_, e[i])), [np.searchsorted(e[i], middle[i])]]).astype(np.uint8) for i, all_ in enumerate(self.ends)] for m, (middle, e) in edges.items()}

    def of(self, z):
        import numpy as np

        return np.stack([np.where(np.isnan(z[:, i]), len(e) + 1, np.searchsorted(e, z[:, i])) for i, e in enumerate(self.ends)], axis=1).astype(np.int32)

    def binned(self, model: int, codes):
        import numpy as np

        return np.stack([b[codes[:, i]] for i, b in enumerate(self.bins[model])], axis=1)


def coded(rows: DataFrame, codes: Codes, keep: tuple[str, ...] = ()) -> DataFrame:
    """first, last, y, the places ``c`` of the features z and the numbers ``keep`` (bigint); to be written once, as every level reads them."""

    def said(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            c = codes.of(numbers(batch.column(3))) if batch.num_rows else np.zeros((0, 1), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]).cast(pa.list_(pa.int32())), *batch.columns[4:]], names=["first", "last", "y", "c", *keep])

    return rows.select("first", "last", "y", "z", *keep).mapInArrow(said, ", ".join(["first bigint, last bigint, y array<double>, c array<int>", *(f"`{k}` bigint" for k in keep)]))


def empty(depth: int) -> tuple:
    """(feature or -1, bin, value) by node, numbered as a heap, of a tree not grown yet."""
    import numpy as np

    size = 2 ** (depth + 1) - 1
    return np.full(size, -1, np.int16), np.zeros(size, np.int16), np.full(size, np.nan)


def leaves(tree, binned):
    """The node (numbered as a heap) in which each row ends: a tree is (feature or -1, bin, value) by node."""
    import numpy as np

    feature, cut, _ = tree
    node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for _ in range((len(feature) + 1).bit_length() - 2):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (binned[rows, f] > cut[node]), node)
    return node


def predicted(trees, binned):
    import numpy as np

    out = np.zeros(len(binned))
    if not trees:
        return out
    feature, cut, value = (np.stack(x) for x in zip(*trees, strict=True))
    size, tree, some = feature.shape[1], np.arange(len(trees))[:, None] * feature.shape[1], 2048
    for a in range(0, len(binned), some):
        part = binned[a : a + some]
        rows, node = np.arange(len(part)), np.zeros((len(trees), len(part)), np.int64)
        for _ in range((size + 1).bit_length() - 2):  # all trees at once
            f = feature.ravel()[tree + node]
            node = np.where(f >= 0, 2 * node + 1 + (part[rows, f] > cut.ravel()[tree + node]), node)
        for i, v in enumerate(value.ravel()[tree + node]):
            out[a : a + some] += (RATE if i else 1.0) * v
    return out


def splits(s) -> list[tuple]:
    """(node of the level, feature or -1, bin, value, value of the lower part, of the upper) for the nodes with rows; ``s``: their number and sum along features, (number, sum), nodes, bins."""
    import numpy as np

    nodes = s.shape[2]
    left, whole = s.cumsum(axis=3), s.sum(axis=3, keepdims=True)
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 1] ** 2 / left[:, 0] + right[:, 1] ** 2 / right[:, 0] - whole[:, 1] ** 2 / whole[:, 0]
    gain = np.where((left[:, 0] > 0) & (right[:, 0] > 0), gain, -1.0).transpose(1, 0, 2).reshape(nodes, -1)
    out = []
    for node, k in enumerate(gain.argmax(axis=1)):
        f, cut = divmod(int(k), BINS)
        n, total = whole[f, 0, node, 0], whole[f, 1, node, 0]
        if n > 0:
            # a gain within the rounding of the sums is none
            split = gain[node, k] > 1e-9 * max(1.0, total * total / n)
            out.append((node, f if split else -1, cut, total / n, *(v[f, 1, node, cut] / v[f, 0, node, cut] if split else 0.0 for v in (left, right))))
    return out


def grow(tree, level: int, found) -> None:
    """Put the :func:`splits` of a level into the tree."""
    feature, cut, value = tree
    for n, f, c, v, low, high in found:
        node = 2**level - 1 + n
        feature[node], cut[node], value[node] = f, c, v
        if f >= 0:
            value[2 * node + 1], value[2 * node + 2] = low, high


def joined(c) -> tuple:
    """The bins of several features as one number, as far as few enough numbers arise: these numbers by group and row, how many there are, and (group, stride, bins) by feature."""
    import numpy as np

    n, features = c.shape
    most, sizes, at = 32 if n < 5_000 else 1024 if n < 50_000 else 4096, [], []
    for bins in (c.max(axis=0).astype(int) + 1).tolist():
        g = next((i for i, x in enumerate(sizes) if x * bins <= most), len(sizes))
        sizes[g:] = [1] if g == len(sizes) else sizes[g:]
        at.append((g, sizes[g], bins))
        sizes[g] *= bins
    joints = np.zeros((len(sizes), n), np.uint16)
    for f, (g, stride, _) in enumerate(at):
        joints[g] += c[:, f] * np.uint16(stride)
    return joints, max(sizes), at


def grown(c, y, rounds: int, depth: int, absolute: bool) -> list:
    """Trees for the outcomes ``y`` of the rows with the bins ``c``, all held here."""
    import numpy as np

    n, features = c.shape
    joints, size, place = joined(c)
    trees, so_far, node = [], np.zeros(n), np.zeros(n, np.int16)
    parts = [slice(a, min(a + CHUNK, n)) for a in range(0, n, CHUNK)]
    for turn in range(rounds):
        tree = empty(depth)
        feature, cut, value = tree
        node[:] = 0
        # later residuals of absolute errors are signs: a count of either tells their number and their sum
        t = y >= so_far if absolute and turn else 2 * (y - so_far) if turn else y
        for level in range(depth):
            nodes = 2**level
            block = (nodes + 1) * size  # the last part is of rows whose node is not split
            pos = np.concatenate([np.full(nodes - 1, nodes), np.arange(nodes)]) * size
            sums = np.zeros((len(joints), 2, block))
            for part in parts:
                at = pos[node[part]]
                if absolute and turn:
                    at += t[part] * np.int64(block)
                for s, joint in zip(sums, joints, strict=True):
                    where = at + joint[part]
                    if absolute and turn:
                        s += np.bincount(where, minlength=2 * block).reshape(2, block)
                    else:
                        s += (np.bincount(where, minlength=block), np.bincount(where, t[part], block))
            if absolute and turn:
                sums = np.stack([sums[:, 0] + sums[:, 1], sums[:, 1] - sums[:, 0]], axis=1)
            by_bin, tables = np.zeros((features, 2, nodes, BINS)), sums[:, :, : nodes * size].reshape(-1, 2, nodes, size)
            for f, (g, stride, bins) in enumerate(place):
                by_bin[f, :, :, :bins] = tables[g, :, :, : size // (stride * bins) * stride * bins].reshape(2, nodes, -1, bins, stride).sum(axis=(2, 4))
            grow(tree, level, splits(by_bin))
            # where the rows go on from each node, by the number that tells its feature's bin
            group, onward = np.zeros(2 * nodes - 1, np.int64), np.repeat(np.arange(2 * nodes - 1, dtype=np.int16)[:, None], size, axis=1)
            for k in range(nodes - 1, 2 * nodes - 1):
                if feature[k] >= 0:
                    group[k], stride, bins = place[feature[k]]
                    onward[k] = 2 * k + 1 + (np.arange(size) // stride % bins > cut[k])
            flat, whole = onward.ravel(), joints.ravel()
            for part in parts:
                at = node[part].astype(np.int64)
                where = group[at] * n
                where += np.arange(part.start, part.stop)
                at *= size
                at += whole[where]
                node[part] = flat[at]
        for part in parts:
            so_far[part] += (RATE if turn else 1.0) * value[node[part]]
        trees.append(tree)
    return trees


def fit_boosted(rows: DataFrame, codes: Codes, heads: int, absolute: bool, rounds: int = ROUNDS, depth: int = DEPTH, whole: int | None = None) -> dict:
    """Trees by (model, head) for the outcomes ``y`` (array along the heads, null where not known) of the rows of ``coded``; a model without outcomes has none.

    Models of more than ``whole`` rows go by passes; if that is not given, ``WHOLE`` rows, and all models where the passes are few, as they move no rows.
    The driver holds the trees, some numbers a node.
    """
    whole = whole if whole is not None else WHOLE if rounds * depth > PASSES else 0
    days = rows.groupBy("first", "last").agg(F.count(F.lit(1)).alias("n")).withColumn("model", F.explode(F.sequence("first", "last"))).groupBy("model").agg(F.sum("n").alias("n"))
    n = {r["model"]: r["n"] for r in days.collect() if r["model"] in codes.bins}
    held = {m: k for m, k in n.items() if k <= whole}
    trees = _fit_held(rows, codes, heads, absolute, rounds, depth, held) if held else {}
    return trees | (_fit_by_passes(rows, codes, heads, absolute, rounds, depth, set(n) - set(held)) if len(held) < len(n) else {})


def _fit_held(rows: DataFrame, codes: Codes, heads: int, absolute: bool, rounds: int, depth: int, held: dict) -> dict:
    """:func:`fit_boosted` for the models ``held`` (with their numbers of rows): a task for each model and head."""
    features = len(codes.ends)
    order = [(m, h) for m in sorted(held) for h in range(heads)]
    place = {k: i for i, k in enumerate(order)}

    def blocks(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            first, last, y, c = batch.column(0).to_numpy(), batch.column(1).to_numpy(), numbers(batch.column(2)), numbers(batch.column(3)).astype(np.int32)
            at, bins, outcomes = [], [], []
            for m in range(first.min(), last.max() + 1) if len(first) else ():
                mine = np.flatnonzero((first <= m) & (last >= m)) if m in held else ()
                if not len(mine):
                    continue
                binned = codes.binned(m, c[mine])
                for h in range(heads):
                    t = y[mine, h]
                    known = np.isfinite(t)
                    if known.any():
                        at.append(place[m, h])
                        bins.append(binned[known].tobytes())
                        outcomes.append(t[known].tobytes())
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "bins": pa.array(bins, pa.binary()), "outcomes": pa.array(outcomes, pa.binary())})

    def fitted(batches):
        import numpy as np
        import pyarrow as pa

        mine = {}
        for batch in batches:
            for at, bins, outcomes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if at not in mine:
                    n = held[order[at][0]]
                    mine[at] = [0, np.empty((n, features), np.uint8), np.empty(n)]
                end, c, y = mine[at]
                t = np.frombuffer(outcomes.as_buffer())
                c[end : end + len(t)] = np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, features)
                y[end : end + len(t)] = t
                mine[at][0] += len(t)
        for at, (end, c, y) in mine.items():
            trees = grown(c[:end], y[:end], rounds, depth, absolute)
            yield pa.RecordBatch.from_pydict({"at": pa.array([at] * len(trees), pa.int64()), "turn": pa.array(range(len(trees)), pa.int64()), **{name: pa.array([t[i].tolist() for t in trees], pa.list_(kind)) for i, (name, kind) in enumerate((("f", pa.int16()), ("cut", pa.int16()), ("value", pa.float64())))}})

    met = rows.mapInArrow(blocks, "at bigint, bins binary, outcomes binary").repartitionById(len(order), F.col("at").cast("int"))
    trees = {}
    for r in sorted(met.mapInArrow(fitted, "at bigint, turn bigint, f array<smallint>, cut array<smallint>, value array<double>").collect(), key=lambda r: (r["at"], r["turn"])):
        tree = empty(depth)
        for part, numbers_ in zip(tree, (r["f"], r["cut"], r["value"]), strict=True):
            part[:] = numbers_
        trees.setdefault(order[r["at"]], []).append(tree)
    return trees


def _fit_by_passes(rows: DataFrame, codes: Codes, heads: int, absolute: bool, rounds: int, depth: int, models: set) -> dict:
    """:func:`fit_boosted` for some models of any number of rows; tasks hold one histogram for each of them that their rows serve."""
    import numpy as np

    features = len(codes.ends)
    trees = {(m, h): [] for m in models for h in range(heads)}

    def histograms(batches):
        import pyarrow as pa

        sums, least = {}, 2**level - 1
        for batch in batches:
            first, last, y, c = batch.column(0).to_numpy(), batch.column(1).to_numpy(), numbers(batch.column(2)), numbers(batch.column(3)).astype(np.int32)
            for m in range(first.min(), last.max() + 1) if len(first) else ():
                mine = np.flatnonzero((first <= m) & (last >= m)) if m in models else ()
                if not len(mine):
                    continue
                binned = codes.binned(m, c[mine])
                for h in range(heads):
                    if (m, h) not in trees:
                        continue
                    known = np.isfinite(y[mine, h])
                    b, t = binned[known], y[mine, h][known]
                    before = trees[m, h]
                    if before:
                        apart = t - predicted(before, b)
                        t = np.where(apart < 0, -1.0, 1.0) if absolute else 2 * apart
                    node = leaves(growing[m, h], b) - least
                    here = node >= 0
                    place, t, b = node[here] * BINS, t[here], b[here]
                    s = sums.setdefault((m, h), np.zeros((features, 2, 2**level * BINS)))
                    for f in range(features):
                        at = place + b[:, f]
                        s[f, 0] += np.bincount(at, minlength=2**level * BINS)
                        s[f, 1] += np.bincount(at, t, 2**level * BINS)
        yield pa.RecordBatch.from_pydict({"m": pa.array([k[0] for k in sums], pa.int64()), "h": pa.array([k[1] for k in sums], pa.int64()), "s": pa.array([v.ravel().tolist() for v in sums.values()], pa.list_(pa.float64()))})

    def best(frames):
        for frame in frames:
            out = [(m, h, *x) for m, h, s in zip(frame["m"], frame["h"], frame["s"], strict=True) for x in splits(np.asarray(s).reshape(features, 2, 2**level, BINS))]
            yield type(frame)(out, columns=["m", "h", "node", "f", "cut", "value", "low", "high"])

    for _ in range(rounds):
        growing = {k: empty(depth) for k in trees}
        for level in range(depth):
            total = rows.mapInArrow(histograms, "m bigint, h bigint, s array<double>").groupBy("m", "h").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
            for r in total.mapInPandas(best, "m bigint, h bigint, node bigint, f bigint, cut bigint, value double, low double, high double").collect():  # a row for each model and node
                grow(growing[r["m"], r["h"]], level, [tuple(r)[2:]])
        # a model without a value at the root has met no row with its outcome
        trees = {k: [*trees[k], t] for k, t in growing.items() if np.isfinite(t[2][0])}
    return trees


def predict_boosted(rows: DataFrame, codes: Codes, trees: dict, heads: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the prediction of every head of the rows (model, z), null without a model."""

    def said(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            z, out = numbers(batch.column(1)), np.full((batch.num_rows, len(heads)), np.nan)
            model, c = batch.column(0).to_numpy(zero_copy_only=False), codes.of(z) if batch.num_rows else None
            for m in np.unique(model):
                if m in codes.bins:
                    mine = np.flatnonzero(model == m)
                    binned = codes.binned(m, c[mine])
                    for h in range(len(heads)):
                        if (m, h) in trees:
                            out[mine, h] = predicted(trees[m, h], binned)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(o, from_pandas=True) for o in out.T)], names=[*keep, *heads])

    types = dict(rows.dtypes)
    return rows.select("model", "z", *keep).mapInArrow(said, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{h}` double" for h in heads)]))
