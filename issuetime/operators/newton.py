"""Softmax models of many training sets at once, by Newton steps from sums of gradients and second derivatives.

Every step is one pass over the rows for all models: a task adds up the derivatives of the rows it holds, those of a model meet in partial sums, and
the driver solves one small system for each model. No rows are gathered. A model gives class k the weight exp(theta . phi_k), where phi_k are
the row's features for that class; what they are makes it a multinomial model, a temperature with biases, or a stack of forecasts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, CLOSE, LARGEST_STEP, FLUSH = 40, 1e-7, 2.0, 512


def multinomial(classes: int, features: int):
    """Every class has an intercept and a weight of each feature. Returns the function to class features, and the penalty's factors."""
    import numpy as np

    width = features + 1

    def design(x):
        out = np.zeros((len(x), classes, classes * width))
        for k in range(classes):
            out[:, k, k * width] = 1
            out[:, k, k * width + 1 : (k + 1) * width] = x
        return out

    def summed(x, y, w, theta):
        """``derivatives`` by the classes' blocks, without the zeros between them."""
        full = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        score = full @ theta.reshape(classes, width).T
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        apart = p * w[:, None]
        apart[np.arange(len(x)), y] -= w
        second = np.empty((classes, width, classes, width))
        for k in range(classes):
            for m in range(k + 1):
                block = (full * (w * p[:, k] * ((k == m) - p[:, m]))[:, None]).T @ full
                second[k, :, m], second[m, :, k] = block, block
        return (apart.T @ full).ravel(), second.reshape(classes * width, classes * width)

    design.derivatives = summed
    return design, np.tile([0.0] + [1.0] * features, classes)


def stack(classes: int, bases: int = 1):
    """One weight for the logarithms of each of ``bases`` forecasts and one bias for each class; with one forecast, a temperature and biases."""
    import numpy as np

    def design(x):
        out = np.zeros((len(x), classes, bases + classes))
        for k in range(classes):
            out[:, k, :bases] = x[:, k::classes]
            out[:, k, bases + k] = 1
        return out

    return design, np.array([1.0] * bases + [0.0] * classes)


def chances(design: Callable, x, theta):
    """Probabilities of the classes, (rows, classes)."""
    import numpy as np

    score = design(x) @ theta
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def derivatives(design: Callable, x, y, w, theta):
    """Gradient and second derivatives of the weighted log loss."""
    import numpy as np

    if hasattr(design, "derivatives"):
        return design.derivatives(x, y, w, theta)

    size = len(theta)
    gradient, second = np.zeros(size), np.zeros((size, size))
    for i in range(0, len(x), 2048):
        phi, p = design(x[i : i + 2048]), chances(design, x[i : i + 2048], theta)
        weight, mean = w[i : i + 2048], np.einsum("nk,nkq->nq", p, phi)
        gradient += weight @ (mean - phi[np.arange(len(p)), y[i : i + 2048]])
        flat = phi.reshape(-1, size)
        second += flat.T @ (flat * (p * weight[:, None]).reshape(-1, 1)) - mean.T @ (mean * weight[:, None])
    return gradient, second


def numbers(column):
    """A batch's arrays of equal length as rows of doubles, null as NaN."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def rows_of(column):
    """Each different string of a batch's column with the places of its rows."""
    import numpy as np

    coded = column.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    return [(k, order[a:b]) for k, a, b in zip(coded.dictionary.to_pylist(), ends[:-1], ends[1:], strict=True)]


def fit_softmax(rows: DataFrame, key: str, design: Callable, factors, penalty: float, rounds: int = ROUNDS) -> dict:
    """Parameters by ``key`` that minimise the mean weighted log loss plus ``penalty`` / 2 times the factored squares.

    ``rows``: key (string), z (array of features), y (class from 0, int), w (weight), written once, as every step reads them. The driver holds the
    parameters of all keys, tasks the sums of at most ``FLUSH`` keys at a time.
    """
    weights = {r[key]: r["w"] for r in rows.groupBy(key).agg(F.sum("w").alias("w")).collect()}  # a number a model

    def parts(batch, open_):
        x, y, w = numbers(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for k, mine in rows_of(batch.column(0)):
            if k in open_:
                yield k, x[mine], y[mine], w[mine]

    needed = lambda open_: rows.where(F.col(key).isin(*open_) if len(open_) < 50 else F.lit(True)).select(key, "z", "y", "w")
    return _steps(weights, needed, parts, design, factors, penalty, rounds)


def fit_served(rows: DataFrame, design: Callable, factors, penalty: float, scales: dict | None = None, least: int = 1, rounds: int = ROUNDS) -> dict:
    """As ``fit_softmax`` for models named by ``key`` and a number, of the rows that serve them; a row is read once, however many models it serves.

    ``rows``: key (string), first, last (numbers of the models that the row serves, one after another), z, y, w, written once. ``scales``: centers and widths
    by model, if z are to be scaled as by ``ridge.scaled``. Models of fewer than ``least`` rows or of one class are not fitted. Rows without y serve none.
    """
    import numpy as np

    rows = rows.where("y is not null")
    spans = rows.groupBy("key", "first", "last", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    models = spans.withColumn("key", F.explode(F.transform(F.sequence("first", "last"), lambda d: F.concat(F.col("key"), d.cast("string"))))).groupBy("key").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count_distinct("y").alias("classes"))
    weights = {r["key"]: r["w"] for r in models.where(f"n >= {least} and classes > 1").collect()}  # a number a model
    scales = None if scales is None else {k: tuple(np.array(v, float) for v in scales[k]) for k in weights}

    def parts(batch, open_):
        first, last, x, y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy(), numbers(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy()
        if scales is not None:
            x = np.where(np.isfinite(x), x, np.nan)
        for key, of_key in rows_of(batch.column(0)):
            since, until = first[of_key], last[of_key]
            for model in range(since.min(), until.max() + 1):
                k = f"{key}{model}"
                if k in open_:
                    mine = of_key[(since <= model) & (until >= model)]
                    z = x[mine] if scales is None else np.clip(np.nan_to_num((x[mine] - scales[k][0]) / scales[k][1], nan=0.0), -4.0, 4.0)
                    if len(mine):
                        yield k, z, y[mine], w[mine]

    return _steps(weights, lambda open_: rows.select("key", "first", "last", "z", "y", "w"), parts, design, factors, penalty, rounds)


def _steps(weights: dict, needed: Callable, parts: Callable, design: Callable, factors, penalty: float, rounds: int) -> dict:
    """Newton steps of the models of ``weights``: ``needed(open)`` are the rows of a step, ``parts(batch, open)`` a batch's rows by model."""
    import numpy as np

    size = len(factors)
    theta, open_ = {k: np.zeros(size) for k in weights}, set(weights)

    def summed(batches):
        import pyarrow as pa

        sums = {}

        def table():
            return pa.RecordBatch.from_pydict({"k": list(sums), "s": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))}, schema=pa.schema([("k", pa.string()), ("s", pa.list_(pa.float64()))]))

        for batch in batches:
            for k, x, y, w in parts(batch, now):
                g, h = derivatives(design, x, y, w, now[k])
                sums[k] = sums.get(k, 0) + np.concatenate([g, h.ravel()])
            if len(sums) > FLUSH:
                yield table()
                sums.clear()
        yield table()

    for _ in range(rounds):
        if not open_:
            break
        now = {k: theta[k] for k in open_}
        total = needed(open_).mapInArrow(summed, "k string, s array<double>")
        total = total.select("k", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))  # as long as a model's parameters
        for r in total.collect():
            k, s = r["k"], np.array([v["v"] for v in r["s"]])
            ridge = penalty * factors * weights[k]
            step = np.linalg.solve(s[size:].reshape(size, size) + np.diag(ridge) + 1e-9 * weights[k] * np.eye(size), s[:size] + ridge * theta[k])
            step *= min(1.0, LARGEST_STEP / max(np.abs(step).max(), 1e-300))
            theta[k] = theta[k] - step
            if np.abs(step).max() < CLOSE:
                open_.discard(k)
    return theta


def predict_softmax(rows: DataFrame, key: str, design: Callable, theta: dict, names: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the chances of the classes under ``names`` of every row (key, z); null for keys without a model."""
    import numpy as np

    def said(batches):
        import pyarrow as pa

        for batch in batches:
            x, out = numbers(batch.column(1)), np.full((batch.num_rows, len(names)), np.nan)
            for k, mine in rows_of(batch.column(0)):
                if k in theta:
                    out[mine] = chances(design, x[mine], theta[k])
            columns = [batch.column(i + 2) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, from_pandas=True) for c in out.T)], names=[*keep, *names])

    types = dict(rows.dtypes)
    return rows.select(key, "z", *keep).mapInArrow(said, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{n} double" for n in names)]))
