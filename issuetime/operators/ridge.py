"""Ridge models of many features, one for each key and training set, from sums that merge.

A row serves several models (the days after it, or the folds it is not in). Quartiles come from mergeable quantile sketches, and a model
from the sums of all products of its scaled columns, so no training rows are gathered: rows that serve the same models are sketched
together first, then meet the models' scales in groups of bounded size, of which each gives one vector of products for each model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that a quantile sketch keeps: up to so many, quartiles are exact; past them their ranks are off by about 2 / SKETCH at most.
SKETCH = 4096
#: Rows of a group that meets the scales of its models at once, about.
GROUP = 50_000


def finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double"))


def exact_quantiles(rows: DataFrame, by: list[str], serves: str, x: list[str], each: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """``by``, model, c (place in ``x``), p (place in ``levels``) and q: the value whose place among the model's finite ones is the level's, counted out.

    ``each``: models with a sketch ``q{i}`` and a number of values ``n{i}`` for every column. The sketch's values some ranks to both sides of the level bracket the
    answer: what lies under the bracket is counted, and only what lies in it is counted by value. A bracket that misses the place, which is possible as
    sketches are random, gives way to the whole range.
    """
    at = lambda i, p: F.kll_sketch_get_quantile_double(F.when(F.col(f"n{i}") > 0, F.col(f"q{i}")), F.lit(min(max(p, 0.0), 1.0)))
    side = 16.0 / SKETCH
    asked = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(j).alias("p"), F.greatest(F.lit(1.0), F.ceil(F.col(f"n{i}") * p)).cast("long").alias("place"), at(i, p - side).alias("lo"), at(i, p + side).alias("hi")) for i in range(len(x)) for j, p in enumerate(levels)))
    places = each.select(*by, "model", F.inline(asked)).where("lo is not null")
    values = rows.select(*by, serves, F.posexplode(F.array(*(finite(c) for c in x))).alias("c", "v")).where("v is not null")
    sets = rows.select(*by, serves).distinct().withColumn("model", F.explode(serves))

    def counted(places: DataFrame) -> DataFrame:
        asks = sets.join(places, [*by, "model"]).groupBy(*by, serves, "c").agg(F.collect_list(F.struct("model", "p", "place", "lo", "hi")).alias("_asks"))  # one for each model and level
        met = values.join(asks, [*by, serves, "c"]).withColumn("_a", F.explode(F.filter("_asks", lambda a: F.col("v") <= a["hi"])))
        met = met.select(*by, "c", "_a.model", "_a.p", "_a.place", F.when(F.col("v") >= F.col("_a.lo"), F.col("v")).alias("v"))  # null: under the bracket
        group = [*by, "model", "c", "p", "place"]
        so_far = Window.partitionBy(*group).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        found = met.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(so_far))
        first = F.min_by(F.struct("v"), F.when(F.col("upto") >= F.col("place"), F.col("upto")))
        return found.groupBy(*group).agg(first.alias("q")).withColumn("q", F.col("q.v"))

    found = counted(places).persist()
    missed = found.where("q is null")
    if not missed.isEmpty():
        wide = places.join(missed.select(*by, "model", "c", "p"), [*by, "model", "c", "p"], "left_semi").withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf"))})
        return found.where("q is not null").unionByName(counted(wide)).drop("place")
    return found.drop("place")


def sketched(rows: DataFrame, by: list[str], serves: str, x: list[str]) -> DataFrame:
    """``by``, model, n and for every column its number of finite values ``n{i}`` and their sketch ``q{i}``, for every model that rows serve."""
    parts = rows.groupBy(*by, serves).agg(
        F.count(F.lit(1)).alias("n"), *(F.count(finite(c)).alias(f"n{i}") for i, c in enumerate(x)), *(F.kll_sketch_agg_double(finite(c), SKETCH).alias(f"q{i}") for i, c in enumerate(x))
    )
    return parts.withColumn("model", F.explode(serves)).groupBy(*by, "model").agg(
        F.sum("n").alias("n"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(x))), *(F.kll_merge_agg_double(f"q{i}", SKETCH).alias(f"q{i}") for i in range(len(x)))
    )


def medians(rows: DataFrame, by: list[str], serves: str, value: str) -> DataFrame:
    """``by``, model, n (rows) and the exact ``median`` of the finite values (the mean of the middle two of an even number) for every model that rows serve."""
    # the upper middle is the lower one from the other end
    both = rows.withColumns({"_up": finite(value), "_down": -finite(value)})
    each = sketched(both, by, serves, ["_up", "_down"]).persist()
    q = exact_quantiles(both, by, serves, ["_up", "_down"], each, (0.5,))
    q = q.groupBy(*by, "model").agg(((F.max(F.when(F.col("c") == 0, F.col("q"))) - F.max(F.when(F.col("c") == 1, F.col("q")))) / 2).alias("median"))
    return each.select(*by, "model", "n").join(q, [*by, "model"], "left")


def robust_scales(rows: DataFrame, by: list[str], serves: str, x: list[str], least: float = 0.6, exact: bool = False) -> DataFrame:
    """``by``, model, n, centers, widths (arrays along ``x``) for every model that rows serve; ``exact``: quartiles counted out instead of sketched.

    The center is the median and the width the quartile range (1 if it is 0) of the finite values. A column of which less than ``least`` is finite
    has a null width.
    """
    each = sketched(rows, by, serves, x)
    known = lambda i: (F.col(f"n{i}") > 0) & (F.col(f"n{i}") >= least * F.col("n"))
    at = lambda i, p: F.kll_sketch_get_quantile_double(F.when(known(i), F.col(f"q{i}")), F.lit(p))
    width = lambda i: at(i, 0.75) - at(i, 0.25)
    if exact:
        q = exact_quantiles(rows, by, serves, x, each, (0.25, 0.5, 0.75))
        q = q.groupBy(*by, "model").agg(*(F.max(F.when((F.col("c") == i) & (F.col("p") == j), F.col("q"))).alias(f"e{i}_{j}") for i in range(len(x)) for j in range(3)))
        each = each.join(q, [*by, "model"], "left")
        at = lambda i, p: F.when(known(i), F.col(f"e{i}_{(0.25, 0.5, 0.75).index(p)}"))
    return each.select(*by, "model", "n", F.array(*(at(i, 0.5) for i in range(len(x)))).alias("centers"), F.array(*(F.when(width(i) > 0, width(i)).when(known(i), 1.0) for i in range(len(x)))).alias("widths"))


def scaled(x: list[str], clip: float = 4.0) -> Column:
    """The columns ``x`` less their centers, divided by their widths and held to ``clip``; 0 where a value is missing or its column dropped."""
    each = [(finite(c) - F.element_at("centers", i)) / F.element_at("widths", i) for i, c in enumerate(x, 1)]
    return F.array(*(F.when(z.isNull(), 0.0).otherwise(F.greatest(F.lit(-clip), F.least(F.lit(clip), z))) for z in each))


def product_sums(rows: DataFrame, by: list[str], serves: str, x: list[str], y: str, scales: DataFrame, clip: float = 4.0) -> DataFrame:
    """``by``, model and ``sums``: all products of 1, the columns scaled by the model's quartiles and y, summed over the rows that serve the model.

    Rows that serve the same models meet these models' scales in groups of at most about ``GROUP``, so a row moves once, however many models it serves.
    """
    import numpy as np

    sets = rows.groupBy(*by, serves).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("_shares")).persist()  # a row for each set of models
    to = sets.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).withColumn("model", F.explode(serves))
    to = to.join(scales.select(*by, "model", "centers", "widths"), [*by, "model"])
    to = to.select(*(F.col(c).alias(c) for c in to.columns))  # columns apart from those of ``rows``
    plain = [F.coalesce(finite(c), F.lit(float("nan"))).alias(f"_x{i}") for i, c in enumerate(x)]
    dealt = rows.join(F.broadcast(sets), [*by, serves]).withColumn("_share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_shares")))
    dealt = dealt.select(*by, serves, "_share", *plain, F.col(y).cast("double").alias("_y"))
    kinds = dict(to.dtypes)

    def summed(left, right):
        import pyarrow as pa

        values = np.stack([left.column(f"_x{i}").to_numpy() for i in range(len(x))], axis=1)
        full, sums = np.ones((len(values), len(x) + 2)), []
        full[:, -1] = left.column("_y").to_numpy()
        for center, width in zip(right.column("centers").to_pylist(), right.column("widths").to_pylist(), strict=True):
            full[:, 1:-1] = np.clip(np.nan_to_num((values - np.array(center, float)) / np.array(width, float), nan=0.0), -clip, clip)
            sums.append((full.T @ full).ravel() if len(full) else np.zeros((len(x) + 2) ** 2))
        return pa.table({**{c: right.column(c) for c in [*by, "model"]}, "sums": pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))})

    group = [*by, serves, "_share"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, "model"]), "sums array<double>"])
    parts = dealt.groupBy(*group).cogroup(to.groupBy(*group)).applyInArrow(summed, schema)
    return parts.groupBy(*by, "model").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))


def ridge_models(rows: DataFrame, by: list[str], serves: str, x: list[str], y: str, alpha: float, clip: float = 4.0, least: float = 0.6, exact: bool = False) -> DataFrame:
    """``by``, model, n, centers, widths, coefficients, intercept (unpenalised) of least squares of y on the scaled columns plus ``alpha`` times the squares.

    ``serves``: an array column with the numbers of the models that a row trains. Rows without y train none. Dropped columns have a coefficient of 0.
    """
    import numpy as np

    known = rows.where(finite(y).isNotNull() & (F.size(serves) > 0))
    scales = robust_scales(known, by, serves, x, least, exact).persist()  # a row for each model, read for the sums and the models
    sums = product_sums(known, by, serves, x, y, scales, clip).join(scales, [*by, "model"])
    p = len(x)

    def solved(frames):
        for frame in frames:
            out = []
            for n, s in zip(frame["n"], frame["sums"], strict=True):
                s = s.reshape(p + 2, p + 2)
                moment, product = s[0, 1:], s[1:, 1:]
                spread, mean = product - np.outer(moment, moment) / n, moment / n
                w = np.linalg.solve(spread[:p, :p] + alpha * np.eye(p), spread[:p, p])
                out.append((w.tolist(), float(mean[p] - mean[:p] @ w)))
            yield frame.drop(columns="sums").assign(coefficients=[o[0] for o in out], intercept=[o[1] for o in out])

    kept = sums.select(*by, "model", "n", "centers", "widths", "sums")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c != "sums") + ", coefficients array<double>, intercept double"
    return kept.mapInPandas(solved, schema)


def ridge_prediction(x: list[str], clip: float = 4.0) -> Column:
    """The prediction of a row joined to its model."""
    products = F.zip_with(scaled(x, clip), "coefficients", lambda a, b: a * b)
    return F.col("intercept") + F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def served_days(first: str = "first", last: str = "last") -> Column:
    """The days that a row of ``learn.training_spans`` serves, as models."""
    return F.sequence(first, last)


def other_folds(fold: str, folds: int) -> Column:
    """The folds whose models a row of ``fold`` (from 1) trains: all but its own."""
    return F.array_remove(F.array(*(F.lit(k).cast("long") for k in range(1, folds + 1))), F.col(fold).cast("long"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
