"""Order-dependent selection per key: greedy spacing, separated nearest cases, downsampling."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuetime.operators.joins import asof_join_blocks
from issuetime.schemas import DAY

LONG_AGO = -(1 << 62)
#: Keys whose choices go to every task.
FEW_KEYS = 10_000


def choose_spaced(rows: DataFrame, ts: str, spacing: int, on: str = "series", end: str | None = None, block: int = 7 * DAY, whole: int = 200_000) -> DataFrame:
    """The first row per key, then each next row at least ``spacing`` after the last chosen one's ``end`` (its clock if not given).

    The choice depends on the one before, but a block of time needs only the clock from which a row may be chosen again. So
    every block of each key works out by itself where it would leave that clock for each way in (chains soon run together,
    so few differ), one number is carried through those few rows per block, and then every block chooses by itself. A hot
    key spreads over its blocks; a block's clocks must fit one task. If no key has more than ``whole`` clocks, which are counted first, each
    key is one block: its clocks are folded in one pass. Clocks must be unique within a key; rows without key,
    clock or end are not chosen.
    """
    import numpy as np
    import pandas as pd

    kind = dict(rows.dtypes)[on]
    clocks = rows.select(F.col(on).alias("_k"), F.col(ts).cast("long").alias("_t"), F.col(end or ts).cast("long").alias("_e")).dropna()
    clocks = clocks.withColumn("_b", ((F.col("_t") - F.pmod("_t", F.lit(block))) / block).cast("long"))

    def after(t, e):
        """For each row the place of the next one that may be chosen after it."""
        return np.maximum(np.searchsorted(t, e + spacing), np.arange(1, len(t) + 1))

    def exits(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_t", "_e"])
        t, e = part["_t"].to_numpy(), part["_e"].to_numpy()
        step = after(t, e)
        last = np.where(step < len(t), step, np.arange(len(t)))
        while (last[last] != last).any():
            last = last[last]
        free = e[last] + spacing
        ends = np.append(free[1:] != free[:-1], True)  # of ways in with one outcome, the latest stands for all
        return pd.DataFrame({"_k": part["_k"].to_numpy()[ends], "_b": part["_b"].to_numpy()[ends], "_t": t[ends], "_free": free[ends]})

    def carry(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, free, passed = (None, None), LONG_AGO, False
        for part in parts:
            starts = []
            for k, b, t, leaves in zip(part["_k"], part["_b"], part["_t"], part["_free"], strict=True):
                if (k, b) != at:
                    free = free if k == at[0] else LONG_AGO
                    at, passed = (k, b), False
                    starts.append((k, b, free))
                if not passed and t >= free:
                    free, passed = leaves, True
            yield pd.DataFrame(starts, columns=["_k", "_b", "_free"])

    def choose(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_t", "_e"])
        t, kept = part["_t"].to_numpy(), []
        step, i = after(t, part["_e"].to_numpy()), int(np.searchsorted(t, start["_free"].iloc[0]))
        while i < len(t):
            kept.append(i)
            i = int(step[i])
        return part.iloc[kept][["_k", "_t"]]

    largest = clocks.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= whole:
        chosen = clocks.groupBy("_k").applyInPandas(lambda part: choose(part, pd.DataFrame({"_free": [LONG_AGO]})), f"_k {kind}, _t bigint")
        return rows.join(chosen, (F.col(on) == F.col("_k")) & (F.col(ts) == F.col("_t")), "left_semi")
    blocks = clocks.groupBy("_k", "_b")
    ways = blocks.applyInPandas(exits, f"_k {kind}, _b bigint, _t bigint, _free bigint")
    starts = ways.repartition("_k").sortWithinPartitions("_k", "_b", "_t").mapInPandas(carry, f"_k {kind}, _b bigint, _free bigint")
    chosen = blocks.cogroup(starts.groupBy("_k", "_b")).applyInPandas(choose, f"_k {kind}, _t bigint")
    return rows.join(chosen, (F.col(on) == F.col("_k")) & (F.col(ts) == F.col("_t")), "left_semi")


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def stride(rows: DataFrame, n: int, ts: str, on: str, segment: str) -> DataFrame:
    """Every n-th row of each key, and the first and last of each segment."""
    order, part = Window.partitionBy(on).orderBy(ts), Window.partitionBy(on, segment)
    i = F.row_number().over(order) - 1
    return rows.withColumn("_i", i).withColumn("_a", F.min(ts).over(part)).withColumn("_b", F.max(ts).over(part)).where((F.col("_i") % n == 0) | F.col(ts).isin(F.col("_a"), F.col("_b"))).drop("_i", "_a", "_b")


def bin_extremes(rows: DataFrame, ts: str, value: str, bins: int, on: str) -> DataFrame:
    """First and last row of each key and, of each of ``bins`` equal spans of its time, the rows with the least and most value."""
    whole = Window.partitionBy(on)
    first, last = F.min(ts).over(whole), F.max(ts).over(whole)
    binned = rows.withColumn("_first", first).withColumn("_last", last)
    binned = binned.withColumn("_bin", F.least(F.floor((F.col(ts) - F.col("_first")) * bins / (F.col("_last") - F.col("_first") + 1)), F.lit(bins - 1)))
    part = Window.partitionBy(on, "_bin")
    low, high = F.row_number().over(part.orderBy(F.col(value), F.col(ts))), F.row_number().over(part.orderBy(F.col(value).desc(), F.col(ts)))
    return binned.withColumn("_l", low).withColumn("_h", high).where((F.col("_l") == 1) | (F.col("_h") == 1) | F.col(ts).isin(F.col("_first"), F.col("_last"))).drop("_first", "_last", "_bin", "_l", "_h")


def separated_nearest(cases: DataFrame, k: int, apart: int, ts: str, on: str, distance: str) -> DataFrame:
    """``on``, ``ts``, ``distance``, rank: greedily the nearest case of each key, then each next one at least ``apart`` in time from all before.

    A round takes one minimum for each key, partially aggregated where the cases lie; a key carries its at most ``k`` choices, which go to the tasks if there
    are at most ``FEW_KEYS`` keys, so that no hot key's cases meet. Equal distances go to the earlier case; cases without key, clock or distance are not chosen.
    Every round reads the cases: have them written before.
    """
    rows = cases.select(F.col(on).alias("_k"), F.col(ts).alias("t"), F.col(distance).alias("d")).dropna()
    picks = rows.select("_k").distinct().withColumn("picks", F.expr("cast(array() as array<struct<d: double, t: bigint>>)"))
    few = picks.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    for _ in range(k):
        picks = F.broadcast(picks) if few else picks
        free = ~F.exists("picks", lambda c: F.abs(c["t"] - F.col("t")) < apart)
        best = rows.join(picks, "_k").groupBy("_k").agg(F.min(F.when(free, F.struct("d", "t"))).alias("best"), F.first("picks").alias("picks"))
        picks = best.select("_k", F.when(F.col("best").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("best"))).alias("picks"))
    each = picks.select("_k", F.posexplode("picks").alias("at", "p"))
    return each.select(F.col("_k").alias(on), F.col("p.t").alias(ts), F.col("p.d").alias(distance), (F.col("at") + 1).cast("long").alias("rank"))


def fill_slots(chosen: DataFrame, rows: DataFrame, n: int, ts: str, on: str, tries: int = 64) -> DataFrame:
    """``on``, ``ts`` of the chosen rows and, while a key has fewer than ``n``, of further rows that split its largest time gaps.

    The largest gap between kept rows (of equal ones the earlier) takes the candidate nearest its middle (of equally near ones the earlier). A
    gap's candidates are the rows nearest the centres of ``tries`` equal parts of it, found by partial minima, so a key folds a bounded number of
    clocks whatever it holds. Keys with too few candidates stay short. Clocks must be unique within a key.
    """
    import heapq
    from bisect import bisect_left, insort

    import pandas as pd

    kind = dict(rows.dtypes)[on]
    kept = chosen.select(F.col(on).alias("_k"), F.col(ts).alias("_t")).distinct()
    order = Window.partitionBy("_k").orderBy("_t")
    gaps = kept.withColumn("_n", F.lead("_t").over(order)).where("_n - _t > 1")
    block = 7 * DAY
    inside = asof_join_blocks(rows.select(F.col(on).alias("_k_"), F.col(ts).alias("t")), gaps.select(F.col("_k").alias("_k_"), F.col("_t").alias("a"), F.col("_n").alias("b")), "t", "a", block, on="_k_")
    inside = inside.where("right is not null").select("_k_", "t", "right.a", "right.b").where("t > a and t < b")
    width = (F.col("b") - F.col("a")) / tries
    part = F.floor((F.col("t") - F.col("a")) / width)
    off = F.abs(F.col("t") - F.col("a") - (part + 0.5) * width)
    candidates = inside.groupBy("_k_", "a", part.alias("part")).agg(F.min_by("t", F.struct(off, "t")).alias("t"))
    both = kept.select("_k", "_t", F.lit(True).alias("_kept")).unionByName(candidates.select(F.col("_k_").alias("_k"), F.col("t").alias("_t"), F.lit(False).alias("_kept")))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        held, free = sorted(part["_t"][part["_kept"]].tolist()), sorted(part["_t"][~part["_kept"]].tolist())
        gaps = [(a - b, a, b) for a, b in zip(held, held[1:], strict=False)]
        heapq.heapify(gaps)
        while gaps and len(held) < n:
            _, a, b = heapq.heappop(gaps)
            near = free[max(0, bisect_left(free, (a + b) / 2) - 1) : bisect_left(free, (a + b) / 2) + 1]
            near = [t for t in near if a < t < b]
            if near:
                t = min(near, key=lambda x: (abs(2 * x - a - b), x))
                insort(held, t)
                free.remove(t)
                for x, y in ((a, t), (t, b)):
                    heapq.heappush(gaps, (x - y, x, y))
        return pd.DataFrame({on: part["_k"].iloc[:1].tolist() * len(held), ts: held})

    return both.groupBy("_k").applyInPandas(fill, f"`{on}` {kind}, `{ts}` bigint")
