"""As-of, range and bitemporal joins keyed by series.

As-of joins union both sides and carry the last visible right row forward in one window per series: one shuffle and one sort, no
range condition. Range joins meet on time bins, so that only neighbouring rows are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, on: str = "series", tie: str | None = None, strict: bool = False) -> DataFrame:
    """``left`` with the struct ``right``: the last right row with right_ts <= left_ts (< if strict), ties to the larger ``tie``.

    Rows on the left without a visible right row get null. Neither side may have columns that start with an underscore.
    """
    last = F.struct(*[F.col(c) for c in ([tie] if tie else [])], *[F.col(c) for c in right.columns if c != tie])
    side = 1 if strict else -1  # at equal clocks the right rows come first, or last if strict
    a = left.select(F.col(on).alias("_on"), F.col(left_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct("*").alias("_left"))
    b = right.select(F.col(on).alias("_on"), F.col(right_ts).alias("_ts"), F.lit(side).alias("_side"), last.alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = [F.col("_ts"), F.col("_side")] + ([F.col(f"_right.{tie}").asc_nulls_first()] if tie else [])
    seen = Window.partitionBy("_on").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("right", F.last("_right", ignorenulls=True).over(seen)).where("_side = 0").select("_left.*", "right")


def asof_join_blocks(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, block: int, on: str = "series", tie: str | None = None) -> DataFrame:
    """:func:`asof_join` with every key's time cut into blocks, so that one hot key is spread over many tasks.

    Each block starts with the last right row of the blocks before it, found from one row per key and block.
    """
    bin_of = lambda c: F.floor(F.col(c) / block)
    row = F.struct(*[F.col(c) for c in right.columns])
    lasts = right.groupBy(on, bin_of(right_ts).alias("_bin")).agg(F.max_by(row, F.struct(right_ts, *([tie] if tie else []))).alias("_row"))
    bins = left.select(on, bin_of(left_ts).alias("_bin")).distinct().join(lasts, [on, "_bin"], "full")
    before = Window.partitionBy(on).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select("_bin", F.last("_row", ignorenulls=True).over(before).alias("_row")).where("_row is not null").select("_bin", "_row.*")
    key = F.struct(F.col(on).alias("key"), F.col("_bin").alias("bin"))
    rights = right.withColumn("_bin", bin_of(right_ts)).unionByName(carried).withColumn("on_block", key).drop("_bin")
    lefts = left.withColumn("_bin", bin_of(left_ts)).withColumn("on_block", key).drop("_bin")
    return asof_join(lefts, rights, left_ts, right_ts, "on_block", tie).drop("on_block")


def asof_join_sized(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, block: int, on: str = "series", tie: str | None = None, whole: int = 5_000_000) -> DataFrame:
    """:func:`asof_join` if no key has more than ``whole`` rows on the right, which are counted first, else :func:`asof_join_blocks`; the rows are the same."""
    largest = right.groupBy(on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return asof_join(left, right, left_ts, right_ts, on, tie) if largest <= whole else asof_join_blocks(left, right, left_ts, right_ts, block, on, tie)


def nearest_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tie: str, before: int, after: int, block: int, on: str = "series") -> DataFrame:
    """``left`` with the struct ``right``: the right row nearest in time, at most ``before`` earlier or ``after`` later, of equally near ones that with the smallest ``tie``.

    An as-of join to either side finds the only two rows that can be nearest, so no pairs are formed. ``right`` is null where neither is in reach.
    """
    others = [c for c in right.columns if c not in (on, right_ts)]
    rows = right.groupBy(on, right_ts).agg(F.min_by(F.struct(*others), tie).alias("_row")).select(on, right_ts, "_row.*")  # of one clock the smallest tie
    met = asof_join_blocks(left, rows, left_ts, right_ts, block, on).withColumnRenamed("right", "earlier")
    met = asof_join_blocks(met.withColumn("at_back", -F.col(left_ts)), rows.withColumn("at_back", -F.col(right_ts)), "at_back", "at_back", block, on).drop("at_back")
    late = F.struct(*(F.col(f"right.{c}").alias(c) for c in rows.columns))
    early = F.struct(*(F.col(f"earlier.{c}").alias(c) for c in rows.columns))
    behind, ahead = F.col(left_ts) - F.col(f"earlier.{right_ts}"), F.col(f"right.{right_ts}") - F.col(left_ts)
    back, forth = F.coalesce(behind <= before, F.lit(False)), F.coalesce(ahead <= after, F.lit(False))
    sooner = (behind < ahead) | ((behind == ahead) & (F.col(f"earlier.{tie}") <= F.col(f"right.{tie}")))
    return met.withColumn("right", F.when(back & (~forth | sooner), early).when(forth, late)).drop("earlier")


def newest_visible(obs: DataFrame, visible: str, end: str, on: str = "series") -> DataFrame:
    """``obs`` with ``newest``: the row (struct) with the newest observation end among those visible so far, itself included."""
    seen = Window.partitionBy(on).orderBy(visible).rangeBetween(Window.unboundedPreceding, 0)
    return obs.withColumn("newest", F.max(F.struct(end, *[c for c in obs.columns if c not in (end, on)])).over(seen))


def trailing_join(issues: DataFrame, rows: DataFrame, issue_ts: str, ts: str, lookback: int, on: str = "series", parts: int = 1, share: int | None = None) -> DataFrame:
    """Pairs of an issue and each row in (issue - lookback, issue], by bins of the lookback's length: two bins per issue.

    ``parts``: bins to a lookback, so that an issue meets fewer rows out of its reach in more bins. ``share``: deal both sides to a task for about as many
    rows, and never by way of the driver: where pairs are many, the work goes with them and not with the bytes that Spark sees.
    """
    size = -(-lookback // parts)
    bin_of = lambda c: F.floor(c / size)
    left = issues.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(issue_ts) - lookback), bin_of(F.col(issue_ts)))))
    right = rows.withColumn("_bin", bin_of(F.col(ts))).withColumnRenamed(on, "_on")
    if share:
        tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // share))
        left, right = left.repartition(tasks, on, "_bin"), right.repartition(tasks, "_on", "_bin").hint("merge")
    near = (F.col(on) == F.col("_on")) & (left["_bin"] == right["_bin"]) & (F.col(ts) <= F.col(issue_ts)) & (F.col(ts) > F.col(issue_ts) - lookback)
    return left.join(right, near).drop("_on", left["_bin"], right["_bin"])


def revision_asof(receipts: DataFrame, issue: int) -> DataFrame:
    """Per observation the receipt known at ``issue``: visible (available and confirmed) by then, the latest, then the largest id."""
    clock = F.greatest("available", "confirmed")
    order = Window.partitionBy("series", "obs_id").orderBy(clock.desc(), F.col("receipt_id").desc())
    return receipts.where(clock <= issue).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def overlap_join(windows: DataFrame, blocks: DataFrame, on: str, block: int) -> DataFrame:
    """Windows (start, stop) with the blocks (at: left end) they overlap and the overlap's length ``w``, by equal block starts."""
    at = F.explode(F.sequence(F.col("start") - F.pmod(F.col("start"), F.lit(block)), F.col("stop") - 1 - F.pmod(F.col("stop") - 1, F.lit(block)), F.lit(block)))
    spread = windows.withColumn("at", at)
    weight = F.least("stop", F.col("at") + block) - F.greatest("start", "at")
    return spread.join(blocks, [on, "at"], "left").withColumn("w", weight)


def nearest_levels(now: DataFrame, past: DataFrame, group: list[str], k: int) -> DataFrame:
    """issue_id, ref and ``best``: up to ``k`` structs (apart, past, d) of the group's rows nearest in level, nearest first, ties to the smaller ``past``.

    ``now``: ``group``, issue_id, ref. ``past``: ``group``, level, past, d. The rows of a group are numbered by level, so that an issue meets the k numbers
    to either side of its own level, whatever the size of the group. Levels that are missing or not finite come last.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    known, asked = past.where(finite("level")), now.where(finite("ref"))
    # rows at an issue's own level lie below it; of equal levels the smaller number of a past row is met first on either side
    both = known.select(*group, F.col("level").alias("_at"), F.lit(0).alias("_side"), "past", "d").unionByName(asked.select(*group, F.col("ref").alias("_at"), F.lit(1).alias("_side"), "issue_id"), allowMissingColumns=True)
    far_first = Window.partitionBy(*group).orderBy("_at", "_side", F.col("past").desc())
    near_first = Window.partitionBy(*group).orderBy("_at", "_side", "past")
    count = F.sum(1 - F.col("_side"))
    both = both.withColumn("_below", count.over(far_first.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_above", count.over(near_first.rowsBetween(Window.unboundedPreceding, 0)))
    sides = lambda below, above: F.explode(F.array(*below, *above)).alias("_place")
    place = lambda side, n: F.struct(F.lit(side).alias("side"), n.alias("n"))
    mine = both.where("_side = 1").select(*group, "issue_id", F.col("_at").alias("ref"), sides([place(0, F.col("_below") - i) for i in range(k)], [place(1, F.col("_below") + 1 + i) for i in range(k)]))
    theirs = both.where("_side = 0").select(*group, "past", "d", F.col("_at").alias("level"), sides([place(0, F.col("_below"))], [place(1, F.col("_above"))]))
    met = mine.join(theirs, [*group, "_place"]).select("issue_id", "ref", "level", "past", "d")
    # missing or infinite levels: the first of each kind; an issue without a finite level is equally far from all finite ones
    odd = past.where(~finite("level")).withColumn("_n", F.row_number().over(Window.partitionBy(*group, "level").orderBy("past"))).where(F.col("_n") <= k).drop("_n")
    lost = now.where(~finite("ref"))
    first = known.join(lost.select(*group).distinct(), group, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("past"))).where(F.col("_n") <= k).drop("_n")
    for side, rows in ((now, odd), (lost, first)):
        met = met.unionByName(side.join(rows, group).select("issue_id", "ref", "level", "past", "d"))
    apart = F.abs(F.col("level") - F.col("ref"))
    each = met.groupBy("issue_id").agg(F.first("ref").alias("ref"), F.sort_array(F.collect_list(F.struct(apart.isNull().alias("none"), apart.alias("apart"), "past", "d"))).alias("best"))  # a few times k
    return each.select("issue_id", "ref", F.slice("best", 1, k).alias("best"))
