"""Finite state machines over ordered rows of many keys, without folding a key in one task.

A block of time does not know the state it begins in, but it can say where each state would leave it: its rows' transitions composed into
one function of the states. These functions, one short array for each block, are applied one after another for each key, and then
every block runs by itself from the state it was found to begin in. What a row does to the state is a number, its symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _next(table: list[list[int]], state: Column, symbol: Column) -> Column:
    """The state after ``symbol``: the transition table is a constant of the expression."""
    width = len(table[0])
    flat = F.array(*(F.lit(x) for row in table for x in row))
    return F.element_at(flat, state * width + symbol + 1)


def run_machine(rows: DataFrame, table: list[list[int]], start: int, block: int, ts: str = "label", on: str = "series", symbol: str = "symbol") -> DataFrame:
    """``on``, ``ts``, state after every row. ``table[state][symbol]``: the state that follows; every key begins in ``start``.

    Rows without key, clock or symbol take no part. Rows of equal clocks are taken in the order of their symbols. A block's rows, and a key's blocks,
    are gathered as short numbers: choose ``block`` so that both stay in the thousands.
    """
    known = rows.select(F.col(on).alias("_k"), F.col(ts).alias("_t"), F.col(symbol).cast("int").alias("_s")).dropna()
    known = known.withColumn("_b", F.floor(F.col("_t") / block))
    blocks = known.groupBy("_k", "_b").agg(F.sort_array(F.collect_list(F.struct("_t", "_s"))).alias("rows"))  # the clocks of one block
    step = lambda s, r: _next(table, s, r["_s"])
    leaves = F.array(*(F.aggregate("rows", F.lit(s), step) for s in range(len(table))))
    chains = blocks.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_b", leaves.alias("leaves")))).alias("chain"))  # a few numbers a block
    begin = F.struct(F.lit(start).alias("state"), F.array().cast("array<struct<b: bigint, state: int>>").alias("found"))
    passed = F.aggregate("chain", begin, lambda a, x: F.struct(F.element_at(x["leaves"], a["state"] + 1).alias("state"), F.concat(a["found"], F.array(F.struct(x["_b"].alias("b"), a["state"].alias("state")))).alias("found")), lambda a: a["found"])
    entered = chains.select("_k", F.explode(passed).alias("e")).select("_k", F.col("e.b").alias("_b"), F.col("e.state").alias("enters"))
    first = F.struct(F.col("enters").alias("state"), F.array().cast("array<struct<t: bigint, state: int>>").alias("out"))

    def walked(a, r):
        after = step(a["state"], r)
        return F.struct(after.alias("state"), F.concat(a["out"], F.array(F.struct(r["_t"].cast("bigint").alias("t"), after.alias("state")))).alias("out"))

    states = blocks.join(entered, ["_k", "_b"]).select("_k", F.explode(F.aggregate("rows", first, walked, lambda a: a["out"])).alias("e"))
    return states.select(F.col("_k").alias(on), F.col("e.t").alias(ts), F.col("e.state").alias("state"))
