"""Exact nearest rows of a stated query set, by cells around pivots that the triangle inequality rules out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, CELL_ROWS, FIRST_CELLS = 64, 4096, 2
#: Rows that a task hands on at once, and queries that meet a block at once.
BATCH, LOT = 4096, 16_384


def _lookup(values: dict, key: Column, otherwise) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(otherwise)) if pairs else F.lit(otherwise)


def in_frames(rows, columns: dict[str, str], most: int = BATCH):
    """Frames of at most ``most`` of the rows (tuples along ``columns``, a kind by name), one at a time."""
    from itertools import batched

    import pandas as pd

    for part in batched(rows, most):
        yield pd.DataFrame(list(part), columns=list(columns)).astype({c: k for c, k in columns.items() if k != "object"})


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int, pivots: int = PIVOTS, size: int = CELL_ROWS) -> DataFrame:
    """query_id, vec_id, d, rank: the ``k`` rows with the least squared distance to each query, rows of its own vec_id excluded; ties to smaller ids.

    Both sides need vec_id (bigint) and embedding (arrays of one length without nulls). Every row belongs to the cell of the nearest of a few pivots, and every
    cell is dealt by hash to blocks of about ``size`` rows. A query first meets its nearest cells, which bounds the distance of its
    k-th neighbour from above; after that it meets only the cells that can hold a nearer row: those whose pivot is no farther than that
    bound and the cell's radius together. On data without structure few cells are ruled out, and the work is that of a scan in blocks.
    A task holds a block, a lot of at most about ``LOT`` queries, and what it hands on in frames of ``BATCH`` rows, whatever the number of rows and queries.
    The driver holds the pivots and two numbers for each cell.
    """
    import numpy as np
    import pandas as pd

    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("embedding").collect()
    centers = np.array([r["embedding"] for r in chosen], float)
    found = "query_id bigint, vec_id bigint, d double"

    def away(x):
        """Distances to the pivots."""
        return np.sqrt(np.maximum(((x[:, None, :] - centers) ** 2).sum(axis=2), 0)) if len(x) else np.zeros((0, len(centers)))

    def placed(frames):
        for frame in frames:
            for i in range(0, len(frame), 1000):
                part = frame.iloc[i : i + 1000]
                d = away(np.array(part["embedding"].tolist(), float).reshape(len(part), -1))
                yield part.assign(cell=d.argmin(axis=1), apart=d.min(axis=1))

    if not chosen:
        return queries.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("d"), F.lit(1).alias("rank")).where(F.lit(False))
    cells = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(placed, "vec_id bigint, embedding array<double>, cell int, apart double")
    known = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()  # a row a cell
    parts, radius = {r["cell"]: -(-r["n"] // size) for r in known}, {r["cell"]: r["radius"] for r in known}
    lots = -(-queries.count() // LOT) or 1
    lot_of = lambda q: ((q * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40) % lots
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("vec_id"), _lookup(parts, F.col("cell"), 1))).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))

    def asked(which):
        """Each query once for every block of the cells that ``which`` names for it."""

        def spread(frames):
            for frame in frames:
                for i in range(0, len(frame), 1000):
                    part = frame.iloc[i : i + 1000]
                    d = away(np.array(part["embedding"].tolist(), float).reshape(len(part), -1))
                    chosen = which(d, part)
                    # a query goes to as many blocks as there may be, with its vector
                    out = ((int(q), e, int(c), b, lot_of(int(q))) for q, e, mine in zip(part["vec_id"], part["embedding"], chosen, strict=True) for c in mine for b in range(parts.get(int(c), 0)))
                    yield from in_frames(out, {"query_id": "int64", "embedding": "object", "cell": "int32", "block": "int64", "lot": "int64"})

        return spread

    def meet(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(held):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "d": np.zeros(0)})
        r, ids = np.array(held["embedding"].tolist(), float), held["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        r, ids, out = r[order], ids[order], []
        for q, e in zip(mine["query_id"], mine["embedding"], strict=True):
            d = ((r - np.asarray(e, float)) ** 2).sum(axis=1)
            d[ids == q] = np.inf
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            near = near[np.argsort(d[near], kind="stable")[:k]]
            near = near[np.isfinite(d[near])]
            out.append((ids[near], d[near]))
        return pd.DataFrame({"query_id": np.repeat(mine["query_id"].to_numpy(), [len(i) for i, _ in out]), "vec_id": np.concatenate([i for i, _ in out]), "d": np.concatenate([d for _, d in out])})

    def met(questions: DataFrame) -> DataFrame:
        return questions.groupBy("cell", "block", "lot").cogroup(dealt.groupBy("cell", "block", "lot")).applyInPandas(meet, found)

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= k)

    spread = "query_id bigint, embedding array<double>, cell int, block bigint, lot bigint"
    questions = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    nearest = lambda d: np.argsort(d, axis=1, kind="stable")[:, :FIRST_CELLS]
    first = best(met(questions.mapInPandas(asked(lambda d, part: nearest(d)), spread)))
    bound = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.max(F.when(F.col("rank") == k, F.sqrt("d"))).alias("bound"))
    reach = np.array([radius.get(c, -np.inf) for c in range(len(centers))])

    def still_open(d, part):
        limit = part["bound"].fillna(np.inf).to_numpy(float)
        can = d - reach <= limit[:, None] * (1 + 1e-9) + 1e-9
        np.put_along_axis(can, nearest(d), False, axis=1)  # met before
        return [np.flatnonzero(c) for c in can]

    second = met(questions.join(bound, "vec_id", "left").mapInPandas(asked(still_open), spread))
    return best(first.drop("rank").unionByName(second))
