"""Nearest neighbours by shifted space-filling curves.

Every distinct vector is projected by several fixed random rotations, shifted, and given its place on a Hilbert curve of each.
Spark range-partitions the places, which gives every vector its rank on each curve. A query looks at the windows around its own
ranks: blocks of consecutive vectors meet the queries whose window reaches them, the best of every block are kept, and the
blocks of all curves are merged and ranked by the exact cosine.

The window's width and the number of curves come from the data: for a sample of queries of bounded size the true neighbours
are found among all vectors, and for each number of curves (two at least) the window is the distance in rank, on the nearest of
them, that holds the wanted share. The number that scores the fewest vectors is taken. On data without structure, windows hold a large part of the rows on
any curve, and the search costs more than an exact scan. All vectors are indexed and all candidates in the windows are scored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuetime.llm.common import stored

CURVES, DIMENSIONS, BITS, BLOCK, SAMPLE, SHARE, SEED = 8, 8, 6, 2048, 256, 0.97, 20240101


def hilbert_keys(cells, bits: int):
    """Position on the Hilbert curve of each row of ``cells`` (integers below 2**bits; columns * bits at most 63)."""
    import numpy as np

    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            set_ = (x[i] >> b & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where(x[-1] >> b & 1, flip ^ ((1 << b) - 1), flip)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for column in x:
            key = key << 1 | ((column ^ flip) >> b & 1)
    return key


def curve_keys(vectors, curves: int, dimensions: int, bits: int):
    """Keys of unit vectors on each curve: (vectors, curves)."""
    import numpy as np

    rng, n = np.random.default_rng(SEED), vectors.shape[1]
    out = []
    for _ in range(curves):
        rotation = np.linalg.qr(rng.standard_normal((n, n)))[0][:, : min(dimensions, n)]
        shift = rng.uniform(0.35, 0.65, rotation.shape[1])
        cells = np.clip((vectors @ rotation * (np.sqrt(n) / 6) + shift) * (1 << bits), 0, (1 << bits) - 1)
        out.append(hilbert_keys(cells.astype(np.int64), bits))
    return np.stack(out, axis=1)


def _unit(raw):
    """Vectors of a binary Arrow column as doubles, and their lengths.

    Each is divided by the power of two next to its largest component, which changes no digit of a cosine and keeps squares
    from overflowing or vanishing.
    """
    import numpy as np

    v = np.stack([np.frombuffer(x.as_buffer(), "<f8") for x in raw])
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v, np.sqrt(np.einsum("ij,ij->i", v, v))


def _best(scores, ids, n: int):
    """Per row of scores the columns of the n best, ties to the smaller id."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    s = -scores[:, order]
    if s.shape[1] > n:  # all that reach the n-th best value, so that ties are decided by id
        limit = np.partition(s, n - 1, axis=1)[:, n - 1]
    else:
        limit = np.full(len(s), np.inf)
    return [order[c[np.argsort(row[c], kind="stable")[:n]]] for row, c in ((r, np.flatnonzero(r <= m)) for r, m in zip(s, limit, strict=True))]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles as bytes), class (hash of the bytes) of the rows that take part: finite and not zero."""

    def convert(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, keep, raw = batch.column(0).to_pylist(), [], []
            for i, v in zip(ids, batch.column(1), strict=True):
                values = v.values if v.is_valid else None
                if i is None or values is None or len(values) == 0 or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    raw.append(x.tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(keep, pa.int64()), "vector": pa.array(raw, pa.binary()), "class": pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary())})

    return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(convert, "vec_id bigint, vector binary, class binary")


def positions(classes: DataFrame, curves: int, dimensions: int, bits: int, partitions: int) -> DataFrame:
    """class, curve, pos: each class's rank on each curve."""

    def keyed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v, length = _unit(batch.column(1))
                keys = curve_keys(v / length[:, None], curves, dimensions, bits)
                names = batch.column(0).take(pa.array(np.repeat(np.arange(len(v)), curves)))
                yield pa.RecordBatch.from_pydict({"class": names, "curve": pa.array(np.tile(np.arange(curves), len(v)), pa.int32()), "key": pa.array(keys.ravel())})

    def numbered(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict({"class": batch.column(0), "curve": batch.column(1), "part": pa.array([part] * n, pa.int32()), "at": pa.array(np.arange(at, at + n))})
            at += n

    order = ["curve", "key", "class"]
    keys = classes.select("class", "vector").mapInArrow(keyed, "class binary, curve int, key bigint")
    ranked = stored(keys.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(numbered, "class binary, curve int, part int, at bigint"), "curve-order")
    parts = ranked.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return ranked.join(bases, ["curve", "part"]).select("class", "curve", (F.col("base") + F.col("at")).alias("pos"))


class Windows(NamedTuple):
    """How many curves are searched, how far in rank to either side, and about how many vectors a query then scores."""

    curves: int
    reach: int
    scored: int


def _windows(classes: DataFrame, queries: DataFrame, places: DataFrame, k: int, sample: int, share: float, curves: int, block: int) -> Windows:
    """The cheapest windows that hold ``share`` of the sampled queries' true neighbours."""
    rows = queries.orderBy(F.xxhash64("class")).limit(sample).select("class", "vector").collect()  # at most `sample` vectors
    if not rows:
        return Windows(1, 1, 0)
    names, raw = [bytes(r[0]) for r in rows], [bytes(r[1]) for r in rows]

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        q, own = _unit(pa.array(raw, pa.binary()))
        q = q / own[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            v, length = _unit(batch.column(1))
            scores, ids = q @ (v / length[:, None]).T, batch.column(0).to_pylist()
            best = np.argsort(-scores, axis=1)[:, : k + 1]
            out = [(names[i], ids[j], float(scores[i, j])) for i, row in enumerate(best) for j in row if ids[j] != names[i]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 3, (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["query", "class", "score"])

    top = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    true = classes.select("class", "vector").mapInArrow(nearest, "query binary, class binary, score double").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    own = places.select(F.col("class").alias("query"), "curve", F.col("pos").alias("own"))
    away, tried = F.abs(F.col("pos") - F.col("own")), range(min(2, curves), curves + 1)
    apart = true.join(places, "class").join(own, ["query", "curve"]).groupBy("query", "class").agg(*(F.min(F.when(F.col("curve") < c, away)).alias(f"apart{c}") for c in tried))
    reaches = apart.agg(*(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY apart{c})") for c in tried)).first()
    n = places.where("curve = 0").count()
    plans = [Windows(c, r, c * min(n, 2 * r + block)) for c, r in zip(tried, (max(int(x or 0), 1) for x in reaches), strict=True)]
    return min(plans, key=lambda w: (w.scored, w.curves))


def nearest_neighbours(
    vectors: DataFrame, k: int = 5, every: int = 50, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS,
    block: int = BLOCK, sample: int = SAMPLE, share: float = SHARE,
) -> DataFrame:
    """The ``k`` nearest found of every row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score (cosine).

    Columns read: vec_id, embedding. Rows with a null id, or a vector that is null, empty, zero or not finite throughout, take no part. Vectors of each
    length are searched among themselves, as cosines need one length. A row is its own candidate never, another row of its vec_id is:
    repeated ids give a query for each row and a place for each row. Equal vectors are one class on the curves; of a class the k + 1 first rows can be in a result, so no more are
    carried. Ties go to the smaller vec_id; with fewer candidates all are returned; an empty table gives no rows.
    """
    rows = stored(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = sorted(r[0] for r in rows.select(F.octet_length("vector")).distinct().collect())  # one number per length
    each = [_of_length(rows.where(F.octet_length("vector") == n), k, every, curves, dimensions, bits, block, sample, share) for n in lengths]
    if not each:
        return rows.selectExpr("vec_id as query_id", "0 as rank", "vec_id", "0d as score")
    return reduce(DataFrame.unionByName, each)


def _of_length(rows: DataFrame, k: int, every: int, curves: int, dimensions: int, bits: int, block: int, sample: int, share: float) -> DataFrame:
    """``nearest_neighbours`` of rows (vec_id, row, vector, class) whose vectors have one length."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = Window.partitionBy("class").orderBy("vec_id", "row")
    members = stored(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1), "members")
    classes = members.where("n = 1").select("class", "vector", F.col("vec_id").alias("least_id"))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "class")
    queries = asked.select("class").distinct().join(classes, "class")
    places = stored(positions(classes, curves, dimensions, bits, partitions), "positions")
    curves, reach, _ = _windows(classes, queries, places, k, sample, share, curves, block)
    places = places.where(F.col("curve") < curves)

    blocks = places.withColumn("block", F.floor(F.col("pos") / block)).join(classes, "class").select("curve", "block", "class", "least_id", "vector")
    span = F.sequence(F.floor(F.greatest(F.lit(0), F.col("pos") - reach) / block), F.floor((F.col("pos") + reach) / block))
    wanted = places.join(queries.select("class", "vector"), "class").select(F.col("curve").alias("on_curve"), F.explode(span).alias("near"), F.col("class").alias("query"), F.col("vector").alias("query_vector"))

    def scored(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.binary()), "class": pa.array([], pa.binary()), "least_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        v, length = _unit(left.column("vector"))
        q, own = _unit(right.column("query_vector"))
        ids, names, asking = left.column("least_id").to_numpy(), left.column("class").to_pylist(), right.column("query").to_pylist()
        out = []
        for i in range(0, len(q), 256):
            scores = q[i : i + 256] @ v.T / own[i : i + 256, None] / length
            out += [(asking[i + a], names[b], int(ids[b]), float(scores[a, b])) for a, best in enumerate(_best(scores, ids, k + 1)) for b in best]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.float64()), strict=True)], names=["query", "class", "least_id", "score"])

    found = blocks.groupBy("curve", "block").cogroup(wanted.groupBy("on_curve", "near")).applyInArrow(scored, "query binary, class binary, least_id bigint, score double")
    merged = found.groupBy("query", "class", "least_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least_id")
    near = merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "class", "score")
    answers = asked.join(near, asked["class"] == near["query"]).select("query_id", "query_row", near["class"], "score").join(members.select("class", "vec_id", "row"), "class").where("row <> query_row")
    rank = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
