"""Vector codes: parts of vectors replaced by the nearest entries of small codebooks that are refined over all rows.

Every task walks its rows' distinct parts as a lexicographic trie. The walk goes depth first and carries, for the prefix of
components above a node, the distances to every entry so far; children add one component to it, so parts that begin alike
share that sum. A leaf takes the nearest entry and adds its part, weighted by the number of rows that hold it, to the entry's sums.

Sums of a task are as large as the codebooks whatever its rows, so rounds shuffle nothing else, and copies of a vector, however
many, are one leaf per trie. Work is on integers, so that results do not depend on how rows are spread.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuetime.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers are held to this size, so that the squares of 256 components add up exactly in 64 bits.
LARGEST = 1 << 26
#: Integers up to this size have squared distances over 256 components that doubles hold exactly.
EXACT = 1 << 21
#: Rows of one trie, and children of a node that are worked on at once: bounds of a task's memory.
TRIE_ROWS, CHILDREN, SALTS = 1 << 15, 256, 16


class Codebooks(NamedTuple):
    """Of vectors with ``length`` components: where parts begin and end, and per part its entries as rows of integers."""

    length: int
    bounds: tuple[tuple[int, int], ...]
    entries: list


def part_bounds(length: int, parts: int) -> tuple[tuple[int, int], ...]:
    """Consecutive parts, equal if ``length`` is divisible by their number, else as near as can be."""
    cuts = [length * i // parts for i in range(parts + 1)]
    return tuple(zip(cuts, cuts[1:], strict=False))


def walk(leaves, entries):
    """Leaf, nearest entry and squared distance of each of the distinct parts ``leaves`` (sorted rows of integers), depth first.

    Nodes with one leaf below end there: their remaining components are added at once. Yields groups as three arrays.
    """
    import numpy as np

    small = max(int(np.abs(x).max(initial=0)) for x in (leaves, entries)) <= EXACT
    real, squares = entries.astype(float), np.cumsum((entries.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]  # of each entry from each component on
    depth_end, open_ = leaves.shape[1], [iter([(0, len(leaves), 0, np.zeros(len(entries), np.int64))])]

    def children(low, high, depth, above):
        """Leaves found under the node in groups of children, and the children to descend to, lazily."""
        starts = np.concatenate([[low], low + 1 + np.flatnonzero(np.diff(leaves[low:high, depth]))])
        ends = np.append(starts[1:], high)
        for i in range(0, len(starts), CHILDREN):
            s, e = starts[i : i + CHILDREN], ends[i : i + CHILDREN]
            sums = above + (leaves[s, depth][:, None] - entries[:, depth]) ** 2
            lone = np.flatnonzero(e - s == 1)
            if len(lone):
                alone = sums[lone]
                if small and depth + 1 < depth_end:  # all whole numbers that doubles hold exactly
                    tail = leaves[s[lone], depth + 1 :].astype(float)
                    alone += ((tail**2).sum(axis=1)[:, None] - 2 * (tail @ real[:, depth + 1 :].T) + squares[:, depth + 1]).astype(np.int64)
                else:
                    for d in range(depth + 1, depth_end):
                        alone += (leaves[s[lone], d][:, None] - entries[:, d]) ** 2
                yield s[lone], alone
            for j in np.flatnonzero(e - s > 1):
                yield int(s[j]), int(e[j]), depth + 1, sums[j]

    while open_:
        found = next(open_[-1], None)
        if found is None:
            open_.pop()
        elif len(found) == 2:
            best = found[1].argmin(axis=1)  # ties to the lower index
            yield found[0], best, found[1][np.arange(len(best)), best]
        elif found[2] == depth_end:  # parts without components
            best = int(found[3].argmin())
            yield np.arange(found[0], found[1]), np.full(found[1] - found[0], best), np.full(found[1] - found[0], found[3][best])
        else:
            open_.append(children(*found))


def nearest_entries(parts, entries):
    """Distinct rows of ``parts`` in lexicographic order, each row's place among them, counts, and each distinct row's entry and distance."""
    import numpy as np

    leaves, place, counts = np.unique(parts, axis=0, return_inverse=True, return_counts=True)
    code, distance = np.zeros(len(leaves), np.int64), np.zeros(len(leaves), np.int64)
    if len(leaves):
        for at, best, far in walk(leaves, entries):
            code[at], distance[at] = best, far
    return leaves, place.reshape(-1), counts, code, distance


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, ints (floor of 1024 times each component, as bytes of 64-bit integers), length, of the vectors without null or
    non-finite components. Integers are held to ``LARGEST`` in size."""

    def convert(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raw, keep = [], []
            for i, v in enumerate(batch.column(2)):
                values = v.values if v.is_valid else None
                if values is None or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    keep.append(i)
                    raw.append(np.clip(np.floor(np.clip(x, -LARGEST, LARGEST) * SCALE), -LARGEST, LARGEST).astype("<i8").tobytes())
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(raw, pa.binary()), pa.array([len(x) // 8 for x in raw], pa.int32())], names=["vec_id", "label", "ints", "length"])

    kind = dict(vectors.dtypes)[label_col]
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("embedding"))
    return rows.mapInArrow(convert, f"vec_id bigint, label {kind}, ints binary, length int")


def _tries(batches, length: int):
    """Bounded groups of rows: their columns as Arrow tables and their vectors as a matrix."""
    import numpy as np
    import pyarrow as pa

    held, rows = [], 0
    limit = max(1, min(TRIE_ROWS, (1 << 25) // (8 * max(1, length))))  # 32 MB of integers at most

    def group():
        table = pa.Table.from_batches(held)
        raw = table.column("ints").combine_chunks()
        return table, np.frombuffer(b"".join(x.as_buffer() for x in raw), "<i8").reshape(len(raw), length)

    for batch in batches:
        for i in range(0, batch.num_rows, limit):
            piece = batch.slice(i, limit)
            if held and rows + piece.num_rows > limit:
                yield group()
                held, rows = [], 0
            held.append(piece)
            rows += piece.num_rows
    if rows:
        yield group()


def first_codebooks(rows: DataFrame, length: int, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids (null ids last, equal ids by their components), in that order; at most ``entries`` rows are fetched."""
    import numpy as np

    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.col("ints")).limit(entries).select("ints").collect()
    x = np.frombuffer(b"".join(bytes(r[0]) for r in least), "<i8").reshape(len(least), length)
    bounds = part_bounds(length, parts)
    return Codebooks(length, bounds, [x[:, a:b].copy() for a, b in bounds])


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks with each entry replaced by the floor of the mean of the parts nearest to it; entries that none is nearest to stay."""
    length, bounds, entries = books

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        sums = [np.zeros(e.shape, object) for e in entries]  # Python integers do not overflow
        counts = [np.zeros(len(e), np.int64) for e in entries]
        for _, x in _tries(batches, length):
            for p, (a, b) in enumerate(bounds):
                leaves, _, weights, code, _ = nearest_entries(x[:, a:b], entries[p])
                mine = np.zeros(entries[p].shape, np.int64)
                np.add.at(mine, code, leaves * weights[:, None])
                sums[p] += mine
                counts[p] += np.bincount(code, weights, len(entries[p])).astype(np.int64)
        out = [(p, e, int(counts[p][e]), [str(v) for v in sums[p][e]]) for p in range(len(bounds)) for e in np.flatnonzero(counts[p])]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["p", "e", "n", "sums"])

    mine = rows.select("ints").mapInArrow(summed, "p int, e int, n bigint, sums array<string>")
    each = mine.select("p", "e", "n", F.posexplode_outer("sums").alias("d", "v"))
    totals = each.groupBy("p", "e", "d").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # a number of each entry's component
    new = [e.copy() for e in entries]
    for r in totals:
        if r["d"] is not None:
            new[r["p"]][r["e"], r["d"]] = int(r["v"]) // r["n"]
    return Codebooks(length, bounds, new)


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits per part), error (squared distances to the entries, summed over parts) of every row."""
    length, bounds, entries = books

    def coded(batches):
        import numpy as np
        import pyarrow as pa

        for table, x in _tries(batches, length):
            codes, error = np.zeros((len(x), len(bounds)), np.uint8), np.zeros(len(x), np.int64)
            for p, (a, b) in enumerate(bounds):
                _, place, _, code, distance = nearest_entries(x[:, a:b], entries[p])
                codes[:, p] = code[place]
                error += distance[place]
            out = pa.table({"vec_id": table.column("vec_id"), "label": table.column("label"), "code": pa.array([c.tobytes().hex() for c in codes], pa.string()), "error": pa.array(error)})
            yield from out.to_batches()

    kind = dict(rows.dtypes)["label"]
    return rows.select("vec_id", "label", "ints").mapInArrow(coded, f"vec_id bigint, label {kind}, code string, error bigint")


def decoded(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """The columns of ``codes`` with ``approximation``, the entries that each code names, back in the vectors' scale."""
    entries = books.entries

    def looked_up(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            codes_ = [bytes.fromhex(c or "") for c in batch.column(batch.schema.get_field_index(code_col)).to_pylist()]
            values = [np.concatenate([entries[p][c] for p, c in enumerate(code)]) / SCALE if code else None for code in codes_]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], names=[*batch.schema.names, "approximation"])

    return codes.mapInArrow(looked_up, ", ".join(f"`{c}` {t}" for c, t in codes.dtypes) + ", approximation array<double>")


def codebook_digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components in decimal digits, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for e in books.entries for row in e.tolist() for v in row).encode()).hexdigest()


def fit_codebooks(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``integer_vectors`` of one length after ``rounds`` passes over all of them."""
    books = first_codebooks(rows, length, parts, entries)
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every row whose vector has no null and no non-finite component.

    Columns read: vec_id, embedding, label. Null and repeated ids keep their rows; a null label is a label. Vectors of each length are coded by
    themselves, with codebooks of their own; empty vectors have the code of the first entries and no error. With fewer vectors than
    entries the codebooks are that much smaller. Components beyond ``LARGEST`` / 1024 count as that. Errors of a label that do not
    fit a long give null. An empty table gives no rows.
    """
    rows = stored(integer_vectors(vectors), "int-vectors")
    lengths = sorted(r[0] for r in rows.select("length").distinct().collect())  # one number per length
    coded = []
    for length in lengths:
        mine = rows.where(F.col("length") == length)
        books = fit_codebooks(mine, length, parts, entries, rounds)
        coded.append(encoded(mine, books).withColumn("codebooks_sha256", F.lit(codebook_digest(books))))
    if not coded:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    all_ = coded[0]
    for c in coded[1:]:
        all_ = all_.unionByName(c)
    all_ = stored(all_, "codes")
    sums = all_.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    salted = sums.select("of", F.expr("try_cast(s AS bigint)").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a label may hold most rows
    dealt = all_.withColumn("dealt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    found = dealt.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("dealt") == F.col("salt")))
    return found.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
