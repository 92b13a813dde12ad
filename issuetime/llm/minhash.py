"""Near duplicates by an inverted join over signature coordinates.

Every text becomes its set of word shingles and a signature of ``K`` coordinates. Equal sets form one class, represented
once. Classes are posted under each (coordinate, value) pair that more than one class has. A pair of classes is a candidate
if at least ``T`` of its coordinates collide; by the prefix principle such a pair also meets among each class's K - T + 1
rarest coordinates, so only those posting lists are merged and the frequent ones are skipped and looked up in the signatures.
Candidates are confirmed on the full sets, and only confirmed links make components.

At a similarity of 0.75 a coordinate collides with probability 0.75; with K = 32 and T = 12 a link is missed with
probability 2e-6, and less above.

Posting lists are not expanded into pairs. First, rounds link each class only to one pivot of each of its lists, the class
that shares most, which connects most of a group of copies. Then what is left between different components is taken exactly:
classes of lists that still hold several components meet on their rarest whole-set shingles. A set of n shingles has a
link to a smaller or equal one only through the rarest n - ceil(3n/4) + 1 of its own and the rarest n - ceil(6n/7) + 1 of the other,
and at their first common one enough of both must be left behind it, so that copies changed too much to link with anything (most of a large group) hold only shingles of their own there and
form no pair at all, and no link between components is lost. Nor do sets pair whose parities (of the numbers of shingles that hash to each of 1,024
places) differ at more places than linked sets can have different shingles: common shingles cancel out, each other one changes one place.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuetime.llm.common import met, own_rows, stored
from issuetime.llm.components import components
from issuetime.llm.shingles import Shingler, mix
from issuetime.llm.tokens import blocks

K, T, STAR_ROUNDS = 32, 12, 2
#: 64-bit words of a set's parities.
MARKS = 16


def _set_hash(hashes) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(keyed: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, row, n_shingles, set_hash (of the whole set) and signature (array of ``K`` int, null without shingles) of every row.

    ``keyed``: doc_id, row (a number of its own for each row), text.
    """

    def sketch(batches):
        import numpy as np
        import pyarrow as pa

        shingler, factor = Shingler(words), mix(np.arange(101, 101 + K, dtype=np.uint64)) | np.uint64(1)
        for ids, rows, texts in blocks(batches, ("doc_id", "row", "text")):
            n, keys, signatures = [], [], []
            for hashes in shingler.sets(texts):
                n.append(len(hashes))
                keys.append(_set_hash(hashes))
                low = [np.min(hashes[i : i + 20_000, None] * factor, axis=0) for i in range(0, len(hashes), 20_000)]
                signatures.append((np.min(low, axis=0) >> np.uint64(32)).astype(np.uint32).view(np.int32) if low else None)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "row": pa.array(rows, pa.int64()), "n_shingles": pa.array(n, pa.int64()), "set_hash": pa.array(keys, pa.binary()), "signature": pa.array(signatures, pa.list_(pa.int32()))})

    return keyed.select("doc_id", "row", "text").mapInArrow(sketch, "doc_id bigint, row bigint, n_shingles bigint, set_hash binary, signature array<int>")


def postings(classes: DataFrame) -> DataFrame:
    """token, id of each class's rarest coordinates, as far as another class has them too."""
    tokens = classes.select("id", F.posexplode("signature").alias("coordinate", "value"))
    tokens = tokens.select("id", (F.shiftleft(F.col("coordinate").cast("long"), 32) + F.col("value")).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mine = met(tokens, shared, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("mine"))  # K at most
    # coordinates that no other class has come first in the order of rarity and fill the rest of the prefix
    return mine.where(F.size("mine") >= T).select("id", F.explode(F.slice("mine", F.lit(1), F.size("mine") - F.lit(T - 1))).alias("x")).select("x.token", "id")


def full_sets(keyed: DataFrame, posted: DataFrame, words: int = 5) -> DataFrame:
    """id and whole sorted shingle set (binary, 8 bytes each) of the posted classes' representatives."""

    def sets(batches):
        import pyarrow as pa

        shingler = Shingler(words)
        for ids, texts in blocks(batches, ("id", "text")):
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "shingles": pa.array([h.tobytes() for h in shingler.sets(texts)], pa.binary())})

    # the posted rows' numbers make the hash tables, texts stream past them unsorted
    return keyed.select("row", "text").join(posted.select("id", "row").hint("shuffle_hash"), "row").select("id", "text").mapInArrow(sets, "id bigint, shingles binary")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, least: int = T) -> DataFrame:
    """The pairs (u, v) with at least ``least`` equal coordinates and 100 * intersection >= 75 * union of their full sets."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    matches = F.aggregate(F.zip_with("s_u", "s_v", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)
    near = met(met(pairs, side("u"), "u"), side("v"), "v").where(100 * F.least("n_u", "n_v") >= 75 * F.greatest("n_u", "n_v")).where(matches >= least)
    near = stored(near.select("u", "v"), "near")

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            u, v, keep = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({"u": pa.array(u[keep], pa.int64()), "v": pa.array(v[keep], pa.int64())})

    set_of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"x_{c}"))
    return met(met(near, set_of("u"), "u"), set_of("v"), "v").select("u", "v", "x_u", "x_v").mapInArrow(verify, "u bigint, v bigint")


def parities(hashes):
    """Whether an odd number of a set's shingles hash to each of 64 * ``MARKS`` places, as ``MARKS`` integers."""
    import numpy as np

    odd = np.bincount(((mix(hashes) >> np.uint64(32)) % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def rare_pairs(open_ids: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of different labels among the open classes (id, label) whose sets can have a similarity of 0.75.

    Shingles are ordered by how many open classes have them; u is the smaller set (of equal ones the smaller id).
    """

    def listed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            marks = iter([parities(x.view(np.uint64)).tolist() for x in found if len(x)])
            n = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate([*found, np.zeros(0, np.int64)])
            rows = np.repeat(np.arange(len(n)), n)
            first = np.isin(np.arange(len(rows)), np.cumsum(n) - n)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(rows)), "n": pa.array(n[rows]), "label": batch.column(2).take(pa.array(rows)), "shingle": pa.array(flat), "marks": pa.array([next(marks) if f else None for f in first.tolist()], pa.list_(pa.int64()))})

    tokens = stored(met(sets, open_ids, "id").select("id", "shingles", "label").mapInArrow(listed, "id bigint, n bigint, label bigint, shingle bigint, marks array<bigint>"), "shingles")  # marks: on one row of each class
    common = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles that no other open class has come first in every class, and fill its prefix
    shared = met(tokens.drop("marks"), common, "shingle")
    own = shared.groupBy("id").agg((F.first("n") - F.count(F.lit(1))).alias("alone"))
    by_rarity = Window.partitionBy("id").orderBy("df", "shingle")
    prefix = met(shared.withColumn("at", F.row_number().over(by_rarity)), own, "id").withColumn("at", F.col("at") + F.col("alone"))
    marks = tokens.where("marks is not null").select("id", *(F.col("marks")[i].alias(f"m{i}") for i in range(MARKS)))
    prefix = met(prefix.where("at <= n - ceil(3 * n / 4) + 1"), marks, "id")
    prefix = stored(prefix.select("shingle", "id", "n", "label", "at", *(f"m{i}" for i in range(MARKS))), "prefix")
    marked = lambda c: [F.col(f"m{i}").alias(f"{c}{i}") for i in range(MARKS)]
    small = prefix.where("at <= n - ceil(6 * n / 7) + 1").select("shingle", F.col("id").alias("u"), F.col("n").alias("n_u"), F.col("label").alias("label_u"), F.col("at").alias("at_u"), *marked("mu"))
    large = prefix.select("shingle", F.col("id").alias("v"), F.col("n").alias("n_v"), F.col("label").alias("label_v"), F.col("at").alias("at_v"), *marked("mv"))
    fits = "label_u <> label_v and (n_u < n_v or (n_u = n_v and u < v)) and 100 * n_u >= 75 * n_v"
    # at a pair's first common shingle, what is left behind it in either set must still allow the whole overlap
    enough = "175 * (1 + least(n_u - at_u, n_v - at_v)) >= 75 * (n_u + n_v)"
    # linked sets differ by a seventh of their sizes' sum at most
    alike = f"7 * ({' + '.join(f'bit_count(mu{i} ^ mv{i})' for i in range(MARKS))}) <= n_u + n_v"
    return met(small, large, "shingle").where(f"{fits} and {enough} and {alike}").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def class_labels(keyed: DataFrame, classes: DataFrame, words: int = 5) -> DataFrame:
    """id, label of the classes that links connect."""
    lists = stored(postings(classes), "postings")
    posted = met(lists.select("id").distinct(), classes.select("id", "row"), "id")
    sets = stored(full_sets(keyed, posted, words), "sets")
    links, labels, whole, labelled = None, None, True, lists.withColumn("label", F.col("id"))
    for turn in range(STAR_ROUNDS + 1):
        several = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
        open_lists = stored(met(labelled, several, "token"), "open-lists")
        if open_lists.isEmpty():
            break
        if turn < STAR_ROUNDS:
            central = open_lists.groupBy("id").agg(F.count(F.lit(1)).alias("lists"))
            order = F.struct(-F.col("lists"), F.xxhash64("id", F.lit(turn)), "id")
            pivot = met(open_lists, central, "id").groupBy("token").agg(F.min_by(F.struct("id", "label"), order).alias("p")).select("token", F.col("p.id").alias("v"), F.col("p.label").alias("label_v"))
            pairs = met(open_lists.withColumnRenamed("id", "u"), pivot, "token").where("label <> label_v")
            pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        else:
            pairs = rare_pairs(open_lists.select("id", "label").distinct(), sets)
        # pairs by whole-set shingles need no collisions
        found = stored(confirmed(pairs, classes, sets, T if turn < STAR_ROUNDS else 0), "confirmed")
        links = found if links is None else links.union(found)
        whole = turn >= STAR_ROUNDS - 1
        if not whole:  # a class's smallest neighbour tells most of a star apart; chains wait for the components
            labels = links.select(F.col("u").alias("id"), F.col("v").alias("label")).union(links.select("v", "u")).groupBy("id").agg(F.min("label").alias("label"))
            labels = labels.select("id", F.least("id", "label").alias("label"))
        else:
            labels = stored(components(links).withColumnRenamed("node", "id"), "labels")
            links = labels.select(F.col("id").alias("u"), F.col("label").alias("v"))  # each class's link to its label tells all that the links told
        labelled = met(lists, labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    if links is None:
        return classes.select("id", F.col("id").alias("label")).where("false")
    return labels if whole else components(links).withColumnRenamed("node", "id")


def _decided(keyed: DataFrame, words: int) -> DataFrame:
    """doc_id, row, n_shingles and ``best`` of every row: the component's first row (no_id, doc_id, row), null without shingles."""
    rows = stored(sketches(keyed, words), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = rows.where("n_shingles > 0").groupBy("set_hash").agg(F.min(place).alias("own"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # classes are nodes by a number of their own, as several may hold one doc_id or none
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "set_hash", "own", F.col("own.row").alias("row"), "n_shingles", "signature"), "classes")
    labels = class_labels(keyed, classes, words)
    linked = met(classes.select("id", "own"), labels, "id")
    best = linked.groupBy("label").agg(F.min("own").alias("best"))
    of_class = met(classes.select("id", "set_hash", "own"), met(linked, best, "label").select("id", "best"), "id", "left")
    of_class = of_class.select(F.col("set_hash").alias("class"), F.coalesce("best", "own").alias("best"))
    return met(rows.withColumn("_class", F.when(F.col("n_shingles") > 0, F.col("set_hash"))), of_class, F.col("_class") == F.col("class"), "left").select("doc_id", "row", "n_shingles", "best")


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (columns read: doc_id, text).

    Links join texts whose sets of ``words``-word shingles have 100 * intersection >= 75 * union. component_id is the
    smallest doc_id reachable; kept marks the row that carries it. Texts without words (null, empty, blank) have no
    shingles and are linked with nothing; repeated rows are links of similarity 1 and share a component. Rows without
    doc_id come after all ids: their component_id is null unless a row with an id is linked. An empty table gives no rows.
    """
    none, same_row = F.col("best").isNull(), F.col("row") == F.col("best.row")
    kept = none | F.when(F.col("best.no_id"), same_row).otherwise(F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    keyed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")), "texts")
    return _decided(keyed, words).select("doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), kept.alias("kept"))


def kept_documents(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each component the row with the smallest doc_id, and all rows without words.

    Rows are decided one by one, also without doc_id, under a shared doc_id or repeated; any columns are carried, whatever
    their names. Null, empty and blank texts have no words and stay. An empty table gives no rows.
    """
    own = own_rows(docs, "near-rows")
    text, doc_id = own.names["text"], own.names["doc_id"]
    keyed = own.table.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("_row").alias("row"), F.col(text).alias("text"))
    stay = _decided(keyed, words).where(F.col("best").isNull() | (F.col("row") == F.col("best.row")))
    return own.those(stay.select(F.col("row").alias("_row")))
