"""Scoring texts with a smoothed n-gram model, as a weighted backoff automaton over counts of the whole training part.

Every n-gram seen in training, up to order - 1 words, is a state, and the empty one is the root. An n-gram that continues a
state is an arc of it, which leads to the longest state that the words so far end with. What a state lacks is reached by its
failure arc, which leads to the state of the context without its first word and carries the backoff weight. With Dirichlet
smoothing, p(w | h) = (c(hw) + m * p(w | h')) / (c(h) + m), the arc of hw weighs the whole fraction and the failure arc m / (c(h) + m), so
that each state's weights sum to one. The root has an arc for every word: (c + 0.5) / (N + 0.5 * (V + 1)). A text is walked
once from left to right: the current state is carried, failure arcs are followed until the state has an arc for the next
word, and the weights' logarithms add up.

Work is spread as follows. Texts are gathered into chunks, stored once. A chunk's distinct n-grams (hashes) go to
ranges of the hash space, as one sorted, delta-coded block for each range; a range adds up its counts over all chunks and answers
each chunk with the totals in the chunk's own order. A chunk thus gets exactly the part of the automaton that its texts walk.
No model is broadcast; range and chunk sizes bound memory. There is a block for each chunk and range that share an n-gram: as many as
a shuffle of that many map and reduce tasks has, and never more than there are n-grams to count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuetime.llm.common import shared_dir, stored
from issuetime.llm.shingles import WordHasher, mix
from issuetime.llm.tokens import blocks

ORDER, CHUNK_BYTES, RANGE_BYTES, STRETCH, SPARE_BITS = 3, 4 << 20, 12 << 20, 256, 24
_END, _STEP = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


def is_held_out(doc_id):
    """Whether crc32 of the id as text (null: empty) leaves 1 when divided by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _planes(values) -> bytes:
    """The bytes of integers by significance, so that equal high bytes lie together and compress."""
    import numpy as np

    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _values(raw, kind: str):
    import numpy as np

    data = np.frombuffer(raw, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(size, -1).T).view(kind).ravel() if len(data) else np.zeros(0, kind)


class Grams:
    """Hashes of every n-gram of a chunk's texts: for each position of each text, end included, orders 1 to ``order``."""

    def __init__(self, order: int) -> None:
        self.order, self.hasher = order, WordHasher()

    def of(self, texts: list[str]):
        """Per order the hashes of the n-grams that end at each position, and each text's first position (one more than texts).

        An order's n-gram at position i of a text spans the start mark if i = order - 2; earlier positions have none (0).
        """
        import numpy as np

        words, bounds = self.hasher.words(texts)
        first = np.concatenate([[0], np.cumsum(np.diff(bounds) + 1)])
        grams = [np.insert(words, bounds[1:], np.uint64(_END))]
        place = np.arange(len(grams[0])) - np.repeat(first[:-1], np.diff(first))
        for k in range(2, self.order + 1):
            before = np.empty_like(grams[-1])
            before[1:], before[:1] = grams[-1][:-1], 0
            if k == 2:
                before[place == 0] = np.uint64(_END)
            now = mix(before * np.uint64(_STEP) + grams[0] + np.uint64(k))
            now[place < k - 2] = 0
            grams.append(now)
        return grams, first


def _packed(values, shift: int = 0) -> bytes:
    """Ascending integers, without their ``shift`` lowest bits, as compressed byte planes of their differences."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(values >> np.uint64(shift), prepend=np.uint64(0))))


def _unpacked(raw: bytes, shift: int = 0):
    import numpy as np
    import zstandard

    return np.cumsum(_values(zstandard.ZstdDecompressor().decompress(raw), "<u8"), dtype=np.uint64) << np.uint64(shift)


def _counts_packed(values) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(_planes(values))


def _counts_unpacked(raw: bytes, kind: str):
    import zstandard

    return _values(zstandard.ZstdDecompressor().decompress(raw), kind)


def _distinct(grams):
    """Sorted distinct n-grams without the mark for none (0), and each position's place among them (-1: none)."""
    import numpy as np

    keys, place = np.unique(grams, return_inverse=True)
    return (keys[1:], place - 1) if len(keys) and keys[0] == 0 else (keys, place)


class BackoffAutomaton:
    """The part of the automaton that some texts walk.

    ``places[k]`` holds per position the place of the (k + 1)-gram that ends there (-1: none), ``totals[k]`` the training counts by
    place, ``first`` each text's first position. States are numbered: the root, then the words, then the word pairs, and so on.
    """

    def __init__(self, places, totals, first, total: int, types: int, concentration: float) -> None:
        import numpy as np

        self.np, self.places, self.totals, self.first, m = np, places, totals, first, concentration
        words, self.width = places[0], max(1, len(totals[0]))
        starts = np.zeros(len(words), bool)
        starts[first[:-1]] = True
        end = words[first[1] - 1] if len(first) > 1 else 0  # the end mark of the text before is the first context
        self.start = 1 + end
        self.base = np.log10((totals[0] + 0.5) / (total + 0.5 * (types + 1)))
        levels = len(places) - 1  # states have up to this many words
        self.offset = np.concatenate([[0, 1], 1 + np.cumsum([len(t) for t in totals[:levels]])]).astype(np.int64)
        self.failure, self.suffix = np.zeros(self.offset[levels + 1] if levels else 1), np.zeros(self.offset[levels + 1] if levels else 1, np.int64)
        known = totals[0] > 0
        keys, weights, ends = [np.arange(self.width)], [self.base], [np.where(known, 1 + np.arange(len(known)), 0) if levels else np.zeros(self.width, np.int64)]
        lower = 10**self.base
        for k in range(levels):
            # failure arcs of the states of k + 1 words
            mine = slice(self.offset[k + 1], self.offset[k + 2])
            self.failure[mine] = np.log10(m / (totals[k] + m))
            at = self._somewhere(k)
            self.suffix[mine] = 0 if k == 0 else self.offset[k] + places[k - 1][at]
            # arcs of these states: the (k + 2)-grams seen in training
            at = self._somewhere(k + 1)
            context = np.where(starts[at], end, places[k][at - 1]) if k == 0 else places[k][at - 1]
            seen = np.flatnonzero(totals[k + 1] > 0)
            at, context = at[seen], context[seen]
            shorter = places[k][at]
            weight = (totals[k + 1][seen] + m * lower[shorter]) / (totals[k][context] + m)
            lower = np.zeros(len(totals[k + 1]))
            lower[seen] = weight
            keys.append((self.offset[k + 1] + context) * self.width + words[at])
            weights.append(np.log10(weight))
            ends.append(self.offset[k + 2] + seen if k + 1 < levels else self.offset[k + 1] + shorter)
        arcs = np.concatenate(keys)
        order = np.argsort(arcs, kind="stable")
        self.arcs, self.weights, self.ends = arcs[order], np.concatenate(weights)[order], np.concatenate(ends)[order]

    def _somewhere(self, k: int):
        """A position of each (k + 1)-gram."""
        at = self.np.zeros(len(self.totals[k]), self.np.int64)
        there = self.np.flatnonzero(self.places[k] >= 0)
        at[self.places[k][there]] = there
        return at

    def _state_before(self, position):
        """The longest state that the words before each position end with: what a walk from the text's start has reached there."""
        np = self.np
        state = np.zeros(len(position), np.int64)
        for k in range(len(self.places) - 1):
            place = self.places[k][position - 1]
            state = np.where((place >= 0) & (self.totals[k][place] > 0), self.offset[k + 1] + place, state)
        return state

    def walk(self):
        """Log10 probability of each text. Texts are walked side by side, long ones in stretches of ``STRETCH`` words."""
        np, words = self.np, self.places[0]
        if len(self.first) < 2:
            return np.zeros(0)
        sizes = np.diff(self.first)
        parts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = self.first[owner] + number * STRETCH
        left = np.minimum(STRETCH, self.first[owner + 1] - at)
        state = np.where(number == 0, self.start if self.totals[0][self.start - 1] > 0 and len(self.places) > 1 else 0, self._state_before(at))
        order = np.argsort(-left, kind="stable")
        owner, at, left, state = owner[order], at[order], left[order], state[order]
        score = np.zeros(len(owner))
        for t in range(int(left[0])):
            going = np.arange(np.searchsorted(-left, -t, side="left"))
            while len(going):
                wanted = state[going] * self.width + words[at[going] + t]
                arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
                found = self.arcs[arc] == wanted
                here, arc, lost = going[found], arc[found], going[~found]
                score[here] += self.weights[arc]
                state[here] = self.ends[arc]
                score[lost] += self.failure[state[lost]]
                state[lost] = self.suffix[state[lost]]
                going = lost
        return np.bincount(owner, weights=score, minlength=len(sizes))


def _texts(row) -> list[str]:
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(row["texts"]).decode("utf-8", "surrogatepass")
    out, at = [], 0
    for n in row["lengths"]:
        out.append(whole[at : at + n])
        at += n
    return out


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of whole texts: chunk, doc_ids, held_out, lengths (code points), texts (compressed), size in bytes."""

    def gather(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, ([], [], [])

        def out():
            raw = "".join(held[2]).encode("utf-8", "surrogatepass")
            row = {"chunk": [part << 32 | number], "doc_ids": [held[0]], "held_out": [held[1]], "lengths": [[len(t) for t in held[2]]], "texts": [zstandard.ZstdCompressor(level=3).compress(raw)], "size": [len(raw)]}
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        size = 0
        for ids, outs, texts in blocks(batches, ("doc_id", "held_out", "text")):
            for d, h, t in zip(ids, outs, texts, strict=True):
                t = t or ""
                if held[0] and size + len(t) > chunk_bytes:
                    yield out()
                    number, size, held = number + 1, 0, ([], [], [])
                for x, y in zip(held, (d, h, t), strict=True):
                    x.append(y)
                size += len(t)
        if held[0]:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(gather, "chunk bigint, doc_ids array<bigint>, held_out array<boolean>, lengths array<bigint>, texts binary, size bigint")


def score_texts(docs: DataFrame, order: int = ORDER, concentration: float = 20.0, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Log10 probability of every whole text of ``docs``, learned from the rows that are not held out.

    Columns read: doc_id, text. Words are lower-cased (A-Z); each text ends with one end token. Returns doc_id, held_out,
    n_tokens, n_known (tokens seen in training), train_tokens, base_score (root state alone), score. A null text counts as empty:
    the end token alone. A null doc_id counts as the empty id, which is in the training part. With no training rows every
    count is 0 and p(w) = 1; an empty table gives no rows. Words are told apart by 64 bits; longer n-grams by as many bits
    as number the corpus's bytes and ``SPARE_BITS`` more (64 at most), so that one in 2**SPARE_BITS may share another's count.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "chunks")
    chunks = chunked(docs, chunk_bytes)
    chunks.write.parquet(path)
    chunks = spark.read.schema(chunks.schema).parquet(path)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    step, shift = (1 << 64) // ranges + 1, max(0, 64 - SPARE_BITS - size.bit_length())

    def hashed(row, counter):
        """Per order the n-grams that end at each position, longer ones without their lowest bits, and each text's first position."""
        import numpy as np

        grams, first = counter.of(_texts(row))
        low = np.uint64((1 << shift) - 1)
        cut = [grams[0], *(np.where(g == 0, g, np.maximum(g & ~low, low + np.uint64(1))) for g in grams[1:])]
        return cut, first

    def asked(batches):
        import numpy as np
        import pyarrow as pa

        counter = Grams(order)
        kinds = {"chunk": pa.int64(), "range": pa.int64(), "keys": pa.list_(pa.binary()), "counts": pa.list_(pa.binary())}
        for batch in batches:
            for row in batch.to_pylist():
                grams, first = hashed(row, counter)
                train, parts = np.repeat(~np.array(row["held_out"], bool), np.diff(first)), []
                for k, g in enumerate(grams):
                    keys, place = _distinct(g)
                    used = place[train]
                    counts = np.bincount(used[used >= 0], minlength=len(keys)).astype("<u4")
                    cuts = np.searchsorted(keys, np.array([min(i * step, (1 << 64) - 1) for i in range(1, ranges)], np.uint64))
                    parts.append(list(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)))
                rows = [(row["chunk"], r, [_packed(p[r][0], shift if k else 0) for k, p in enumerate(parts)], [_counts_packed(p[r][1]) for p in parts]) for r in range(ranges) if any(len(p[r][0]) for p in parts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def answered(table):
        import numpy as np
        import pyarrow as pa

        chunk, n = table.column("chunk").to_pylist(), table.num_rows
        asked_keys, asked_counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        answers, tokens, types = [[] for _ in range(n)], 0, 0
        for k in range(order):
            keys = [_unpacked(x[k], shift if k else 0) for x in asked_keys]
            all_keys, where = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(where, weights=np.concatenate([_counts_unpacked(x[k], "<u4") for x in asked_counts]).astype(np.float64), minlength=len(all_keys)).astype("<i8")
            for out, x in zip(answers, np.split(where, np.cumsum([len(y) for y in keys])[:-1]), strict=True):
                out.append(_counts_packed(totals[x]))
            if k == 0:
                tokens, types = int(totals.sum()), int((totals > 0).sum())
        part = table.column("range")[0].as_py()
        return pa.Table.from_pydict(
            {"chunk": pa.array([*chunk, None], pa.int64()), "range": pa.array([part] * (n + 1), pa.int64()), "totals": pa.array([*answers, None], pa.list_(pa.binary())), "tokens": pa.array([None] * n + [tokens], pa.int64()), "types": pa.array([None] * n + [types], pa.int64())}
        )

    asking = chunks.select("chunk", "held_out", "lengths", "texts").mapInArrow(asked, "chunk bigint, range bigint, keys array<binary>, counts array<binary>")
    answers = stored(asking.groupBy("range").applyInArrow(answered, "chunk bigint, range bigint, totals array<binary>, tokens bigint, types bigint"), "answers")
    sums = answers.where("chunk is null").agg(F.sum("tokens"), F.sum("types")).first()
    total, types = sums[0] or 0, sums[1] or 0
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def scored(left, right):
        import numpy as np
        import pyarrow as pa

        columns, counter = [[] for _ in range(7)], Grams(order)
        got = [x for _, x in sorted(zip(right.column("range").to_pylist(), right.column("totals").to_pylist(), strict=True))]
        for row in left.to_pylist():
            grams, first = hashed(row, counter)
            places, totals = [], []
            for k, g in enumerate(grams):
                keys, place = _distinct(g)
                counts = np.concatenate([*(_counts_unpacked(x[k], "<i8") for x in got), np.zeros(0, "<i8")])
                if len(counts) != len(keys):
                    raise ValueError(f"chunk {row['chunk']} asked for {len(keys)} n-grams and got {len(counts)}")
                places.append(place)
                totals.append(counts)
            automaton = BackoffAutomaton(places, totals, first, total, types, concentration)
            known = np.add.reduceat((totals[0] > 0)[places[0]].astype(np.int64), first[:-1])
            base = np.add.reduceat(automaton.base[places[0]], first[:-1])
            values = (row["doc_ids"], row["held_out"], np.diff(first), known, np.full(len(first) - 1, total), base, automaton.walk())
            for column, v in zip(columns, values, strict=True):
                column.extend(v)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    mine = answers.where("chunk is not null").select("chunk", "range", "totals")
    return chunks.select("chunk", "doc_ids", "held_out", "lengths", "texts").groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(scored, schema)
