"""Language of texts by unigram models over a fixed public vocabulary of pieces, summed over all segmentations.

A text is a row of words; a word with its start mark is cut into pieces of the vocabulary in any way, and its probability in a language is
the sum over all cuts of the product of that language's piece probabilities, which a forward pass over the word's characters gives. Piece
probabilities are learned from words counted by language over all training texts, by expectation maximisation: a forward and a
backward pass give the number of times that each piece is expected in a word. The pieces themselves are never learned.

Words are counted within each task before they are shuffled. The driver gets one number per language and piece. Batches of
words go through the passes together, as arrays of edges (word, start, end, piece).
"""

from __future__ import annotations

import re
import unicodedata
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuetime.llm.common import stored
from issuetime.llm.tokens import blocks

#: Longer runs of letters count as several words, so that no product of probabilities leaves the range of doubles.
LONGEST = 32
ROUNDS, SMOOTHING, FLOOR = 2, 0.1, 1e-9
START, WIDE = "▁", 1 << 21  # more than there are characters
_WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
_vocabularies: dict[str, Pieces] = {}


class Pieces:
    """Numbers (from 1) of a vocabulary's pieces of lower-case letters, with or without the mark of a word's start; 0 is a character without a piece.

    Beginnings of pieces are the nodes of a trie, held as sorted (node, character) steps.
    """

    def __init__(self, pieces: list[str]) -> None:
        import numpy as np

        usable = sorted({p for p in pieces if p == START or p.removeprefix(START).isalpha() and p == p.lower()})
        self.ids = {p: i for i, p in enumerate(usable, 1)}
        nodes = {p: i for i, p in enumerate(sorted({p[:n] for p in usable for n in range(1, len(p) + 1)}), 1)}
        self.piece = np.zeros(len(nodes) + 1, np.int32)  # of each beginning the piece that it is, 0 if none
        for p, i in self.ids.items():
            self.piece[nodes[p]] = i
        steps = sorted((nodes.get(p[:-1], 0) * WIDE + ord(p[-1]), i) for p, i in nodes.items())
        self.step, self.to = (np.array([x[i] for x in steps], np.int64) for i in (0, 1))

    @staticmethod
    def shared(path: str) -> Pieces:
        """The pieces of a sentencepiece model file, once for each worker process."""
        if path not in _vocabularies:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            _vocabularies[path] = Pieces([model.id_to_piece(i) for i in range(model.get_piece_size())])
        return _vocabularies[path]

    def edges(self, words: list[str]):
        """The lattice of each word as arrays word, start, end, piece, by ascending end; every character has an edge of its own."""
        import numpy as np

        sizes = np.array([len(w) + 1 for w in words])
        letters = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends, word = np.cumsum(sizes), np.repeat(np.arange(len(words)), sizes)
        first, stop = (ends - sizes)[word], ends[word]
        start, node, length, found = np.arange(len(letters)), np.zeros(len(letters), np.int64), 1, []
        while len(start):  # one more character of every beginning that goes on
            key = node * WIDE + letters[start + length - 1]
            at = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
            known = self.step[at] == key
            node = np.where(known, self.to[at], 0)
            edge = self.piece[node] > 0 if length > 1 else np.ones(len(start), bool)
            found.append((word[start[edge]], start[edge], start[edge] + length, self.piece[node[edge]]))
            on = known & (start + length < stop[start])
            start, node, length = start[on], node[on], length + 1
        word, start, end, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(end - first[start], kind="stable")
        start, base = start[order], first[start[order]]
        return word[order], start - base, end[order] - base, piece[order]


def _forward(edges, weights, n: int, longest: int):
    """Per word and character the sum over the cuts up to it. ``weights``: of each edge."""
    import numpy as np

    word, start, end, _ = edges
    sums = np.zeros((longest + 1, n))
    sums[0] = 1
    cuts = np.searchsorted(end, np.arange(1, longest + 2))
    for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
        sums[j] = np.bincount(word[a:b], sums[start[a:b], word[a:b]] * weights[a:b], n)
    return sums


def _backward(edges, weights, ends):
    """Per word and character the sum over the cuts from it to the word's end."""
    import numpy as np

    word, start, end, _ = edges
    n, longest = len(ends), int(ends.max())
    sums = np.zeros((longest + 1, n))
    sums[ends, np.arange(n)] = 1
    order = np.argsort(-start, kind="stable")
    cuts = np.searchsorted(-start[order], np.arange(-longest + 1, 2))
    for i, (a, b) in zip(range(longest - 1, -1, -1), zip(cuts, cuts[1:], strict=False), strict=False):
        e = order[a:b]
        sums[i] += np.bincount(word[e], sums[end[e], word[e]] * weights[e], n)
    return sums


def log_probabilities(words: list[str], pieces: Pieces, table):
    """Natural logs of the words' probabilities, (words, languages). ``table``: probabilities by (piece, language)."""
    import numpy as np

    out, by_length = np.zeros((len(words), table.shape[1])), sorted(range(len(words)), key=lambda i: len(words[i]))
    for k in range(0, len(words), 4096):
        some = by_length[k : k + 4096]
        edges, ends = pieces.edges([words[i] for i in some]), np.array([len(words[i]) + 1 for i in some])
        for c in range(table.shape[1]):
            sums = _forward(edges, table[edges[3], c], len(some), int(ends.max()))
            out[some, c] = np.log(sums[ends, np.arange(len(some))])
    return out


def expected_counts(words: list[str], counts, columns, pieces: Pieces, table):
    """How often each piece is expected in ``counts`` times each word, by (piece, language); ``columns``: each word's language."""
    import numpy as np

    edges, ends = pieces.edges(words), np.array([len(w) + 1 for w in words])
    word, start, end, piece = edges
    weights = table[piece, columns[word]]
    before, after = _forward(edges, weights, len(words), int(ends.max())), _backward(edges, weights, ends)
    share = before[start, word] * weights * after[end, word] / after[0, word]
    return np.bincount(piece * table.shape[1] + columns[word], share * counts[word], table.size).reshape(table.shape)


def words_of(text: str | None):
    """The words of a text as lists of bounded length: lower-cased runs of letters (and of numbers that are not digits)."""
    if text:
        text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        if len(text) <= 1_000_000:
            yield _WORD.findall(text)
        else:
            found = (m[0] for m in _WORD.finditer(text))
            while group := list(islice(found, 50_000)):
                yield group


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", held: int = 200_000) -> DataFrame:
    """lang, word, n over all of ``docs`` with a text and a language; each task holds at most about ``held`` words at a time."""

    def counted(batches):
        from collections import Counter, defaultdict

        import pyarrow as pa

        def table():
            rows = [(lang, w, n) for lang, words in counts.items() for w, n in words.items() if has_letter(w)]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        counts = defaultdict(Counter)
        for texts, langs in blocks(batches, ("text", "lang")):
            for text, lang in zip(texts, langs, strict=True):
                for words in words_of(text):
                    counts[lang].update(words)
            if sum(map(len, counts.values())) > held:
                yield table()
                counts = defaultdict(Counter)
        yield table()

    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """Languages in ascending order and the probabilities of the vocabulary's pieces by (piece, language)."""

    path: str
    languages: list
    table: object

    def predict(self, docs: DataFrame, keep: tuple = ("doc_id",), text_col: str = "text", kept_words: int = 64 << 20) -> DataFrame:
        """The columns ``keep`` with lang_pred and score, the language's probability if all are equally likely before.

        ``und`` and 0 for texts that are null or have no letters, and for all without a learned language; equal probabilities go to the smaller name.
        A task keeps the sums of words it has seen, ``kept_words`` bytes at most.
        """
        path, languages, table = self
        types = dict(docs.dtypes)

        def predicted(batches):
            import numpy as np
            import pyarrow as pa

            pieces, limit = Pieces.shared(path), max(1, kept_words // (150 + 8 * len(languages)))
            known, sums = {"": 0}, np.zeros((1, len(languages)))

            def lookup(words):
                nonlocal known, sums
                if new := list(set(words).difference(known)):
                    if len(known) + len(new) > limit:
                        known, sums, new = {"": 0}, np.zeros((1, len(languages))), list(set(words))
                    lettered = [w for w in new if has_letter(w)]
                    known.update(dict.fromkeys(set(new).difference(lettered), 0))
                    known.update(zip(lettered, range(len(sums), len(sums) + len(lettered)), strict=True))
                    sums = np.concatenate([sums, log_probabilities(lettered, pieces, table)])
                return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

            for batch in batches:
                names, scores = [], []
                for (texts,) in blocks([batch], ("_text",), "_text"):
                    groups = [(i, words) for i, text in enumerate(texts) for words in (words_of(text) if languages else ())]
                    total, lettered = np.zeros((len(texts), len(languages))), np.zeros(len(texts), bool)
                    if len(groups) <= len(texts):  # one look for all words of the block
                        at = np.split(lookup([w for _, words in groups for w in words]), np.cumsum([len(w) for _, w in groups])[:-1]) if groups else []
                    else:
                        at = [None] * len(groups)
                    for (i, words), places in zip(groups, at, strict=True):
                        places = lookup(words) if places is None else places
                        total[i] += sums[places].sum(axis=0)
                        lettered[i] |= bool(places.any())
                    for row, some in zip(total, lettered, strict=True):
                        best = int(row.argmax()) if some else 0
                        names.append(languages[best] if some else "und")
                        scores.append(round(float(1 / np.exp(row - row[best]).sum()), 6) if some else 0.0)
                columns = [batch.column(batch.schema.get_field_index(f"_keep{i}")) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

        inner = docs.select(*(F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").alias("_text"))
        return inner.mapInArrow(predicted, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", lang_pred string, score double")


def fit(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> Model:
    """A model of every language in ``docs`` (text, lang), from all its texts. Rows with a null text or language teach nothing.

    The table on the driver has a number per language and piece of the vocabulary, whatever the size of ``docs``.
    """
    import numpy as np

    words = stored(word_counts(docs), "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    size, names = len(Pieces.shared(vocabulary).ids) + 1, {lang: i for i, lang in enumerate(languages)}
    table = np.full((size, len(languages)), 1 / size)

    def counted(batches):
        import pyarrow as pa

        pieces, sums = Pieces.shared(vocabulary), np.zeros(table.shape)
        for batch in batches:
            langs, found, n = (batch.column(i).to_pylist() for i in range(3))
            order = sorted(range(len(found)), key=lambda i: len(found[i]))
            for k in range(0, len(order), 4096):
                some = order[k : k + 4096]
                sums += expected_counts([found[i] for i in some], np.array([n[i] for i in some], float), np.array([names[langs[i]] for i in some]), pieces, table)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], names=["at", "expected"])

    for _ in range(rounds if languages else 0):
        found = words.select("lang", "word", "n").mapInArrow(counted, "at bigint, expected double").groupBy("at").agg(F.sum("expected").alias("expected")).toPandas()
        sums = np.zeros(table.size)
        sums[found["at"].to_numpy()] = found["expected"].to_numpy().round(6)
        sums = sums.reshape(table.shape) + SMOOTHING
        table = np.maximum(sums / sums.sum(axis=0), FLOOR)
    return Model(vocabulary, languages, table)


def identify_languages(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (columns read: doc_id, text, lang), learned from those that are not held out.

    Held out is what has a crc32 of its id (null: empty) divisible by 5. Null ids and repeated rows are scored each; texts that are null or have no
    letter are ``und`` with score 0, as are all if nothing could be learned; texts of any length are read whole; an empty table gives no rows.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), vocabulary)
    return model.predict(rows.select("doc_id", "held_out", "text"), ("doc_id", "held_out"))
