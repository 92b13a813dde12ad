"""Token ids of whole texts inside Arrow tasks, through the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

# The byte-level pre-tokenizer's pieces and its characters for bytes, for texts in the characters below.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁞]")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARACTER = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_encoders: dict[str, PieceEncoder] = {}


def _plain_byte_level(tokenizer) -> bool:
    """Whether a text's ids are those of its pieces, one after another: a byte-level BPE that changes and drops nothing."""
    form = json.loads(tokenizer.to_str())
    before, model = form.get("pre_tokenizer") or {}, form["model"]
    pieces = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return bool(pieces and model.get("type") == "BPE" and not any(model.get(k) for k in odd)) and not form.get("normalizer") and not form.get("truncation")


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A byte-level BPE encodes each piece of its pre-tokenizer by itself, so each distinct piece goes to the tokenizer's model
    once and its ids are kept. Kept pieces make two generations of at most ``limit`` bytes each: a full one becomes the old
    one, from which a piece that comes again moves to the new. Texts with an added token or with characters whose class
    could depend on the Unicode version go to the tokenizer as they are, and so do all texts if the file describes another
    kind of tokenizer.
    """

    def __init__(self, path: str, limit: int = 48 << 20, longest: int = 40) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.longest = Tokenizer.from_file(path), limit, longest
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.by_piece = self.tokenizer.model, _plain_byte_level(self.tokenizer)
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    @staticmethod
    def shared(path: str) -> PieceEncoder:
        """This worker process's encoder; its kept pieces serve all tasks that run here."""
        if path not in _encoders:
            _encoders[path] = PieceEncoder(path)
        return _encoders[path]

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin1").translate(_CHARACTER))]).tobytes()

    def _known(self, piece: str) -> bytes:
        """Ids of a piece that the new generation lacked when its text began."""
        ids = self.old.get(piece)
        if ids is None:
            ids = self.kept.get(piece)
            if ids is not None:
                return ids
            ids = self._piece(piece)
        if len(piece) <= self.longest:
            self.kept[piece] = ids
            self.size += 200 + 2 * len(piece)  # about what the two objects and their entry take
            if self.size > self.limit:
                self.kept, self.old, self.size = {}, self.kept, 0
        return ids

    def _joined(self, pieces: list[str]) -> bytes:
        ids = list(map(self.kept.get, pieces))
        at = -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            ids[at] = self._known(pieces[at])
        return b"".join(ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        out = []
        for t in texts:
            if t and (not self.by_piece or _OTHER.search(t) or any(a in t for a in self.added)):
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
            elif t and len(t) > 1_000_000:  # piece by piece, so that a very long text's pieces are never held together
                found, parts = (m[0] for m in _PIECES.finditer(t)), []
                while group := list(islice(found, 50_000)):
                    parts.append(self._joined(group))
                out.append(b"".join(parts))
            else:
                out.append(self._joined(_PIECES.findall(t or "")))
        return out


def blocks(batches, columns: tuple[str, ...], text: str = "text", rows: int = 256, chars: int = 1_000_000):
    """Lists of the columns' values, a bounded number of rows and characters at a time, from Arrow batches."""
    import pyarrow.compute as pc

    for batch in batches:
        values = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        lengths = pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        i = 0
        while i < len(lengths):
            j, total = i, 0
            while j < len(lengths) and j - i < rows and (j == i or total + lengths[j] <= chars):
                total += lengths[j]
                j += 1
            yield [v.slice(i, j - i).to_pylist() for v in values]
            i = j
