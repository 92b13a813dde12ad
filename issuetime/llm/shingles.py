"""Distinct word shingles of whole texts as 64-bit hashes, computed a block of texts at a time with numpy."""

from __future__ import annotations

import re

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PRIME = 0x9E3779B97F4A7C15


def mix(x):
    """A bijective scramble of unsigned 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the lower-cased (A-Z) words of texts: a polynomial over the bytes, by running sums.

    Texts are taken about ``part`` bytes at a time, a longer one cut at white space, so that memory is some 40 times ``part`` besides
    the 8 bytes of each word.
    """

    def __init__(self, part: int = 500_000) -> None:
        import numpy as np

        self.part = part

        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reserve(self, n: int) -> None:
        import numpy as np

        if len(self.powers) < n:
            base = np.uint64(0xD6E8FEB86659FD93)
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(pow(int(base), -1, 1 << 64)))]), dtype=np.uint64)

    def _cuts(self, data: bytes):
        """Pieces of a text that end where a word ends."""
        at = 0
        while len(data) - at > self.part:
            end = _SPACE.search(data, at + self.part)
            if not end:
                break
            yield data[at : end.start()]
            at = end.end()
        yield data[at:]

    def words(self, texts: list[str | None]):
        """Hashes of all words of all texts in a row, and the bounds of each text's words (one more than texts)."""
        import numpy as np

        hashes, counts, held, owners, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            found, bounds = self._hashed(held)
            hashes.append(found)
            np.add.at(counts, owners, np.diff(bounds))
            held.clear()
            owners.clear()

        for i, t in enumerate(texts):
            for piece in self._cuts((t or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
                if held and size + len(piece) > self.part:
                    flush()
                    size = 0
                held.append(piece)
                owners.append(i)
                size += len(piece)
        if held:
            flush()
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])

    def _hashed(self, raw: list[bytes]):
        """Hashes of the words of some lower-cased texts, and each text's bounds."""
        import numpy as np

        data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        self._reserve(len(data) + 1)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.table[data] * self.powers[: len(data)], dtype=np.uint64)])
        hashes = mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(_PRIME))
        ends = np.cumsum([len(r) + 1 for r in raw])
        return hashes, np.concatenate([[0], np.searchsorted(start, ends)])


class Shingler:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one; without words none."""

    def __init__(self, words: int = 5) -> None:
        self.size, self.hasher = words, WordHasher()

    def sets(self, texts: list[str | None]):
        import numpy as np

        hashes, bounds = self.hasher.words(texts)
        factor = mix(np.arange(11, 11 + self.size, dtype=np.uint64))  | np.uint64(1)
        n = max(0, len(hashes) - self.size + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(self.size):
            rolled += hashes[j : j + n] * factor[j]
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= self.size:
                yield np.unique(rolled[a : b - self.size + 1])
            elif b > a:
                short = np.sum(hashes[a:b] * factor[: b - a], dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
