"""Words and shingles of a batch of texts as NumPy arrays (a task's helper).

Words are runs of bytes other than the six ASCII blanks, with A-Z lower-cased;
UTF-8 has no such byte inside a longer character, so whole characters stay
together.  A word's 64-bit hash is a polynomial over its bytes, mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK_BYTES = 2 << 20

_powers = np.ones(64, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        grown = np.full(2 * n, _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    elif _powers[1] == 1:
        first = np.full(len(_powers), _BASE, dtype=np.uint64)
        first[0] = 1
        _powers = np.cumprod(first, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of the public SplitMix64 generator."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    buf: np.ndarray      # lower-cased bytes of all texts
    start: np.ndarray    # first byte of each word
    size: np.ndarray     # bytes of each word
    first: np.ndarray    # index of each text's first word, and the end
    hash: np.ndarray

    def word(self, k: int) -> bytes:
        return self.buf[self.start[k]:self.start[k] + self.size[k]].tobytes()

    def slices(self, at: np.ndarray):
        """The words at the given indices, joined: (bytes, sizes)."""
        size = self.size[at]
        return self.buf[ranges(self.start[at], size)], size

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _hashes(buf, word, start, size, limit=None) -> np.ndarray:
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(word)
    pos = at - np.repeat(start, size)
    value = _BYTE[buf[at]] * powers(int(size.max()) + 1)[pos]
    if limit:
        value[pos >= limit] = 0
    ends = np.cumsum(size) - size
    length = size if limit is None else np.minimum(size, limit)
    return mix(np.add.reduceat(value, ends) + length.astype(np.uint64) * _STEP[63])


def words_of(texts: list[bytes | None]) -> Words:
    blob = b"\n".join([t or b"" for t in texts])
    buf = _LOWER[np.frombuffer(blob, dtype=np.uint8)]
    word = ~_BLANK[buf]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start = np.flatnonzero(edge == 1)
    size = np.flatnonzero(edge == -1) - start
    begins = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    return Words(buf, start, size, np.searchsorted(start, begins), _hashes(buf, word, start, size))


def prefix_hashes(w: Words, length: int) -> np.ndarray:
    """Hash of each word's first ``length`` bytes (of the whole word if shorter)."""
    word = ~_BLANK[w.buf]
    return _hashes(w.buf, word, w.start, w.size, length)


def chunks(rows: list, size_of, limit: int = CHUNK_BYTES):
    """Split rows into runs of about ``limit`` bytes (one row at least)."""
    run, total = [], 0
    for r in rows:
        n = size_of(r)
        if run and total + n > limit:
            yield run
            run, total = [], 0
        run.append(r)
        total += n
    if run:
        yield run


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several aligned hashes, in order."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    for j, p in enumerate(parts):
        total = total + p * _STEP[j]
    return mix(total + np.uint64(len(parts)))


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a shorter text's whole
    word sequence is its one shingle, a text without words has none."""
    n = len(w.hash)
    all_windows = combine([w.hash[j:n - k + 1 + j] for j in range(k)]) if n >= k else None
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(all_windows[a:b - k + 1]))
        elif b > a:
            out.append(combine([w.hash[a + j:a + j + 1] for j in range(b - a)]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
