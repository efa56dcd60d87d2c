"""Word hashes and shingle sets, shared by the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import xxhash

from siltstone.llm.common import CACHES

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CACHE = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> 64-bit hash, kept while few; clear() between texts by trim()."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()


WORDS = WordHash()
CACHES["shingles"] = WORDS.clear


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, in order; words are runs without ASCII white space."""
    WORDS.trim()
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; of the whole sequence as one if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(k, len(words))
    count = len(words) - n + 1
    h = np.full(count, n, np.uint64)
    for i in range(n):
        h = mixed(h * M2 + words[i : i + count])
    return h


SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # keeps the first n bytes of eight


def _odd(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


ODD = _odd(64)


def word_codes(text: str | bytes | None) -> np.ndarray:
    """Other hashes of the same words, all at once: of up to 8 bytes (equal lengths: without collisions) and up to 16 by arithmetic, of longer words one by one."""
    data = b" " + (text.encode() if isinstance(text, str) else text or b"").lower() + b" " * 16
    space = SPACES[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    h = mixed((eight[starts] & BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * M1)
    long = np.flatnonzero(size > 8)
    if len(long):
        h[long] = mixed(h[long] * M2 + (eight[starts[long] + 8] & BYTES[np.minimum(size[long] - 8, 8)]))
        for i in long[size[long] > 16].tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]])
    return h


def shingle_codes(text: str | bytes | None, k: int) -> np.ndarray:
    """Hashes of a text's k-word shingles in order, as shingle_hashes gives others: sums of its words' codes, mixed once."""
    words = word_codes(text)
    if not len(words):
        return words
    n = min(k, len(words))
    count = len(words) - n + 1
    h, odd = np.full(count, n, np.uint64), ODD if n <= len(ODD) else _odd(n)
    for i in range(n):
        h += words[i : i + count] * odd[i]
    return mixed(h)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(word_hashes(text), k))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, both non-empty."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)
