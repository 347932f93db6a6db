"""Words and word hashes of whole texts, on their UTF-8 bytes.

Used inside tasks. ``bytes.lower`` folds A-Z only and ``bytes.split`` cuts at
space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a task remembers; the memo is emptied when it is full.
MEMO_WORDS = 150_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = MEMO_WORDS):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
#: Lowest bytes of eight that belong to a word of so many bytes.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def words_at(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes with A-Z and white space folded, and the starts and sizes of the words in them."""
    data = data.translate(_FOLD)
    word = np.frombuffer(b" " + data + b" ", dtype=np.uint8) != 32
    edges = np.flatnonzero(word[1:] != word[:-1])
    return data, edges[::2], edges[1::2] - edges[::2]


def hashes_at(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places, eight bytes of all words at a time."""
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    out = mix(eight[start] & _LOWEST[np.minimum(size, 8)]) + size.astype(np.uint64) * GOLDEN
    long, done = np.flatnonzero(size > 8), 8
    while len(long):
        left = size[long] - done
        out[long] = mix(out[long] * GOLDEN + (eight[start[long] + done] & _LOWEST[np.minimum(left, 8)]))
        long, done = long[left > 8], done + 8
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` consecutive words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return hashes[:0]
    out = mix(hashes[:count])
    for step in range(1, size):
        out = mix(out * GOLDEN + hashes[step : step + count])
    return out


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; a shorter text is one shingle."""
    if len(hashes) == 0:
        return hashes
    return np.unique(runs(hashes, min(size, len(hashes))))
