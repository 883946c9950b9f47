"""Vectorised word hashing of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words are hashed in slices of about so many bytes, so memory doesn't follow the batch.
SLICE = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators: the space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators: all of ASCII but letters and digits.
PUNCT = np.zeros(256, bool)
PUNCT[:128] = [not chr(i).isalnum() for i in range(128)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _coefficients(places: np.ndarray, salt: int) -> np.ndarray:
    """An odd 64-bit number for each place."""
    return mix(places.astype(np.uint64) + np.uint64(salt)) | np.uint64(1)


#: A number for each byte, A-Z like a-z, and for each of the first places of a word.
_BYTE = _coefficients(LOWER, 0x5851F42D4C957F2D)
_SALT = 0x14057B7EF767814F
_PLACE = _coefficients(np.arange(1 << 12), _SALT)


class Words:
    """Hashes of the words of some texts: h, the words' hashes; at, where each text's begin (one more at the end).

    A word's hash is the sum of its bytes' numbers, each times the number of its place in the word, and its length's: numbers
    that follow no power or pattern, so no kinds of words are alike by construction, as they can be under a polynomial
    modulo a power of two. Two words have equal hashes with a probability of about 2 to the -60."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, prefix: int = 0, suffix: int = 0):
        self.h = self.prefix = self.suffix = np.zeros(0, np.uint64)
        self.at = np.zeros(len(offsets), np.int64)
        if len(data) == 0:
            return
        word = ~sep[data]
        edge = word.copy()
        edge[1:] &= ~word[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        edge[first] = word[first]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = word[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
        start, end = np.flatnonzero(edge), np.flatnonzero(last) + 1
        self.at = np.searchsorted(start, offsets)
        if len(start) == 0:
            return
        size = end - start
        inside = np.flatnonzero(word)
        begin = np.cumsum(size) - size  # of each word, among the bytes inside words
        place = inside - np.repeat(start, size)
        number = _PLACE[np.minimum(place, len(_PLACE) - 1)]
        far = np.flatnonzero(place >= len(_PLACE))
        if len(far):
            number[far] = _coefficients(place[far], _SALT)
        self.h = mix(np.add.reduceat(_BYTE[data[inside]] * number, begin) + mix(size.astype(np.uint64)))
        if prefix:
            self.prefix = self._short(data, start, np.minimum(size, prefix))
        if suffix:
            self.suffix = self._short(data, end - np.minimum(size, suffix), np.minimum(size, suffix))

    @staticmethod
    def _short(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = mix(size.astype(np.uint64))
        for k in range(int(size.max())):
            some = size > k
            total[some] += _BYTE[data[start[some] + k]] * _PLACE[k]
        return mix(total)


def slices(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of slices of about SLICE bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of hashes of k following words, sorted, one text after another, and where each begins.

    A text of fewer words has its whole sequence as its one shingle; one without words none.
    """
    n = np.diff(words.at)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    rows = np.repeat(np.arange(len(n)), count)
    place = words.at[:-1][rows] + (np.arange(to[-1]) - to[:-1][rows])
    size = np.minimum(n, k)[rows]
    h = np.full(len(rows), 0x51ED270B, np.uint64)
    for j in range(k):
        use = size > j
        nxt = mix(h * np.uint64(31) + words.h[np.minimum(place + j, max(len(words.h) - 1, 0))]) if len(words.h) else h
        h = np.where(use, nxt, h)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    return h, np.searchsorted(rows, np.arange(len(n) + 1))
