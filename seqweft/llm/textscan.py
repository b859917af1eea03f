"""Words of many texts at once: boundaries and 64-bit hashes worked out on the bytes of a whole Arrow column by numpy.

A word's hash is the sum mod 2^64 of a random-looking number for each (byte, place in the word), mixed: prefix sums over
the buffer give every word, and every prefix of a word, by one subtraction. The numbers come from a table made by a
fixed rule; no structure of a word (as with powers of one base) makes sums of different words equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import string_array

#: Bytes that are worked on at once (one row may be larger), so that arrays stay small whatever the batch.
STEP = 1 << 20
#: Places of a word with rows of their own in the table; later ones use its rows again, times a number for each turn.
PLACES = 64
#: Separators of words: ASCII white space. And of letter runs: all ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
OTHERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER = _TABLE.reshape(PLACES, 256).copy()
_LOWER[:, 65:91] = _LOWER[:, 97:123]
_LOWER = _LOWER.ravel()


def pieces(column):
    """(first row, texts' bytes, offsets) of runs of rows of about STEP bytes."""
    col = string_array(column)
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + STEP, "right")) - 1)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """Words of a piece: start, end (bytes), and for each row the place of its first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, separators=SPACES):
        apart = separators[data]
        n = len(data)
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:n] = apart[:-1] if n else False
        after[: n - 1 if n else 0] = apart[1:]
        before[offs[:-1]] = True
        after[offs[1:][offs[1:] > offs[:-1]] - 1] = True
        inside = ~apart
        self.data, self.inside = data, inside
        self.start = np.flatnonzero(inside & before[:n])
        self.end = np.flatnonzero(inside & after[:n]) + 1
        self.first = np.searchsorted(self.start, offs)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
        """Of whole words, then of their first n bytes for each n (of shorter words: of the whole word)."""
        size = self.end - self.start
        place = np.flatnonzero(self.inside)
        letters = self.data[place]
        place -= np.repeat(self.start, size)
        value = (_LOWER if lower else _TABLE)[(place & PLACES - 1) << 8 | letters]
        if len(place) and place.max() >= PLACES:
            turn = place // PLACES
            value *= np.where(turn > 0, mix(turn.astype(np.uint64)) | np.uint64(1), np.uint64(1))
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        begin = np.cumsum(size) - size
        return [mix(total[begin + n] - total[begin] + n.astype(np.uint64)) for n in (size, *(np.minimum(size, k) for k in prefixes))]


def coded(data: np.ndarray, words: Words) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal ones for equal bytes, and the words by their numbers."""
    offs = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    body = np.ascontiguousarray(data[words.inside])
    column = pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(body)]).dictionary_encode()
    return np.asarray(column.indices).astype(np.int64), column.dictionary


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive values, order counted; by doubling. len(h) - size + 1 values."""
    step = np.uint64(0xA0761D6478BD642F)
    have, length = h, 1
    out, done = None, 0
    rest = size
    while rest:
        if rest & 1:
            if out is None:
                out, done = have, length
            else:
                k = len(h) - done - length + 1
                if k <= 0:
                    return np.zeros(0, np.uint64)
                out, done = out[:k] + have[done : done + k] * np.uint64(pow(int(step), done, 1 << 64)), done + length
        rest >>= 1
        if rest:
            k = len(have) - length
            if k <= 0:
                return np.zeros(0, np.uint64)
            have, length = have[:k] + have[length : length + k] * np.uint64(pow(int(step), length, 1 << 64)), 2 * length
    return mix(out)
