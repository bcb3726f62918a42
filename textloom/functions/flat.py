"""Text of many rows as one flat array of code points, so that splitting and hashing run in numpy without a Python object
a word. Used inside Arrow batches."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points in one piece of work; bounds memory whatever the batch size. A longer text is a piece of its own.
CHUNK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space (the White_Space property) or other."""
    first = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    t[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    t[0x2000:0x200B] = SPACE
    return t


@functools.cache
def code_values() -> np.ndarray:
    """A well mixed 64-bit number for every code point."""
    x = np.arange(0x110000, dtype=np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for mult, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return x ^ (x >> np.uint64(31))


class Flat:
    """cp: code points; off: where each row's text begins, and the end."""

    def __init__(self, cp: np.ndarray, off: np.ndarray):
        self.cp, self.off = cp, off

    @functools.cached_property
    def cls(self) -> np.ndarray:
        return classes().take(self.cp)

    def text(self, start: int, end: int) -> str:
        return self.cp[start:end].tobytes().decode("utf-32-le", "surrogatepass")

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of ``mask`` that don't cross rows."""
        n = len(mask)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[0] = edge[n] = True
        edge[1:n] = mask[1:] != mask[:-1]
        edge[self.off] = True
        at = np.flatnonzero(edge)
        keep = mask[at[:-1]]
        return at[:-1][keep], at[1:][keep]

    def rows_of(self, pos: np.ndarray) -> np.ndarray:
        """The row that each position lies in."""
        return np.searchsorted(self.off, pos, "right") - 1

    @functools.cached_property
    def _prefix(self):
        n = len(self.cp)
        with np.errstate(over="ignore"):
            powers = _powers(n + 1)
            p = np.zeros(n + 1, np.uint64)
            np.cumsum(code_values().take(self.cp) * powers[:n], out=p[1:])
        return p

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the stretches, equal for equal strings."""
        p = self._prefix
        with np.errstate(over="ignore"):
            h = (p[end] - p[start]) * _inverses(len(self.cp) + 1)[start] + (end - start).astype(np.uint64) * _MULT
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


_cache: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    t = _cache.get(name)
    if t is None or len(t) < n:
        with np.errstate(over="ignore"):
            t = np.full(max(n + n // 8, 1 << 16), base, np.uint64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
        _cache[name] = t
    return t


def _powers(n: int) -> np.ndarray:
    return _table("powers", _BASE, n)


def _inverses(n: int) -> np.ndarray:
    return _table("inverses", np.uint64(pow(int(_BASE), -1, 1 << 64)), n)


def flatten(col: pa.Array, nfc: bool = False, lower: bool = False, chunk: int = CHUNK) -> Iterator[tuple[int, int, Flat]]:
    """(first row, row after the last, Flat) of pieces of a string column; null is as empty. Texts with a broken surrogate
    can't occur in Arrow. ``nfc`` and ``lower`` change texts before they're cut, each by itself. ``chunk``: about how many bytes a piece has."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and len(col) else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        to = max(int(np.searchsorted(off, off[row] + chunk, "right")) - 1, row + 1)
        data = raw[off[row] : off[to]]
        s = data.tobytes().decode("utf-8")
        cut = off[row : to + 1] - off[row]
        cut = cut - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), cut)
        # Before U+0300, whose first byte is 0xCC, NFC changes nothing and no letter's lower case depends on its neighbours.
        plain = not (nfc or lower) or not (data >= 0xCC).any()
        small = s.lower() if lower and plain else s
        if not plain or len(small) != len(s):
            parts = [s[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            parts = [unicodedata.normalize("NFC", p) for p in parts] if nfc else parts
            parts = [p.lower() for p in parts] if lower else parts
            s, cut = "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        else:
            s = small
        yield row, to, Flat(np.frombuffer(s.encode("utf-32-le"), np.uint32), cut)
        row = to
