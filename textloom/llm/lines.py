"""One pass over texts that gives, for each line, a 128-bit key of its normal form within its source and a few counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from ..functions.flat import LETTER, NUMBER, OTHER, SPACE, Flat, _powers, code_values, flatten

_BASE2 = 0xA24BAED4963EE407
_START = np.uint64(0x7F4A7C159E3779B9)
#: Counts of a line, in the order of their columns in ``feats``.
FEATS = ("chars", "words", "letters", "common", "vowelless", "numbers", "symbols", "longest", "distinct", "item", "row", "junk", "marked", "stop")
#: Punctuation of ordinary prose; other characters that are neither letters, numbers nor blanks count as symbols.
PLAIN = ".,;:!?'\"()¿¡-–—%…’‘“”«»•·/*"
VOWELS = "aeiouyáéíóúýàèìòùâêîôûäëïöüÿãõåæœøı"
BULLETS = "*•-–—·‣◦▪"
CODE = "{}[]<>=;&|\\"


class _Second:
    powers = np.zeros(0, np.uint64)
    inverses = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.powers) < n:
            with np.errstate(over="ignore"):
                for name, base in (("powers", _BASE2), ("inverses", pow(_BASE2, -1, 1 << 64))):
                    t = np.full(n + (1 << 17), base, np.uint64)
                    t[0] = 1
                    setattr(cls, name, np.multiply.accumulate(t))
        return cls.powers, cls.inverses


def cut_lines(f: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line_no, start, end) of every line; rows of no text have one empty line."""
    nl = np.flatnonzero(f.cp == 10)
    start, end = np.sort(np.concatenate([f.off[:-1], nl + 1])), np.sort(np.concatenate([nl, f.off[1:]]))
    many = np.diff(np.searchsorted(nl, f.off)) + 1
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many), start, end


def normal_keys(f: Flat, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line's normal form, and whether it has any letter or number. The text must be in NFC and lower
    case. A line's normal form is its sequence of words, with each run of 0-9 as one 0: each character that stays is hashed
    together with whether it begins a word."""
    from ..functions.flat import _inverses

    c, cp = f.cls, f.cp
    n = len(cp)
    word = (c == LETTER) | (c == NUMBER)
    digit = (cp >= 48) & (cp <= 57)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    again = digit.copy()
    again[1:] &= digit[:-1]
    if n:
        again[0] = False
        at = f.off[f.off < n]
        begins[at] = word[at]
        again[at] = False
    keep = np.flatnonzero(word & ~again)
    with np.errstate(over="ignore"):
        v = code_values().take(np.where(digit[keep], 48, cp[keep])) + begins[keep] * _START
        m = len(keep)
        a, b = np.searchsorted(keep, start), np.searchsorted(keep, end)
        out = []
        second = _Second.of(m + 1)
        for powers, inverses in ((_powers(m + 1), _inverses(m + 1)), second):
            p = np.zeros(m + 1, np.uint64)
            np.cumsum(v * powers[:m], out=p[1:])
            h = (p[b] - p[a]) * inverses[a] + (b - a).astype(np.uint64)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x94D049BB133111EB)
            out.append(h ^ (h >> np.uint64(29)))
    return out[0], out[1], b > a


def _table(chars: str) -> np.ndarray:
    t = np.zeros(0x110000, bool)
    t[[ord(x) for x in chars]] = True
    return t


_tables: dict[str, np.ndarray] = {}


def _in(name: str, chars: str, cp: np.ndarray) -> np.ndarray:
    if name not in _tables:
        _tables[name] = _table(chars)
    return _tables[name].take(cp)


def hash_words(words: list[str]) -> np.ndarray:
    """Sorted hashes of words, as ``Flat.hashes`` gives them."""
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    f = Flat(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), off)
    return np.sort(f.hashes(off[:-1], off[1:]))


def is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def line_counts(f: Flat, start: np.ndarray, end: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A row of ``FEATS`` for each line."""
    cp, c, n = f.cp, f.cls, len(f.cp)
    lines = len(start)

    def per(mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return np.searchsorted(at, end) - np.searchsorted(at, start)

    word = (c == LETTER) | (c == NUMBER)
    ws, we = f.runs(word)
    size = we - ws
    words = np.searchsorted(ws, end) - np.searchsorted(ws, start)
    owner = np.repeat(np.arange(lines), words)  # words don't cross lines
    of = lambda mask: np.bincount(np.searchsorted(ws, np.flatnonzero(mask), "right") - 1, minlength=len(ws))
    h = f.hashes(ws, we)
    letters = size - of(c == NUMBER)
    s = np.zeros(n + 1, np.int32)
    np.cumsum(_in("vowels", VOWELS, cp), dtype=np.int32, out=s[1:])
    vowels = s[we] - s[ws]
    latin = of(word & (cp >= 0x250)) == 0
    by = lambda m: np.bincount(owner[m], minlength=lines)
    comm = by(is_in(h, common))
    vowelless = by((letters >= 3) & (letters == size) & (vowels == 0) & latin)
    numbers = by(letters == 0)
    longest = np.zeros(lines, np.int64)
    np.maximum.at(longest, owner, size)
    with np.errstate(over="ignore"):
        again = pd.Series(h * np.uint64(0x9E3779B97F4A7C15) + owner.astype(np.uint64)).duplicated().to_numpy()
    distinct = by(~again)
    solid = np.flatnonzero(c != SPACE)
    first, back = np.searchsorted(solid, start), np.searchsorted(solid, end)
    chars = back - first
    symbols = per((c == OTHER) & ~_in("plain", PLAIN, cp))
    code = per(_in("code", CODE, cp))
    # Cells: the most frequent delimiter, or stretches of several blanks.
    gap = np.zeros(n, bool)
    if n > 2:
        gap[1:-1] = (cp[1:-1] == 32) & (cp[2:] == 32) & (cp[:-2] != 32) & (cp[:-2] != 10)
    delims = np.stack([per(cp == ord("|")), per(cp == 9), per(cp == ord(";")), per(cp == ord(",")), per(gap)]) if lines else np.zeros((5, 0), int)
    cells = delims.max(0) + 1
    # The first characters after blanks.
    solid = np.append(solid, n)
    p = np.minimum(solid[np.minimum(first, len(solid) - 1)], end)
    pad = np.concatenate([cp, np.zeros(6, cp.dtype)])
    x0, x1, x2, x3, x4 = (pad[p + i] for i in range(5))
    digit = lambda x: (x >= 48) & (x <= 57)
    close = lambda x: (x == 41) | (x == 46)
    space = lambda x: (x == 32) | (x == 9) | (x == 0xA0)
    isletter = np.concatenate([c, np.zeros(6, c.dtype)])[p] == LETTER
    marked = (p < end) & (
        (_in("bullets", BULLETS, x0) & space(x1))
        | (digit(x0) | isletter) & close(x1) & space(x2)
        | digit(x0) & digit(x1) & close(x2) & space(x3)
        | digit(x0) & digit(x1) & digit(x2) & close(x3) & space(x4)
        | (x0 == 40) & (x2 == 41) & space(x3)
    )
    q = solid[np.maximum(back - 1, 0)]
    stop = (chars > 0) & _in("stop", ".!?…", pad[np.minimum(q, n)])
    w1, ch1 = np.maximum(words, 1), np.maximum(chars, 1)
    row = (chars > 0) & (cells >= 3) & (words <= 2.2 * cells) & (comm <= 0.25 * w1) & (longest < 40) & (symbols - delims[0] <= 0.3 * ch1)
    junk = (chars > 0) & ~row & (
        (symbols > 0.25 * ch1)
        | ((vowelless >= 0.5 * w1) & (words >= 3))
        | ((numbers >= 0.6 * w1) & (words >= 6))
        | ((longest >= 40) & (longest > 0.5 * ch1))
        | ((words >= 8) & (distinct < 0.35 * w1))
        | ((code > 0.1 * ch1) & (code >= 4))
    )
    item = (chars > 0) & ~row & ~junk & (marked | ((words <= 7) & ~stop & (words > 0)))
    by_size = np.bincount(owner, size, lines)
    out = np.stack([chars, words, by_size, comm, vowelless, numbers, symbols, longest, distinct, item, row, junk, marked, stop], 1)
    return out.astype(np.float32)


def _source_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each source's key, and whether there's a source. Sources as ``source_key`` spells them."""
    import re

    names = pd.Series(col.to_pylist(), dtype=object)
    code, distinct = pd.factorize(names)
    keys = ["_".join(re.split(r"\s+", x.strip())).lower() for x in distinct]
    import xxhash

    ab = np.array([[xxhash.xxh64_intdigest(k, seed) for seed in (1, 2)] for k in keys] or [[0, 0]], np.uint64)
    return ab[code, 0], ab[code, 1], code >= 0


def line_keys(batch: pa.RecordBatch, lo: int, to: int, f: Flat, sources) -> tuple[np.ndarray, ...]:
    """(row, start, end, a, b) of the lines of a piece: keys of their normal form in their source, both 0 where a line can't count
    as repeated. ``sources`` as ``_source_hashes`` gives them."""
    s1, s2, there = sources
    row, _, start, end = cut_lines(f)
    h1, h2, counts = normal_keys(f, start, end)
    counts &= there[lo:to][row]
    with np.errstate(over="ignore"):
        a = np.where(counts, (h1 ^ s1[lo:to][row]) * np.uint64(0x9E3779B97F4A7C15), 0).astype(np.uint64).view(np.int64)
        b = np.where(counts, (h2 + s2[lo:to][row]) | np.uint64(1), 0).astype(np.uint64).view(np.int64)
    return row, start, end, a, b


def scan_lines(docs: DataFrame, common_words: list[str] | None = None) -> DataFrame:
    """(doc_id, source_id, a, b, again[, feats]): for each row with a doc_id and text, a hash of its source (null if there's none),
    the keys of its lines, both 0 where a line can't count as repeated, whether a line of the row had the key before, and with
    ``common_words`` the counts of its lines as float32 in rows of ``FEATS``."""
    key = docs.schema["doc_id"].dataType
    out = StructType([StructField("doc_id", key), StructField("source_id", LongType()), StructField("a", ArrayType(LongType())), StructField("b", ArrayType(LongType())), StructField("again", ArrayType(BooleanType()))])
    if common_words is not None:
        out = out.add("feats", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = hash_words(common_words) if common_words is not None else None
        for batch in batches:
            sources = _source_hashes(batch.column("source"))
            for lo, to, f in flatten(batch.column("text"), nfc=True, lower=True):
                row, start, end, a, b = line_keys(batch, lo, to, f, sources)
                with np.errstate(over="ignore"):
                    again = pd.Series(a.view(np.uint64) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).duplicated().to_numpy()
                off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=to - lo))]).astype(np.int32))
                source = pa.array(sources[0][lo:to].view(np.int64), pa.int64(), mask=~sources[2][lo:to])
                cols = [batch.column("doc_id").slice(lo, to - lo), source, *(pa.ListArray.from_arrays(off, pa.array(x)) for x in (a, b, again))]
                if common is not None:
                    x = line_counts(f, start, end, common)
                    o = (np.asarray(off, np.int64) * 4 * len(FEATS)).astype(np.int32)
                    cols.append(pa.BinaryArray.from_buffers(pa.binary(), to - lo, [None, pa.py_buffer(o.tobytes()), pa.py_buffer(x.tobytes())]))
                yield pa.RecordBatch.from_arrays(cols, out.names)

    d = docs.select("doc_id", "text", "source").where("doc_id is not null and text is not null")
    return d.mapInArrow(run, out)


def texts_without(docs: DataFrame, a: np.ndarray, b: np.ndarray) -> DataFrame:
    """``docs`` with the lines left out of ``text`` whose key is among (a, b), which are sorted by a; every other column and row as it
    was. The lines are cut and put together in flat arrays; nothing is shuffled."""
    at = docs.columns.index("text")
    # Few a-keys are equal, so each is looked for in as many places.
    depth = int(np.diff(np.flatnonzero(np.append(np.append(True, a[1:] != a[:-1]), True))).max()) if len(a) else 0
    known = docs.sparkSession.sparkContext.broadcast((a, b))  # as many keys as the caller allows

    def among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = known.value
        i, hit = np.searchsorted(a, x), np.zeros(len(x), bool)
        for k in range(depth):
            j = np.minimum(i + k, len(a) - 1)
            hit |= (a[j] == x) & (b[j] == y)
        return hit & (y != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = _source_hashes(batch.column("source"))
            has = ~np.asarray(batch.column("doc_id").is_null()) & ~np.asarray(batch.column("text").is_null())
            parts = []
            for (lo, to, f), (_, _, raw) in zip(flatten(batch.column("text"), nfc=True, lower=True), flatten(batch.column("text"))):
                row, _, _, x, y = line_keys(batch, lo, to, f, sources)
                keep = ~(among(x, y) & has[lo:to][row])
                _, _, start, end = cut_lines(raw)
                kept = np.flatnonzero(keep)
                last = np.append(row[kept][1:] != row[kept][:-1], True)[: len(kept)]  # the last line kept of a row has no line end
                edge = np.zeros(len(raw.cp) + 2, np.int64)
                np.add.at(edge, start[kept], 1)
                np.add.at(edge, np.where(last, end[kept], end[kept] + 1), -1)
                mask = np.cumsum(edge)[: len(raw.cp)] > 0
                cp = raw.cp[mask]
                size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
                done = np.concatenate([[0], np.cumsum(size)])
                off = done[np.concatenate([[0], np.cumsum(mask)])[raw.off]]
                data = cp.tobytes().decode("utf-32-le").encode()
                parts.append(pa.LargeStringArray.from_buffers(to - lo, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data)))
            text = pa.chunked_array(parts, pa.large_string()).combine_chunks() if parts else pa.array([], pa.large_string())
            text = pc.if_else(batch.column("text").is_null(), pa.scalar(None, pa.large_string()), text).cast(batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), text)

    return docs.mapInArrow(run, docs.schema)
