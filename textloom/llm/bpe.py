"""Problem 8: the corpus as token ids of a byte-level BPE vocabulary.

Texts are cut into pieces in numpy by the vocabulary's pattern; equal pieces are merged once. Merges run in rounds over the
symbols of many pieces in one flat array: the rank of each adjacent pair is found by binary search over the sorted pair
keys, and each piece's first pair of lowest rank is joined, until none is left. Pieces of over ``LONG`` bytes, for which
rounds would be quadratic, are merged with a heap to the same result.

Defined results: null and empty texts give an empty list; special tokens' strings are ordinary text; every row comes out
once, whatever its doc_id; whole texts, never prefixes. Nothing is shuffled, so hot groups don't matter.
The vocabulary's file is a parameter; the driver sends it to the tasks, and each Python worker takes it in once.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions.flat import LETTER, NUMBER, OTHER, SPACE, Flat, flatten

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY = 64 << 20
LONG = 256
#: Distinct pieces that a worker remembers.
KNOWN = 1 << 20
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def cut_pieces(f: Flat) -> np.ndarray:
    """Where pieces begin, and the end: contractions; letters, numbers or others with at most one blank before; white space
    without its last character if something follows; white space."""
    n = len(f.cp)
    if not n:
        return np.zeros(1, np.int64)
    c, cp = f.cls, f.cp
    first = np.zeros(n + 1, bool)
    first[f.off] = True
    edge = first.copy()
    edge[1:n] |= c[1:] != c[:-1]
    blank = cp == 32
    # A run of white space followed by something gives up its last character: a blank joins what follows, others stand alone.
    space = c == SPACE
    last = space.copy()
    last[: n - 1] &= ~space[1:] & ~first[1:n]
    last[n - 1] = False
    follows = np.flatnonzero(last)
    edge[follows] = True
    joined = follows[blank[follows]]
    edge[joined + 1] = False
    quote = np.flatnonzero((cp == 39) & edge[:n])
    for q in quote.tolist():
        tail = f.text(q + 1, min(q + 3, n, int(f.off[np.searchsorted(f.off, q, "right")])))
        for x in _CONTRACTIONS:
            if tail.startswith(x):
                edge[q + 1] = False
                edge[q + 1 + len(x)] = True
                if len(x) == 2:
                    edge[q + 2] = False
                break
    edge[n] = True
    return np.flatnonzero(edge)


class Encoder:
    def __init__(self, vocabulary: bytes):
        self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        keys, to = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    to.append(rank)
        order = np.argsort(keys)
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int32)[order]
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair merges to, or a large number."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 1 << 30).astype(np.int32)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by rounds of merges over all words at once."""
        out: list = [None] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.merge_long(w)
        live = np.array([i for i, w in enumerate(words) if out[i] is None], np.int64)
        sym = self.bytes[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
        size = np.array([len(words[i]) for i in live], np.int64)
        none = 1 << 30
        owner = np.repeat(np.arange(len(live)), size)
        rank = np.full(len(sym), none, np.int32)
        if len(sym) > 1:
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self.pair_ranks(sym[:-1][same], sym[1:][same])
        while len(live):
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            low = np.minimum.reduceat(rank, start)
            done = low == none
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[live[i]] = sym[start[i] : start[i] + size[i]].copy()
                keep = np.repeat(~done, size)
                sym, rank, size, live, low = sym[keep], rank[keep], size[~done], live[~done], low[~done]
                if not len(live):
                    break
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
            hit = np.flatnonzero(rank == np.repeat(low, size))
            which = np.searchsorted(start, hit, "right") - 1
            hit = hit[np.concatenate([[True], which[1:] != which[:-1]])]
            sym[hit] = low
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit -= np.arange(len(hit))  # each word before lost one symbol
            sym, rank, size = sym[keep], rank[keep], size - 1
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            end = start + size - 1
            rank[hit] = none
            a = hit[hit < end]
            rank[a] = self.pair_ranks(sym[a], sym[a + 1])
            b = hit[hit > start] - 1
            rank[b] = self.pair_ranks(sym[b], sym[b + 1])
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        sym = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.pair_ranks(np.array(sym[:-1], np.int32), np.array(sym[1:], np.int32)).tolist()
        rank = {(a, b): r for a, b, r in zip(sym, sym[1:], first)}

        def of(a, b):
            if (a, b) not in rank:
                rank[a, b] = int(self.pair_ranks(np.array([a], np.int32), np.array([b], np.int32))[0])
            return rank[a, b]

        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(first) if r < 1 << 30]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := of(r, sym[after[i]])) < 1 << 30:
                    heapq.heappush(heap, (x, i, r, sym[after[i]]))
            if before[i] >= 0 and (x := of(sym[before[i]], r)) < 1 << 30:
                heapq.heappush(heap, (x, before[i], sym[before[i]], r))
        return np.array([s for s, ok in zip(sym, alive) if ok], np.int32)

    def learn(self, f: Flat, hashes: list[int], start: np.ndarray, end: np.ndarray) -> None:
        """Merge the pieces that aren't known yet, and remember them."""
        new = self.merge([f.text(a, b).encode() for a, b in zip(start.tolist(), end.tolist())])
        size = np.array([len(x) for x in new], np.int64)
        k, total = len(self.known), int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = np.concatenate(new)
        self.start[k : k + len(new)] = self.used + np.cumsum(size) - size
        self.size[k : k + len(new)] = size
        self.known.update(zip(hashes, range(k, k + len(new))))
        self.used += total

    def encode(self, f: Flat, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of tokens by row, and all tokens in order."""
        if len(self.known) > KNOWN:
            self.forget()
        cut = cut_pieces(f)
        start, end = cut[:-1], cut[1:]
        code, distinct = pd.factorize(f.hashes(start, end))
        seen = distinct.tolist()
        missing = np.array([h not in self.known for h in seen], bool)
        if missing.any():
            first = np.full(len(seen), -1, np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            new = np.flatnonzero(missing)
            self.learn(f, [seen[i] for i in new.tolist()], start[first[new]], end[first[new]])
        entry = np.fromiter(map(self.known.__getitem__, seen), np.int64, len(seen))
        size = self.size[entry][code]
        done = np.concatenate([[0], np.cumsum(size)])
        by_row = np.diff(done[np.searchsorted(cut, f.off)])
        if not ids:
            return by_row, None
        at = np.repeat(self.start[entry][code] - done[:-1], size) + np.arange(done[-1])
        return by_row, self.flat[at]


@functools.lru_cache(4)
def encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def vocabulary_of(path: str | None = None) -> bytes:
    """The vocabulary's file: the given one, that of TOKENIZER_FILE, or the public tokenizers' own. It's read on the driver and sent to the
    tasks, so it must be on the driver only; more than ``MOST_VOCABULARY`` bytes aren't accepted."""
    path = path or os.environ.get("TOKENIZER_FILE")
    if path is None:
        try:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        except ImportError:
            path = VOCABULARY
    if os.path.getsize(path) > MOST_VOCABULARY:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY} bytes")
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for b in batches:
            for row, to, f in flatten(b.column("text")):
                size, flat = enc.encode(f)
                off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, to - row), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    key = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, StructType([StructField("doc_id", key), StructField("ids", ArrayType(IntegerType()))]))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens): how many ids ``encode_texts`` gives, without making them."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for b in batches:
            for row, to, f in flatten(b.column("text")):
                size, _ = enc.encode(f, ids=False)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, to - row), pa.array(size, pa.int64())], ["doc_id", "tokens"])

    key = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, StructType([StructField("doc_id", key), StructField("tokens", LongType())]))
