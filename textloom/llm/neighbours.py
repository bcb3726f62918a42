"""Problem 4: the k most alike vectors of every vector.

Inverted file with product-quantised residuals. Coarse centroids, about the square root of the rows, and the codebooks are
fitted on a bounded sample (at most ``SAMPLE`` vectors); every vector is assigned to its centroid and its residual is coded.
Each vector, as a query, probes the cells of its ``probes`` nearest centroids. There asymmetric tables estimate its cosine to
each row x from the code x' as q.x' / x.x', with the standard error |x' - (x.x') x| / (x.x' sqrt(dim - 1)) that is stored
with the row; every row that can reach the query's k-th best within ``z`` standard errors is reranked by its exact cosine.
There is no fixed shortlist: where codes can't tell rows apart, as among near-copies, all of them are reranked.

Centroids of a cosine of ``DENSE`` or more are one cell, so a crowd of near-copies, which k-means would spread over more cells
than are probed, is searched wholly, in blocks. ``exact=True`` probes every cell and prunes by the triangle inequality of
angles only, so it loses nothing; its work grows with the square of the rows.

Cells are dealt to packs of neighbouring cells, and a query goes to each pack once with the list of cells it probes there. A
large cell is several packs, and a pack of many queries several tasks, so memory is bounded.

Vectors equal in direction (rounded to 7 places) are one class, searched once: a third of all rows being copies costs one
search. A class keeps its best k + 1 doc_ids, each by its best embedding; a doc_id is then left out of its own and k others
remain.

Defined results: embeddings that are null, of another length, all zeros, or not finite take no part; repeated rows are one;
a doc_id with several embeddings is never its own neighbour; among equal cosines the smaller doc_id comes first; fewer
than k others give fewer rows; empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import lookup, written

#: Vectors that centroids and codebooks are fitted on: 32 a centroid, from the first to the second number.
LEAST_SAMPLE, SAMPLE = 20_000, 200_000
PARTS, WORDS = 8, 256
DENSE = 0.95
#: Rows of a pack, and of its queries in one task.
LEAST_PACK, PACK, QUERY_BLOCK = 1_000, 32_000, 64_000
#: Queries, and rows of a cell, that are compared at once.
CHUNK, COLUMNS = 256, 1024
#: More than what rounding can change in an angle or a cosine.
SLACK = 1e-5


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids; empty ones are set anew on the points farthest from theirs."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, dist = nearest(x, c)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(near, x[:, j], k) / np.maximum(n, 1)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-dist)[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance, in blocks of rows."""
    at, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    norm = (c * c).sum(1)
    for i in range(0, len(x), 4096):
        y = x[i : i + 4096]
        s = norm - 2 * (y @ c.T)
        at[i : i + 4096] = s.argmin(1)
        d[i : i + 4096] = s.min(1) + (y * y).sum(1)
    return at, d


class Index:
    """Coarse centroids, the cell of each, and the codewords of residuals by part of the dimensions."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.coarse = k_means(sample, int(np.clip(np.sqrt(rows), 1, max(1, len(sample) // 16))))
        unit = self.coarse / np.maximum(np.sqrt((self.coarse**2).sum(1)), 1e-12)[:, None]
        near, _ = nearest(sample, self.coarse)
        self.cell = np.full(len(unit), -1)
        for c in np.argsort(-np.bincount(near, minlength=len(unit)), kind="stable"):
            if self.cell[c] < 0:
                self.cell[(self.cell < 0) & (unit @ unit[c] >= DENSE)] = c
                self.cell[c] = c
        some = slice(0, LEAST_SAMPLE)
        res = sample[some] - self.coarse[near[some]]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.words = [k_means(res[:, c], WORDS, 8) for c in self.cuts]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, code, x.x' and |x'| of each row."""
        at, _ = nearest(x, self.coarse)
        res = x - self.coarse[at]
        codes = np.stack([nearest(res[:, c], w)[0] for c, w in zip(self.cuts, self.words)], 1).astype(np.uint8)
        again = self.coarse[at] + np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], 1)
        return at, codes, np.einsum("nd,nd->n", x, again), np.sqrt((again * again).sum(1))

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """Centroids of each row, nearest ones, in no order."""
        n = min(n, len(self.coarse))
        s = (self.coarse * self.coarse).sum(1) - 2 * (x @ self.coarse.T)
        return np.argpartition(s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(x), 1))

    def products(self, y: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """q.x' of all pairs, from a table a part."""
        some, back = np.unique(at, return_inverse=True)
        out = (y @ self.coarse[some].T).astype(np.float32)[:, back]
        for j, (c, w) in enumerate(zip(self.cuts, self.words)):
            out += (y[:, c] @ w.T).astype(np.float32)[:, codes[:, j]]
        return out

    def packs(self, size: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """First pack and number of packs of each cell: neighbouring cells together, one of more than ``rows`` in several."""
        groups = k_means(self.coarse, max(1, int(size.sum() // rows)))
        _, _, axis = np.linalg.svd(groups, full_matrices=False)
        order = np.lexsort((self.coarse @ axis[0], (groups @ axis[0])[nearest(self.coarse, groups)[0]]))
        base, cuts, at, used = np.zeros(len(size), np.int64), np.maximum(1, -(-size // rows)), 0, 0
        for c in order:
            if used and used + size[c] > rows:
                at, used = at + 1, 0
            base[c], used = at, used + size[c]
            if cuts[c] > 1:
                at, used = at + cuts[c], 0
        return base, cuts


class Best:
    """The best ``n`` different doc_ids of each of a few queries so far: (query, doc, cosine), and the cosine that another must reach."""

    def __init__(self, reach: np.ndarray, n: int):
        self.n, self.reach = n, reach.copy()
        self.q, self.doc, self.cos = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)

    def add(self, q: np.ndarray, doc: np.ndarray, cos: np.ndarray) -> None:
        """Takes in candidates; a doc_id may come again."""
        if len(self.q):
            q, doc, cos = np.append(self.q, q), np.append(self.doc, doc), np.append(self.cos, cos)
        if not len(q):
            return
        code, names = pd.factorize(doc, sort=True)
        o = np.lexsort((-cos, code, q))
        o = o[np.append(True, (np.diff(q[o]) != 0) | (np.diff(code[o]) != 0))]
        o = o[np.lexsort((code[o], -cos[o], q[o]))]
        at = np.arange(len(o)) - np.searchsorted(q[o], q[o])
        o, at = o[at < self.n], at[at < self.n]
        self.q, self.doc, self.cos = q[o], names[code[o]], cos[o]
        full = at == self.n - 1
        self.reach[self.q[full]] = np.maximum(self.reach[self.q[full]], self.cos[full])


class Held:
    """A pack's rows, sorted by cell, and the doc_ids that each offers."""

    def __init__(self, h: pd.DataFrame, index: Index, dim: int, z: float | None):
        h = h.sort_values("cell", kind="stable")
        self.index, self.z, self.keys = index, z, pd.Index(h["key"])
        self.x = _rows(h["vec"], dim)
        self.codes = np.frombuffer(b"".join(h["codes"]), np.uint8).reshape(len(h), -1)
        self.at, self.dot, self.norm = (h[c].to_numpy() for c in ("at", "dot", "norm"))
        self.cells, self.start = np.unique(h["cell"].to_numpy(), return_index=True)
        self.end = np.append(self.start[1:], len(h))
        self.docs = np.concatenate([np.asarray(d) for d in h["docs"]])
        self.first = np.append(0, np.cumsum([len(d) for d in h["docs"]]))
        perp = np.sqrt(np.maximum(self.norm**2 - self.dot**2, 0))
        sure = self.dot > 0.05
        self.scale = np.where(sure, 1 / np.maximum(self.dot, 0.05), 0).astype(np.float32)
        self.error = np.where(sure, perp / np.maximum(self.dot, 0.05) / np.sqrt(max(1, dim - 1)), 2).astype(np.float32)
        self.angle = np.arccos(np.clip(self.dot / np.maximum(self.norm, 1e-12), -1, 1))

    def reachable(self, y: np.ndarray, s: slice) -> np.ndarray:
        """The cosine that each pair can have at most."""
        p = self.index.products(y, self.at[s], self.codes[s])
        if self.z is not None:
            return p * self.scale[s] + self.z * self.error[s]
        angle = np.arccos(np.clip(p / np.maximum(self.norm[s], 1e-12), -1, 1)) - self.angle[s]
        return np.cos(np.clip(angle - SLACK, 0, np.pi)) + SLACK

    def cosines(self, y: np.ndarray, own: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        cos = np.concatenate([np.einsum("nd,nd->n", y[q[i : i + 65536]], self.x[r[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])
        return np.where(own[q] == r, 1.0, np.minimum(cos, 1.0))

    def offer(self, top: Best, q: np.ndarray, r: np.ndarray, cos: np.ndarray) -> None:
        n = self.first[r + 1] - self.first[r]
        each = np.repeat(self.first[r] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        top.add(np.repeat(q, n), self.docs[each], np.repeat(cos, n))

    def search(self, c: int, y: np.ndarray, own: np.ndarray, reach: np.ndarray, n: int) -> Best:
        """The best of a cell's rows for some queries. own: the row that is the query itself, or -1."""
        top = Best(reach, n)
        for lo in range(self.start[c], self.end[c], COLUMNS):
            s = slice(lo, min(lo + COLUMNS, self.end[c]))
            up = self.reachable(y, s)
            size = s.stop - s.start
            if (up >= top.reach[:, None]).mean() > 0.1 and size > 2 * n:  # some exact ones first, which raise what others must reach
                best = np.argpartition(-up, 2 * n, axis=1)[:, : 2 * n]
                q, r = np.repeat(np.arange(len(y)), 2 * n), best.ravel() + lo
                self.offer(top, q, r, self.cosines(y, own, q, r))
                np.put_along_axis(up, best, -9, 1)
            mask = up >= top.reach[:, None]
            q, r = np.nonzero(mask)
            if not len(q):
                continue
            if len(q) > 0.2 * mask.size:
                cos = np.minimum((y @ self.x[s].T)[q, r], 1.0)
                cos = np.where(own[q] == r + lo, 1.0, cos)
            else:
                cos = self.cosines(y, own, q, r + lo)
            keep = cos >= top.reach[q]
            self.offer(top, q[keep], r[keep] + lo, cos[keep])
        return top


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    n, size = len(rows), rows.dtype.itemsize * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _units(dim: int):
    """(doc_id, key, vec): unit vectors, and 128 bits that are equal for vectors equal to 7 places: sums of the rounded numbers, each
    times a random odd number of its place."""
    odd = np.random.default_rng(64).integers(0, 1 << 63, (2, dim), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), dim), False))
            x = pc.fill_null(b.column("embedding").flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                x = x / np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
                norm = np.sqrt((x * x).sum(1))
            good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            x = x[good] / norm[good, None]
            whole = np.rint(x * 1e7).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                key = np.stack([(whole * o).sum(1, dtype=np.uint64) for o in odd], 1)
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(good)), _binary(key), _binary(x)], ["doc_id", "key", "vec"])

    return run


def _rows(blobs: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), float).reshape(-1, dim)


def most_alike(vectors: DataFrame, k: int = 5, least: float = -1.0, dim: int = 64, probes: int = 16, z: float = 3.0, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """(doc_id, other, cosine): the ``k`` most alike other doc_ids of each, of a cosine of at least ``least``. ``probes``: how many
    centroids' cells a query searches; ``z``: standard errors of the estimate that are allowed for; ``exact``: search all cells and
    prune by bounds that hold always."""
    key_type = vectors.schema["doc_id"].dataType.simpleString()
    units = vectors.select("doc_id", "embedding").where("doc_id is not null and embedding is not null").mapInArrow(_units(dim), f"doc_id {key_type}, key binary, vec binary")
    units = written(units, "units")
    members = units.select("key", "doc_id").distinct()
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).where(F.col("_r") <= k + 1)
    first = first.groupBy("key").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    classes = written(units.groupBy("key").agg(F.min("vec").alias("vec")).join(first, "key"), "classes")
    n = classes.count()
    if not n:
        return units.select("doc_id", F.col("doc_id").alias("other"), F.lit(0.0).alias("cosine")).limit(0)
    most = min(sample, max(LEAST_SAMPLE, 32 * int(np.sqrt(n))))
    train = classes.select("vec") if n <= most else classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * (most / n))).select("vec")
    sc = vectors.sparkSession.sparkContext
    index = sc.broadcast(Index(_rows(train.toPandas()["vec"], dim), n))  # of bounded size: at most sample / 16 centroids

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _rows(b["vec"], dim)
            b["at"], codes, b["dot"], b["norm"] = index.value.code(x)
            b["cell"], b["codes"] = index.value.cell[b["at"]], [c.tobytes() for c in codes]
            if not exact:
                b["asks"] = [np.unique(c) for c in index.value.cell[index.value.probes(x, probes)]]
            yield b

    kind = f"key binary, vec binary, docs array<{key_type}>, at long, dot double, norm double, cell long, codes binary"
    placed = written(classes.mapInPandas(place, kind if exact else kind + ", asks array<long>"), "placed")
    cells = len(index.value.coarse)
    size, asked = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row a cell
        size[r["cell"]] = r["count"]
    if exact:
        asked[:] = n
    else:
        for r in placed.select(F.explode("asks").alias("cell")).groupBy("cell").count().collect():
            asked[r["cell"]] = r["count"]
    base, cuts = index.value.packs(size, int(np.clip(n / (3 * sc.defaultParallelism), LEAST_PACK, PACK)))
    all_cells = np.flatnonzero(size)
    parts = np.ones(int((base + cuts).max()), np.int64)
    for p, c in zip(base[all_cells], all_cells):  # a query comes once a pack, so these are upper bounds
        parts[p : p + cuts[c]] += asked[c]
    parts = np.maximum(1, -(-np.minimum(parts, n) // QUERY_BLOCK))
    deal = sc.broadcast((base, cuts, size > 0, parts))  # by cell and pack

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, cuts, some, parts = deal.value
        for b in batches:
            lists = [all_cells] * len(b) if exact else list(b["asks"])
            row = np.repeat(np.arange(len(b)), [len(x) for x in lists])
            cell = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
            row, cell = row[some[cell]], cell[some[cell]]
            times = cuts[cell]
            pack = np.repeat(base[cell] - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            o = np.lexsort((pack, row))
            row, cell, pack = row[o], cell[o], pack[o]
            at = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(pack) != 0))) if len(row) else np.zeros(0, np.int64)
            lists = [c.astype(np.int32).tobytes() for c in np.split(cell, at[1:])] if len(at) else []
            which = b["key"].map(lambda x: int.from_bytes(x[:4], "little")).to_numpy(np.int64)[row[at]]
            yield pd.DataFrame({"pack": pack[at], "part": which % parts[pack[at]], "key": b["key"].to_numpy()[row[at]], "vec": b["vec"].to_numpy()[row[at]], "cells": lists})

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, cuts, _, parts = deal.value
        for b in batches:
            cell = b["cell"].to_numpy()
            pack = base[cell] + b["key"].map(lambda x: int.from_bytes(x[4:8], "little")).to_numpy(np.int64) % cuts[cell]
            times = parts[pack]
            part = np.arange(times.sum()) - np.repeat(np.append(0, np.cumsum(times)[:-1]), times)
            yield b.iloc[np.repeat(np.arange(len(b)), times)].assign(pack=np.repeat(pack, times), part=part)

    asking = placed.select("key", "vec", *([] if exact else ["asks"])).mapInPandas(ask, "pack long, part long, key binary, vec binary, cells binary")
    held = placed.drop("asks").mapInPandas(hold, kind + ", pack long, part long")

    def search(at, q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(h):
            return pd.DataFrame({"key": [], "other": [], "cosine": []})
        pack = Held(h, index.value, dim, None if exact else z)
        y, own = _rows(q["vec"], dim), pack.keys.get_indexer(q["key"])
        cell = np.frombuffer(b"".join(q["cells"]), np.int32)
        row = np.repeat(np.arange(len(q)), q["cells"].map(len).to_numpy() // 4)
        o = np.argsort(cell, kind="stable")
        cell, row = cell[o], row[o]
        reach, got = np.full(len(q), least), []
        for c, name in enumerate(pack.cells):
            mine = row[np.searchsorted(cell, name) : np.searchsorted(cell, name, "right")]
            for i in range(0, len(mine), CHUNK):
                m = mine[i : i + CHUNK]
                top = pack.search(c, y[m], own[m], reach[m], k + 1)
                reach[m] = top.reach
                got.append((m[top.q], top.doc, top.cos))
        top = Best(np.full(len(q), least), k + 1)
        if got:
            top.add(*(np.concatenate(x) for x in zip(*got)))
        return pd.DataFrame({"key": q["key"].to_numpy()[top.q], "other": top.doc, "cosine": top.cos})

    found = asking.groupBy("pack", "part").cogroup(held.groupBy("pack", "part")).applyInPandas(search, f"key binary, other {key_type}, cosine double")
    # Of all packs: again the best of each class, a doc_id once.
    found = written(found, "found").groupBy("key", "other").agg(F.max("cosine").alias("cosine"))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "other"))).where(F.col("_r") <= k + 1)
    offer = found.groupBy("key").agg(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other")).alias("offer"))
    offer = offer.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key")
    out = lookup(members, written(offer, "offers"), ["key"], "rows", "inner")
    out = out.select("doc_id", F.explode(F.slice(F.sort_array(F.filter("offer", lambda o: o["other"] != F.col("doc_id"))), 1, k)).alias("o"))
    out = out.select("doc_id", "o.other", (-F.col("o.c")).alias("cosine")).where(F.col("cosine") >= least)
    w = Window.partitionBy("doc_id").orderBy(F.desc("cosine"), "other")  # a doc_id may have several embeddings
    out = out.groupBy("doc_id", "other").agg(F.max("cosine").alias("cosine"))
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def alike_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9, **more) -> DataFrame:
    """(doc_a, doc_b): pairs of which at least one is among the other's ``k`` most alike."""
    m = most_alike(vectors, k, least, **more)
    return m.select(F.least("doc_id", "other").alias("doc_a"), F.greatest("doc_id", "other").alias("doc_b")).distinct()
