"""Latent semantic projection by a truncated SVD of the TF-IDF matrix.

Block Lanczos with full reorthogonalisation (Golub and Underwood 1977) on the smaller side of the matrix, documents or terms:
products with the matrix and its transpose are taken in tasks, rows of the other side at a time, and summed by blocks of that side as
a tree; Ritz values of the space so far come from numbers the driver has, and blocks are added until the wanted singular values have
settled. One solver, whatever the size.

The driver's memory holds a few columns at a time, at most ``LIMIT`` bytes each time; the vectors of the space are files in a
temporary folder of the driver (float32, about three times k columns of the smaller side, at most ``MOST`` bytes). The components
are a table, and tasks get at most ``SLICE`` bytes of them at once."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import SMALL_ROWS, at_most, clear_written, mark, scratch, shuffles_freed, written

#: Bytes of vectors that are sent to tasks at once while fitting, and on the driver's disk.
LIMIT, MOST = 32 << 20, 12 << 30
#: Bytes of components that are sent to tasks at once.
SLICE = 48 << 20
BLOCK = 4096
#: Entries of the matrix that are multiplied at once; entries and rows of the matrix that are kept together.
PIECE = 1 << 16
CUT, CUT_ROWS = 1 << 18, 1 << 14
#: How many tasks' sums are joined at once.
LOTS = 32
#: Largest relative change of a wanted singular value by another block at which it counts as settled.
CLOSE = 2e-3


@dataclass
class LsiModel:
    """table: (term_idx, v ARRAY<FLOAT>) of the terms that have weights; singular values; how many terms there are."""

    table: DataFrame
    singular: np.ndarray
    n_terms: int
    _shared: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def k(self) -> int:
        return len(self.singular)

    @cached_property
    def components(self) -> np.ndarray:
        """n_terms x k in the driver's memory, for vocabularies that are small enough; nothing else needs it."""
        return _columns(self.table, self.n_terms, 0, self.k).astype(float)

    def shared(self, spark):
        """The components as a broadcast, made once a session."""
        key = spark.sparkContext.applicationId
        if key not in self._shared:
            self._shared[key] = spark.sparkContext.broadcast(self.components)
        return self._shared[key]


def effective_k(k: int, n_docs: int, n_terms: int) -> int:
    if n_docs < 2:
        raise ValueError("a projection needs at least two documents")
    return max(1, min(k, n_terms - 1, n_docs - 1))


def _columns(table: DataFrame, n: int, a: int, b: int, ids: np.ndarray | None = None) -> np.ndarray:
    """Columns a to b of the components of all n terms, or of ``ids`` (sorted)."""
    out = np.zeros((n if ids is None else len(ids), b - a), np.float32)
    got = table.select("term_idx", F.slice("v", a + 1, b - a).cast("array<float>").alias("v")).toArrow()
    for c in got.to_batches():
        at = np.asarray(c.column("term_idx"))
        out[at if ids is None else np.searchsorted(ids, at)] = np.asarray(c.column("v").flatten()).reshape(-1, b - a)
    return out


def pieces_of(weights: DataFrame, row: str, column: str) -> DataFrame:
    """(rows, end, at, value, order): the matrix in pieces of whole rows of about ``CUT`` entries. Of each piece the rows' keys, where
    their entries end, the entries' columns and values, and their order by column; all but the keys as bytes."""
    w = weights.select(F.col(row).alias("row"), F.col(column).cast("int").alias("at"), F.col("weight").cast("double").alias("value"))

    def piece(t: pa.Table):
        runs = pc.run_end_encode(t.column("row").combine_chunks())
        end, at, value = np.asarray(runs.run_ends), np.asarray(t.column("at")), np.asarray(t.column("value")).astype(np.float32)
        for i in range(0, len(end), CUT_ROWS):
            e = end[i : i + CUT_ROWS]
            first, last = end[i - 1] if i else 0, e[-1]
            own, keys = at[first:last], runs.values.slice(i, len(e))
            cells = [(e - first).astype(np.int32), own, value[first:last], np.argsort(own, kind="stable").astype(np.int32)]
            rows = pa.ListArray.from_arrays(pa.array([0, len(e)], pa.int32()), pa.concat_arrays([keys]))
            yield pa.RecordBatch.from_arrays([rows, *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["rows", "end", "at", "value", "order"])

    def cut(batches):
        held, size, enough = [], 0, CUT
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < enough:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            ends = np.asarray(pc.run_end_encode(t.column("row").combine_chunks()).run_ends)
            done = int(ends[-2]) if len(ends) > 1 else 0  # the last row may go on
            if done:
                yield from piece(t.slice(0, done))
            held, size = pa.Table.from_batches(t.slice(done).to_batches(), t.schema).combine_chunks().to_batches(), t.num_rows - done
            enough = max(CUT, 2 * size)
        if size:
            yield from piece(pa.Table.from_batches(held))

    kind = w.schema["row"].dataType.simpleString()
    return w.repartition("row").sortWithinPartitions("row", "at").mapInArrow(cut, f"rows array<{kind}>, end binary, at binary, value binary, order binary")


def _cells(b: pa.RecordBatch, *names: str):
    """Of each piece in a batch the arrays of these names."""
    kinds = {"value": np.float32}
    for i in range(b.num_rows):
        yield [np.frombuffer(b.column(n)[i].as_buffer(), kinds.get(n, np.int32)) for n in names]


def _sums(out: np.ndarray, group: np.ndarray, index: np.ndarray, values: np.ndarray, right: np.ndarray) -> None:
    """out[group] += values * right[index], for entries sorted by group, a bounded stretch at a time."""
    for i in range(0, len(group), PIECE):
        g = group[i : i + PIECE]
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        out[g[at]] += np.add.reduceat(values[i : i + PIECE, None].astype(float) * right[index[i : i + PIECE]], at, axis=0)


def _times(end: np.ndarray, at: np.ndarray, values: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows of the matrix times ``right``."""
    out = np.zeros((len(end), right.shape[1]))
    _sums(out, np.repeat(np.arange(len(end)), np.diff(end, prepend=0)), at, values, right)
    return out


def _normal(pieces: DataFrame, right: np.ndarray) -> np.ndarray:
    """M' M times ``right`` (n x width), where the pieces have the rows of M."""
    spark = pieces.sparkSession
    n, width = right.shape
    shared = spark.sparkContext.broadcast(right)  # at most LIMIT bytes

    def partial(batches):
        v, out = shared.value, None
        for b in batches:
            for end, index, values, order in _cells(b, "end", "at", "value", "order"):
                out = np.zeros((n, width), np.float32) if out is None else out
                left = _times(end, index, values, v)
                row = np.repeat(np.arange(len(end)), np.diff(end, prepend=0))
                _sums(out, index[order], row[order], values[order], left)
        for k in range(0, n if out is not None else 0, BLOCK):
            part = out[k : k + BLOCK]
            at = np.flatnonzero(part.any(1))
            if len(at):
                from pyspark import TaskContext

                yield pa.RecordBatch.from_pydict({"block": [k // BLOCK], "lot": [TaskContext.get().partitionId() % LOTS], "at": [at.tobytes()], "vec": [part[at].tobytes()]}, schema)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((BLOCK, width))
        for at, vec in zip(pdf["at"], pdf["vec"]):
            out[np.frombuffer(at, np.int64)] += np.frombuffer(vec, np.float32).reshape(-1, width)
        at = np.flatnonzero(out.any(1))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "lot": pdf["lot"].iloc[:1], "at": [at.tobytes()], "vec": [out[at].astype(np.float32).tobytes()]})

    schema = pa.schema([("block", pa.int64()), ("lot", pa.int64()), ("at", pa.binary()), ("vec", pa.binary())])
    kind = "block long, lot long, at binary, vec binary"
    tasks = spark.sparkContext.defaultParallelism
    got = pieces.select("end", "at", "value", "order").coalesce(tasks).mapInArrow(partial, kind)
    if tasks > LOTS:  # the sums of many tasks are joined as a tree
        got = got.groupBy("block", "lot").applyInPandas(join, kind)
    out = np.zeros((n, width), np.float32)
    with scratch():
        with shuffles_freed(spark):
            got = written(got.groupBy("block").applyInPandas(join, kind), "sums")
        for b in got.select("block", "at", "vec").toArrow().to_batches():  # at most LIMIT bytes
            for i in range(b.num_rows):
                at = np.frombuffer(b.column("at")[i].as_buffer(), np.int64)
                out[b.column("block")[i].as_py() * BLOCK + at] = np.frombuffer(b.column("vec")[i].as_buffer(), np.float32).reshape(-1, width)
    shared.destroy()
    return out


def _orthonormal(z: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of the columns' space, without directions shorter than ``least``; by the columns' products. In doubles,
    a stretch of rows at a time."""
    stretch = max(1, (4 << 20) // (8 * max(1, z.shape[1])))
    parts = range(0, len(z), stretch)
    value, vector = np.linalg.eigh(sum(((c := z[i : i + stretch].astype(float)).T @ c for i in parts), np.zeros((z.shape[1],) * 2)))
    live = value > max(least, 1e-150) ** 2
    turn = vector[:, live] / np.sqrt(value[live])
    out = np.empty((len(z), turn.shape[1]), np.float32)
    for i in parts:
        out[i : i + stretch] = z[i : i + stretch].astype(float) @ turn
    return out


def _space(pieces: DataFrame, n: int, k: int, seed: int, folder: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Blocks of vectors as files in ``folder``; the k largest eigenvalues of M' M in their space and its vectors."""
    width = max(1, min(k // 4, n, LIMIT // (4 * n)))  # narrow blocks settle with fewer columns
    block = _orthonormal(np.random.default_rng(seed).standard_normal((n, width), np.float32), 0)
    basis: list[np.ndarray] = []
    gram = np.zeros((0, 0))
    before = None
    while True:
        np.save(f"{folder}/{len(basis)}.npy", block)
        basis.append(np.load(f"{folder}/{len(basis)}.npy", mmap_mode="r"))
        z = _normal(pieces, block)
        column = np.concatenate([q.T @ z for q in basis]).astype(float)
        m, w = len(gram), block.shape[1]
        new = np.zeros((m + w, m + w))
        new[:m, :m] = gram
        new[:, m:] = column
        new[m:, :m] = column[:m].T
        new[m:, m:] = (column[m:] + column[m:].T) / 2
        gram = new
        value, vector = np.linalg.eigh(gram)
        singular = np.sqrt(np.maximum(value[::-1][:k], 0))
        if before is not None and len(before) == k and len(gram) >= 3 * k and (np.abs(singular - before) <= CLOSE * np.maximum(singular, 1e-12 + singular[0] * 1e-6)).all():
            break
        before = singular
        room = n - len(gram)
        scale = np.linalg.norm(z, axis=0).max() if z.size else 0.0
        for _ in range(2):
            for q in basis:
                z -= q @ (q.T @ z)
        block = _orthonormal(z, 1e-5 * scale)[:, : max(0, room)]
        for q in basis:
            block = block - q @ (q.T @ block)
        block = _orthonormal(block, 1e-2)
        if not block.shape[1]:
            break
    order = np.argsort(-value)[:k]
    return basis, np.maximum(value[order], 0), vector[:, order]


def _ritz(basis: list[np.ndarray], turn: np.ndarray, rows: slice) -> np.ndarray:
    """Some rows of the space's vectors times ``turn``."""
    out, at = 0.0, 0
    for q in basis:
        out = out + q[rows].astype(float) @ turn[at : at + q.shape[1]]
        at += q.shape[1]
    return out


def _sign(most: np.ndarray) -> np.ndarray:
    """Of both signs the one with which a component's largest entry is positive. ``most``: stretches' largest entries by column."""
    sign = np.sign(most[np.abs(most).argmax(0), np.arange(most.shape[1])])
    return np.where(sign == 0, 1, sign)


def fit(weights: DataFrame, n_docs: int, n_terms: int, k: int = 100, seed: int = 42) -> LsiModel:
    """Truncated SVD of rank k (bounded by the matrix) of weights (doc_idx, term_idx, weight)."""
    k, n = effective_k(k, n_docs, n_terms), min(n_docs, n_terms)
    if n * 4 * 4 * k > MOST or 4 * n > LIMIT:
        raise ValueError(f"{n_docs} documents and {n_terms} terms at rank {k} don't fit the driver; raise min_term_frequency or take a lower rank")
    spark, by_terms = weights.sparkSession, n_docs < n_terms
    with shuffles_freed(spark):
        made = mark()
        pieces = written(pieces_of(weights, "term_idx", "doc_idx") if by_terms else pieces_of(weights, "doc_idx", "term_idx"), "pieces")
    with tempfile.TemporaryDirectory(prefix="textloom-") as folder:
        basis, value, vector = _space(pieces, n, k, seed, folder)
        singular = np.sqrt(value)
        if by_terms:  # from the documents' vectors those of the terms
            turn = vector / np.where(singular > 0, singular, 1)

            def columns(a: int, b: int) -> np.ndarray:
                out = np.empty((n, b - a), np.float32)
                for i in range(0, n, BLOCK):
                    out[i : i + BLOCK] = _ritz(basis, turn[:, a:b], slice(i, i + BLOCK))
                return out

            table = _onto(pieces, "term_idx", n, len(value), columns, LIMIT, signed=True)
            clear_written(made, last=True)
        else:
            clear_written(made)
            parts = [slice(i, i + BLOCK) for i in range(0, n, BLOCK)]
            sign = _sign(np.array([(v := _ritz(basis, vector, p))[np.abs(v).argmax(0), np.arange(len(value))] for p in parts]))
            table = _stored(spark, n, lambda p: _ritz(basis, vector * sign, p), len(value))
    return LsiModel(table, singular, n_terms)


def _stored(spark, n: int, rows: Callable[[slice], np.ndarray], k: int) -> DataFrame:
    """(term_idx, v) of vectors the driver makes, a stretch of terms at a time."""
    tables, stretch = [], max(1, LIMIT // (8 * k))
    for i in range(0, n, stretch):
        v = rows(slice(i, i + stretch)).astype(np.float32)
        off = pa.array((np.arange(len(v) + 1) * k).astype(np.int32))
        t = pa.table({"term_idx": np.arange(i, i + len(v)), "v": pa.ListArray.from_arrays(off, pa.array(v.reshape(-1)))})
        tables.append(written(spark.createDataFrame(t), "components"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _lists(x: np.ndarray, kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.reshape(-1).astype(kind)))


def _onto(pieces: DataFrame, key: str, n: int, k: int, columns: Callable[[int, int], np.ndarray], limit: int, signed: bool = False) -> DataFrame:
    """(key, v ARRAY<FLOAT>, or vec ARRAY<DOUBLE> if not ``signed``): rows in written pieces times an n x k matrix, of which
    ``columns`` gives as many as ``limit`` bytes hold; the rows' parts are joined by piece. ``signed`` turns each column so that its
    largest entry is positive."""
    spark, rows = pieces.sparkSession, pieces.schema["rows"].dataType
    wide, kind = max(1, min(k, limit // (4 * max(1, n)))), np.float32 if signed else float
    pieces = pieces.withColumn("piece", F.xxhash64("rows", "end", "at"))
    out, signs = None, []
    for part, a in enumerate(range(0, k, wide)):
        shared = spark.sparkContext.broadcast(columns(a, min(k, a + wide)))

        def run(batches, shared=shared, part=part):
            for b in batches:
                for i, cells in enumerate(_cells(b, "end", "at", "value")):
                    x = _times(*cells, shared.value)
                    most = x[np.abs(x).argmax(0), np.arange(x.shape[1])]
                    cell = [pa.array([part], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([most.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([b.column("rows").slice(i, 1), b.column("piece").slice(i, 1), *cell], ["rows", "piece", "part", "vec", "most"])

        got = written(pieces.select("rows", "piece", "end", "at", "value").mapInArrow(run, f"rows {rows.simpleString()}, piece long, part int, vec binary, most binary"), "part")
        shared.destroy()
        if signed:
            most = [np.frombuffer(x.as_buffer()) for x in got.select("most").toArrow().column("most")]
            signs.append(_sign(np.array(most)) if most else np.ones(min(k, a + wide) - a))
        got = got.drop("most") if part == 0 else got.drop("most").withColumn("rows", F.lit(None).cast(rows))
        out = got if out is None else out.unionByName(got)
    sign = np.concatenate(signs) if signed else None

    def join(t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t.column("part")))
        rows = t.column("rows").combine_chunks()
        keys = rows.slice(order[0], 1).flatten()
        x = np.hstack([np.frombuffer(t.column("vec")[int(i)].as_buffer(), kind).reshape(len(keys), -1) for i in order])
        return pa.table([keys, _lists(x if sign is None else x * sign, kind)], [key, "v" if signed else "vec"])

    names = f"{key} {rows.elementType.simpleString()}, " + ("v array<float>" if signed else "vec array<double>")
    with shuffles_freed(spark):
        return written(out.groupBy("piece").applyInArrow(join, names), "joined")


def project(weights: DataFrame, model: LsiModel, key: str = "doc_idx") -> DataFrame:
    """(key, vec ARRAY<DOUBLE>): rows of weights times the components, for documents and queries alike. Components that are too many
    to be sent at once are narrowed to the terms of few weights, or sent a few columns at a time."""
    spark, n = weights.sparkSession, model.n_terms
    pieces, ids = pieces_of(weights, key, "term_idx"), None
    if n * model.k * 8 <= SLICE:
        right = model.shared(spark)
    elif at_most(weights, SMALL_ROWS):
        used = weights.select(F.col("term_idx").cast("long").alias("term_idx")).distinct()
        ids = np.sort(np.asarray(used.toArrow().column("term_idx")))  # at most SMALL_ROWS
        right = spark.sparkContext.broadcast(_columns(model.table.join(F.broadcast(spark.createDataFrame(pa.table({"term_idx": ids}))), "term_idx"), n, 0, model.k, ids))
    else:
        made = mark()
        with shuffles_freed(spark):
            pieces = written(pieces, "pieces")
        vectors = _onto(pieces, key, n, model.k, lambda a, b: _columns(model.table, n, a, b), SLICE)
        clear_written(made, last=True)
        return vectors

    def run(batches):
        for b in batches:
            for i, (end, at, value) in enumerate(_cells(b, "end", "at", "value")):
                x = _times(end, at if ids is None else np.searchsorted(ids, at), value, right.value)
                yield pa.RecordBatch.from_arrays([b.column("rows").slice(i, 1).flatten(), _lists(x, float)], [key, "vec"])

    return pieces.mapInArrow(run, f"{key} {pieces.schema['rows'].dataType.elementType.simpleString()}, vec array<double>")


def components_table(spark, model: LsiModel) -> DataFrame:
    """(term_idx, v) for saving."""
    return model.table
