"""Ranking documents for a table of queries, and fetching what was found."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import SMALL_ROWS, at_most

#: Queries compared with vectors at once, in a block that every task gets.
QUERY_BLOCK = 4096


def ranked(scores: DataFrame, k: int, threshold: float | None = None, tie: str = "doc_id", digits: int | None = None) -> DataFrame:
    """(query_id, rank, .., score): the k best of each query, ties by ``tie``; the threshold is applied after that. Spark cuts
    each partition to its k best before the shuffle."""
    s = F.round("score", digits) if digits is not None else F.col("score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    out = scores.withColumn("score", s).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out if threshold is None else out.where(F.col("score") >= threshold)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def norms(weights: DataFrame, key: str = "doc_idx") -> DataFrame:
    """(key, norm) of sparse rows."""
    return weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def sparse_cosine(query_weights: DataFrame, doc_weights: DataFrame, doc_norms: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_idx, score) of documents that share a term with the query. Only the query terms' postings are
    joined; sums are combined in each task. ``doc_norms`` as ``norms`` gives them, if they are there already."""
    q = query_weights.select("query_id", "term_idx", F.col("weight").alias("_q"))
    hits = doc_weights.select("doc_idx", "term_idx", F.col("weight").alias("_d"))
    hits = hits.join(F.broadcast(q) if at_most(q, SMALL_ROWS) else q, "term_idx")
    dots = hits.groupBy("query_id", "doc_idx").agg(F.sum(F.col("_q") * F.col("_d")).alias("_dot"))
    d = (norms(doc_weights) if doc_norms is None else doc_norms).withColumnRenamed("norm", "_nd")
    dots = dots.join(d, "doc_idx").join(norms(query_weights, "query_id").withColumnRenamed("norm", "_nq"), "query_id")
    return dots.select("query_id", "doc_idx", (F.col("_dot") / (F.col("_nd") * F.col("_nq"))).alias("score"))


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "doc_id", least: float | None = None) -> DataFrame:
    """(query_id, key, score): the k vectors of largest cosine for each query (query_id, vec), in blocks of queries against all
    rows. Each task keeps its k best, so what is shuffled is k rows a query and task. Ties go to the smaller key. Zero vectors
    score 0."""
    blocks = queries.select("query_id", "vec").where("vec is not null").toLocalIterator()
    out = None
    block: list = []

    def of(rows: list) -> DataFrame:
        ids = [r[0] for r in rows]
        q = np.array([r[1] for r in rows], float)
        q /= np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))  # at most QUERY_BLOCK vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best: list[tuple[np.ndarray, pa.Array]] = [(np.zeros(0), None)] * len(q)
            for b in batches:
                b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("vec")), q.shape[1]), False))
                if not b.num_rows:
                    continue
                b = b.take(pc.sort_indices(b.column(key)))  # so that of equal scores the first has the smaller key
                x = np.asarray(b.column("vec").flatten(), float).reshape(-1, q.shape[1])
                x = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
                for lo in range(0, len(q), 64):
                    s = q[lo : lo + 64] @ x.T
                    for i, row in enumerate(s, lo):
                        if len(row) > k:  # all that tie with the k-th stay till they're sorted
                            at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                        else:
                            at = np.arange(len(row))
                        at = at[np.argsort(-row[at], kind="stable")][:k]
                        score, names = best[i]
                        score, names = np.append(score, row[at]), (lambda t: t if names is None else pa.concat_arrays([names, t]))(b.column(key).take(pa.array(at)))
                        if len(score) > k:
                            o = np.asarray(pc.sort_indices(pa.table({"s": score, "n": names}), sort_keys=[("s", "descending"), ("n", "ascending")]))[:k]
                            score, names = score[o], names.take(pa.array(o))
                        best[i] = score, names
            got = [(i, s, n) for i, (s, n) in enumerate(best) if len(s)]
            if got:
                who = pa.array(ids).take(pa.array(np.repeat([i for i, _, _ in got], [len(s) for _, s, _ in got])))
                yield pa.RecordBatch.from_arrays([who, pa.concat_arrays([n for _, _, n in got]), pa.array(np.concatenate([s for _, s, _ in got]))], ["query_id", key, "score"])

        types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
        return vectors.select(key, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, types)

    for r in blocks:
        block.append(r)
        if len(block) == QUERY_BLOCK:
            out = of(block) if out is None else out.unionByName(of(block))
            block = []
    if block:
        out = of(block) if out is None else out.unionByName(of(block))
    if out is None:
        return vectors.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    top = ranked(out, k, None, key)
    return top if least is None else top.where(F.col("score") >= least)


def overlap(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): share of the query's tokens that are in the document, to 3 places. queries and docs:
    (.., tokens); found by joining tokens."""
    q = queries.select("query_id", F.array_distinct("tokens").alias("t")).where(F.size("t") > 0).select("query_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    d = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token"))
    hits = d.join(F.broadcast(q) if at_most(q, SMALL_ROWS) else q, "token")
    return hits.groupBy("query_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("c")).select("query_id", "doc_id", F.round(F.col("c") / F.col("n"), 3).alias("score"))


def demo_tokens(text: Column) -> Column:
    """Lower case, split at white space, punctuation off both ends, at least three characters."""
    words = F.split(F.lower(text), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:!?\"'()\[\]{}]+|[.,;:!?\"'()\[\]{}]+$", ""))
    return F.filter(bare, lambda w: F.length(w) >= 3)


def fetch(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The found rows with their documents' columns; documents that are missing drop. Texts are read last, for the rows that
    are left."""
    return found.join(docs, "doc_id").orderBy("query_id", "rank")


def fetch_by_ids(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of (pos, doc_id) in order of pos."""
    return ids.join(docs, "doc_id").orderBy("pos")


class Retriever(Protocol):
    def retrieve(self, queries: DataFrame, top_k: int = 10, threshold: float | None = None) -> DataFrame: ...


class RetrievalContext:
    """Holds a retriever that can be changed at run time."""

    def __init__(self, retriever: Retriever):
        self.retriever = retriever

    def execute_search(self, queries: DataFrame, top_k: int = 10, **more) -> DataFrame:
        return self.retriever.retrieve(queries, top_k, **more)


def console_lines(results: DataFrame) -> DataFrame:
    """(query_id, rank, line): a result as it's printed; results have metadata, url and text."""
    title = F.coalesce(F.try_element_at("metadata", F.lit("title")), F.col("doc_id").cast("string"))
    url = F.when(F.coalesce("url", F.lit("")) == "", "(no url)").otherwise(F.col("url"))
    short = F.concat(F.regexp_replace(F.substring("text", 1, 120), "\n", " "), F.lit("..."))
    return results.select("query_id", "rank", F.format_string("%d. [%.3f] %s | %s | %s", "rank", "score", title, url, short).alias("line"))


def stats_lines(stats: DataFrame) -> DataFrame:
    """(name, line) of a row of figures as it's printed: names in 25 places, fractions with two."""
    rows = [F.struct(F.lit(f.name).alias("name"), F.format_string(f"  %-25s: {'%.2f' if f.dataType.typeName() == 'double' else '%d'}", F.lit(f.name), F.col(f.name)).alias("line")) for f in stats.schema]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
