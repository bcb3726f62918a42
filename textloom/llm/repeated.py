"""Problem 1: lines that come back in many documents of one source.

Lines are hashed in normal form together with their source (128 bits); the documents of each hash are counted with map-side
combining; hashes over the threshold, a number of documents and if wanted a share of the source's documents, are joined back
to the lines, and the documents are rebuilt without them. Normal form: NFC, lower case, each run of 0-9 made ``0``, each run of
anything but letters and numbers made one blank, trimmed.

Hot lines (a notice on every page of a source that holds a third of all rows) don't meet in one task: see ``lookup``. Texts
are rebuilt where they're read, without a shuffle, as long as the repeated lines' keys fit ``MOST_KEYS``.

Defined results: doc_id is the document's identity, so rows of one doc_id are one document, and each of them is cut; null or empty
texts have no lines; null sources have no repeated lines; lines without a letter or number never count; a document repeating a
line counts once for it; rows of null doc_id count nothing and stay as they are; other columns pass through unchanged; empty
tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.runtime import at_most, lookup, written
from .lines import scan_lines, texts_without

#: At most so many keys of 16 bytes are sent to all tasks.
MOST_KEYS = 2_000_000


def line_counts_of(keys: DataFrame, least_documents: int = 6, least_share: float = 0.0) -> DataFrame:
    """(a, b, documents, rows) of the keys that occur in enough different documents. Rows with a doc_id of their own are counted
    without a look at their ids; only the lines of doc_ids that come several times are made distinct first."""
    twice = written(keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "twice")
    lines = lambda d: d.select("doc_id", "source_id", F.explode(F.arrays_zip("a", "b", "again")).alias("k")).where("k.b <> 0").select("doc_id", "source_id", "k.*")
    count = lambda d, new: d.groupBy("a", "b").agg(F.count_if(new).alias("documents"), F.count(F.lit(1)).alias("rows"), F.max("source_id").alias("source_id"))
    if twice.isEmpty():
        counts = count(lines(keys), ~F.col("again"))
    else:
        marked = lookup(keys, twice, ["doc_id"], "rows").withColumnRenamed("rows", "copies")
        once = count(lines(marked.where("copies is null")), ~F.col("again"))
        several = lines(marked.where("copies is not null")).groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("source_id").alias("source_id"))
        several = several.groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("rows"), F.max("source_id").alias("source_id"))
        counts = once.unionByName(several).groupBy("a", "b").agg(F.sum("documents").alias("documents"), F.sum("rows").alias("rows"), F.max("source_id").alias("source_id"))
    counts = counts.where(F.col("documents") >= least_documents)
    if least_share > 0:
        sizes = keys.where("source_id is not null").select("source_id", "doc_id").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("size"))
        counts = counts.join(sizes, "source_id").where(F.col("documents") >= least_share * F.col("size"))
    return written(counts.select("a", "b", "documents", "rows"), "line-counts")


def repeated_lines(docs: DataFrame, least_documents: int = 6, least_share: float = 0.0) -> DataFrame:
    """(doc_id, line_no, documents): each line that occurs in at least ``least_documents`` documents of its source, and at least
    that share of them."""
    return repeated_of(written(scan_lines(docs), "line-keys"), least_documents, least_share)


def repeated_of(keys: DataFrame, least_documents: int = 6, least_share: float = 0.0) -> DataFrame:
    """The same from the result of ``scan_lines``, which is read several times and so should be a written table."""
    lines = keys.select("doc_id", F.posexplode(F.arrays_zip("a", "b")).alias("line_no", "k")).where("k.b <> 0").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "k.a", "k.b")
    counts = line_counts_of(keys, least_documents, least_share)
    return lookup(lines, counts, ["a", "b"], "rows", "inner").select("doc_id", "line_no", "documents").distinct()


@F.pandas_udf(StringType())
def _without(text: pd.Series, drop: pd.Series) -> pd.Series:
    def one(t, d):
        if t is None or d is None:
            return t
        d = set(d)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in d)

    return pd.Series([one(t, d) for t, d in zip(text, drop)], dtype=object)


def without_repeated_lines(docs: DataFrame, least_documents: int = 6, least_share: float = 0.0) -> DataFrame:
    """``docs`` with text rebuilt without its source's repeated lines; the other columns and rows as they were."""
    counts = line_counts_of(written(scan_lines(docs), "line-keys"), least_documents, least_share)
    if at_most(counts, MOST_KEYS):
        k = counts.select("a", "b").toPandas()  # at most MOST_KEYS
        a, b = k["a"].to_numpy(np.int64), k["b"].to_numpy(np.int64)
        order = np.lexsort((b, a))
        return texts_without(docs, a[order], b[order])
    rows = docs.withColumn("_tl_text", F.xxhash64("text"))
    keys = written(scan_lines(rows.withColumn("_tl_id", F.struct("doc_id", "source", "_tl_text")).where("doc_id is not null").drop("doc_id").withColumnRenamed("_tl_id", "doc_id")), "line-keys")
    lines = keys.select("doc_id", F.posexplode(F.arrays_zip("a", "b")).alias("line_no", "k")).where("k.b <> 0").select("doc_id", "line_no", "k.a", "k.b")
    drop = lookup(lines, counts, ["a", "b"], "rows", "inner").groupBy(F.col("doc_id").alias("_tl_id")).agg(F.collect_set("line_no").alias("_tl_drop"))
    out = rows.join(drop, F.struct("doc_id", "source", "_tl_text").eqNullSafe(F.col("_tl_id")), "left")
    text = F.when(F.col("_tl_drop").isNull(), F.col("text")).otherwise(_without(F.when(F.col("_tl_drop").isNotNull(), F.col("text")), F.col("_tl_drop")))
    return out.withColumn("text", text).drop("_tl_id", "_tl_drop", "_tl_text")
