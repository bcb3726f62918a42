"""The inverted index as three tables, built, updated and reduced without changing what was there.

corpus(doc_idx, doc_id, text, url, metadata, tokens), postings(term, doc_idx, tf), vocabulary(term, term_idx, df, cf).
Numbers are dense and start at 0: documents in order of ``pos``, terms in order of code points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import at_most, written
from .preprocess import TextProcessor


#: A table of at most so many pairs of numbers may be broadcast.
SMALL_IDS = 1_000_000
#: Rows that may be numbered by one task.
SMALL_RANK = 200_000


@dataclass
class IndexedCorpus:
    """``documents`` are the corpus' rows without their numbers, where they are at hand: finding one by its doc_id needs no join."""

    corpus: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    documents: DataFrame | None = None

    def texts(self) -> DataFrame:
        return (self.corpus if self.documents is None else self.documents).select("doc_id", "text", "url", "metadata")

    def doc_ids(self) -> DataFrame:
        return self.corpus.select("doc_id")

    def inverted(self, block: int = 100_000) -> DataFrame:
        """(term, block, postings): each term's postings by doc_idx, in blocks of as many documents, so that a row is bounded whatever
        the term."""
        p = self.postings.withColumn("block", F.floor(F.col("doc_idx") / block))
        return p.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("doc_idx", "tf"))).alias("postings"))


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Dense numbers in the given order by a sort over all tasks: partitions are sorted by range, counted, and numbered from
    the sum of those before. No task sees all rows but for at most ``SMALL_RANK``; only one count a partition goes to the driver.
    For narrow, written tables, in an order without ties: all columns are sorted, and ranges are found by a sample before."""
    if at_most(df, SMALL_RANK):  # a sort of so few rows in one task costs less than the jobs of the other way
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") + (start - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    before, total = [], start
    for part, n in counts:
        before += [F.lit(part), F.lit(total).cast("long")]
        total += n
    base = F.create_map(*before)[F.col("_part")] if before else F.lit(start).cast("long")
    return ranged.withColumn(name, base + F.col("_in")).drop("_part", "_in")


def term_counts(corpus: DataFrame) -> DataFrame:
    """(term, doc_idx, tf): combined in each task before the shuffle."""
    return corpus.select("doc_idx", F.explode("tokens").alias("term")).groupBy("term", "doc_idx").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary_of(postings: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def number_terms(vocabulary: DataFrame) -> DataFrame:
    return numbered(written(vocabulary, "vocabulary"), [F.col("term")], "term_idx")


def _mapped(rows: DataFrame, numbers: DataFrame, key: str, small: bool) -> DataFrame:
    """``rows`` with their new numbers: where these are few they're broadcast and nothing is shuffled, else the result is written."""
    if small:
        return rows.join(F.broadcast(numbers), key)
    return written(rows.join(numbers, key), "mapped")


def _documents(docs: DataFrame) -> DataFrame:
    """With all columns of a document; those that are missing are null, ``pos`` is the order of doc_id if there's none."""
    for c, t in (("url", "string"), ("metadata", "map<string,string>")):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast(t))
    docs = docs if "pos" in docs.columns else docs.withColumn("pos", F.col("doc_id"))
    return docs.select("doc_id", "text", "url", "metadata", "pos")


def keep_frequent(postings: DataFrame, least: int) -> DataFrame:
    """Postings of terms that occur at least ``least`` times in the corpus."""
    if least <= 1:
        return postings
    often = postings.groupBy("term").agg(F.sum("tf").alias("_cf")).where(F.col("_cf") >= least).select("term")
    return postings.join(often, "term", "left_semi")


def _parts(docs: DataFrame, processor: TextProcessor | None, min_doc_length: int, min_term_frequency: int, start: int = 0):
    """(corpus, documents, postings, vocabulary without numbers) of new documents. They're written as they come, without a shuffle;
    only their ids are sorted, and terms are counted before documents have numbers."""
    # Short documents are left out when the table is read: a filter before would make Spark cut each text twice.
    d = (processor or TextProcessor()).process(docs).withColumn("_size", F.size("tokens"))
    base = written(d.withColumn("_row", F.monotonically_increasing_id()), "documents").where(F.col("_size") >= min_doc_length)
    ids = numbered(base.select("_row", "pos", "doc_id"), [F.col("pos"), F.col("doc_id"), F.col("_row")], "doc_idx", start).select("_row", "doc_idx")
    small = at_most(base.select("_row"), SMALL_IDS)
    raw = written(keep_frequent(term_counts(base.select(F.col("_row").alias("doc_idx"), "tokens")), min_term_frequency).withColumnRenamed("doc_idx", "_row"), "postings")
    postings = _mapped(raw, ids, "_row", small).select("term", "doc_idx", "tf")
    corpus = base.join(F.broadcast(ids) if small else ids, "_row").select("doc_idx", "doc_id", "text", "url", "metadata", "tokens")
    return corpus, base.select("doc_id", "text", "url", "metadata"), postings, vocabulary_of(raw)


def build(docs: DataFrame, processor: TextProcessor | None = None, min_doc_length: int = 1, min_term_frequency: int = 1) -> IndexedCorpus:
    """Index of documents (doc_id, text[, url, metadata, pos]). Doc_ids aren't made unique here; see ``dedupe``."""
    corpus, documents, postings, vocabulary = _parts(_documents(docs), processor, min_doc_length, min_term_frequency)
    return IndexedCorpus(corpus, postings, number_terms(vocabulary), documents)


def dedupe(docs: DataFrame, order: str = "pos") -> DataFrame:
    """The first row of each doc_id."""
    w = Window.partitionBy("doc_id").orderBy(order)
    return docs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def update(existing: IndexedCorpus, new: DataFrame, processor: TextProcessor | None = None, min_doc_length: int = 1) -> IndexedCorpus:
    """With the new documents whose doc_id isn't there yet, the first of each in the batch; rare terms are not dropped again.
    Only the new documents are processed."""
    fresh = dedupe(_documents(new)).join(existing.corpus.select("doc_id"), "doc_id", "left_anti")
    top = existing.corpus.agg(F.max("doc_idx")).first()[0]
    corpus, documents, postings, terms = _parts(fresh, processor, min_doc_length, 1, 0 if top is None else top + 1)
    vocabulary = existing.vocabulary.select("term", "df", "cf").unionByName(terms).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return IndexedCorpus(existing.corpus.unionByName(corpus), existing.postings.unionByName(postings), number_terms(vocabulary), existing.texts().unionByName(documents))


def remove(existing: IndexedCorpus, ids: DataFrame) -> IndexedCorpus:
    """Without the documents of the given doc_ids; numbers are dense again and terms without postings go. Only ids are sorted, and
    what the removed documents had is taken off the vocabulary's counts."""
    gone = written(ids.select("doc_id").distinct(), "gone")
    known = written(existing.corpus.select("doc_idx", "doc_id").join(gone.withColumn("_gone", F.lit(True)), "doc_id", "left").select("doc_idx", F.col("_gone").isNotNull().alias("gone")), "known")
    moved = numbered(known.where("not gone").select(F.col("doc_idx").alias("_old")), [F.col("_old")], "doc_idx")
    small = at_most(known, SMALL_IDS)
    shift = lambda t: _mapped(t.withColumnRenamed("doc_idx", "_old"), moved, "_old", small).drop("_old")
    dropped = known.where("gone").select("doc_idx")
    off = existing.postings.join(F.broadcast(dropped) if small else dropped, "doc_idx", "left_semi")
    off = vocabulary_of(off).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
    vocabulary = existing.vocabulary.select("term", "df", "cf").unionByName(off).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    return IndexedCorpus(shift(existing.corpus), shift(existing.postings).select("term", "doc_idx", "tf"), number_terms(vocabulary), existing.texts().join(gone, "doc_id", "left_anti"))


def stats(index: IndexedCorpus) -> DataFrame:
    """One row: n_documents, n_terms, total_tokens, avg_tokens_per_doc, avg_postings_per_term; zeros if empty. Two
    aggregates of a row each are joined; the vocabulary has the counts of all postings."""
    a = index.corpus.agg(F.count(F.lit(1)).alias("n_documents"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(T.LongType())
    b = index.vocabulary.agg(F.count(F.lit(1)).alias("n_terms"), total("cf").alias("total_tokens"), total("df").alias("_p"))
    ratio = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(y), F.lit(0)), F.lit(0.0))
    return a.crossJoin(F.broadcast(b)).select("n_documents", "n_terms", "total_tokens", ratio("total_tokens", "n_documents").alias("avg_tokens_per_doc"), ratio("_p", "n_terms").alias("avg_postings_per_term"))


def query_terms(queries: DataFrame, processor: TextProcessor | None = None, correct=None) -> DataFrame:
    """(query_id, term, tf) of queries (query_id, text). ``correct`` maps (query_id, pos, token) to the same with tokens
    corrected. Blank queries have no rows."""
    t = (processor or TextProcessor()).process(queries).select("query_id", F.posexplode("tokens").alias("pos", "token"))
    t = correct(t) if correct else t
    return t.groupBy("query_id", F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("tf"))
