"""TF-IDF weights: raw counts times ln((N + 1) / (df + 1)) + 1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import lookup
from .index import IndexedCorpus


@dataclass
class TfidfModel:
    """vocabulary(term, term_idx, df, idf) and the number of documents."""

    vocabulary: DataFrame
    n_docs: int


def fit(index: IndexedCorpus) -> TfidfModel:
    n = index.corpus.count()
    idf = F.log((F.lit(float(n)) + 1) / (F.col("df") + 1)) + 1
    return TfidfModel(index.vocabulary.select("term", "term_idx", "df", idf.alias("idf")), n)


def weights(postings: DataFrame, model: TfidfModel) -> DataFrame:
    """(doc_idx, term, term_idx, tf, weight); terms out of the vocabulary drop."""
    p = lookup(postings, model.vocabulary, ["term"], "df", "inner")
    return p.select("doc_idx", "term", "term_idx", "tf", (F.col("tf") * F.col("idf")).alias("weight"))


def query_weights(terms: DataFrame, model: TfidfModel) -> DataFrame:
    """(query_id, term, term_idx, weight) of query terms (query_id, term, tf)."""
    return terms.join(model.vocabulary, "term").select("query_id", "term", "term_idx", (F.col("tf") * F.col("idf")).alias("weight"))
