"""The whole way from files to answers in one object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import lsi, search, spell, tfidf
from ..operators.preprocess import TextProcessor
from ..sources import readers, stores
from .runtime import shuffles_freed, written


class LsiRetriever:
    """Cosine in the latent space, top k first, then the threshold."""

    def __init__(self, processor: TextProcessor | None = None, k: int = 100, threshold: float = 0.4, corrector=None):
        self.processor, self.k, self.threshold, self.corrector = processor, k, threshold, corrector
        self.tfidf: tfidf.TfidfModel | None = None
        self.lsi: lsi.LsiModel | None = None
        self.vectors: DataFrame | None = None

    def fit(self, index: ix.IndexedCorpus) -> LsiRetriever:
        self.tfidf = tfidf.fit(index)
        spark = index.postings.sparkSession
        with shuffles_freed(spark):
            w = written(tfidf.weights(index.postings, self.tfidf).select("doc_idx", "term_idx", "weight"), "weights")
        self.lsi = lsi.fit(w, self.tfidf.n_docs, index.vocabulary.count(), self.k)
        vectors = lsi.project(w, self.lsi).join(index.corpus.select("doc_idx", "doc_id", "url"), "doc_idx").select("doc_id", "url", "vec")
        with shuffles_freed(spark):
            self.vectors = written(vectors, "vectors")  # once, not at each search
        return self

    def save(self, path: str) -> None:
        """Model and vectors in stores under ``path``."""
        if self.lsi is None:
            raise RuntimeError("fit or load a model first")
        spark = self.vectors.sparkSession
        stores.ModelStore(spark, f"{path}/model").save(self.tfidf, self.lsi)
        stores.VectorStore(spark, f"{path}/vectors").replace({"vectors": self.vectors})

    @classmethod
    def load(cls, spark: SparkSession, path: str, processor: TextProcessor | None = None, threshold: float = 0.4, corrector=None) -> LsiRetriever:
        """What ``save`` stored, ready to retrieve."""
        model, projection = stores.ModelStore(spark, f"{path}/model").load()
        if projection is None:
            raise stores.StoreError(f"there is no projection in {path}")
        r = cls(processor, projection.k, threshold, corrector)
        r.tfidf, r.lsi, r.vectors = model, projection, stores.VectorStore(spark, f"{path}/vectors").load()
        return r

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        if self.lsi is None:
            raise RuntimeError("fit or load a model first")
        w = tfidf.query_weights(ix.query_terms(queries, self.processor, self.corrector), self.tfidf)
        return lsi.project(w, self.lsi, "query_id")

    def retrieve(self, queries: DataFrame, top_k: int = 10, threshold: float | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank). A query of unknown terms only finds nothing above a positive threshold."""
        found = search.vector_top_k(self.query_vectors(queries), self.vectors, top_k).withColumn("score", search.clamp(F.col("score")))
        return found.where(F.col("score") >= (self.threshold if threshold is None else threshold))


class TfidfRetriever:
    """Cosine of TF-IDF weights."""

    def __init__(self, index: ix.IndexedCorpus, processor: TextProcessor | None = None, digits: int | None = 6):
        self.index, self.processor, self.digits = index, processor, digits
        self.model = tfidf.fit(index)
        self.norms = written(search.norms(tfidf.weights(index.postings, self.model)), "norms")

    def retrieve(self, queries: DataFrame, top_k: int = 10, threshold: float | None = None) -> DataFrame:
        q = tfidf.query_weights(ix.query_terms(queries, self.processor), self.model)
        s = search.sparse_cosine(q, tfidf.weights(self.index.postings, self.model), self.norms).join(self.index.corpus.select("doc_idx", "doc_id"), "doc_idx")
        return search.ranked(s.select("query_id", "doc_id", "score"), top_k, threshold, digits=self.digits)


class OverlapRetriever:
    """Share of the query's words that occur in the text; top k first, then positive scores."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+").alias("tokens"))

    def retrieve(self, queries: DataFrame, top_k: int = 5, threshold: float | None = None) -> DataFrame:
        q = queries.select("query_id", search.demo_tokens(F.col("text")).alias("tokens"))
        out = search.ranked(search.overlap(q, self.docs), top_k).where(F.col("score") > 0)
        return out if threshold is None else out.where(F.col("score") >= threshold)


@dataclass
class Engine:
    """From files to answers. With a ``path`` everything that's fitted is kept there and ``Engine.open`` has it again."""

    spark: SparkSession
    processor: TextProcessor
    index: ix.IndexedCorpus | None = None
    retriever: LsiRetriever | None = None
    path: str | None = None
    vocabulary: DataFrame | None = None

    def load(self, path: str, **more) -> DataFrame:
        return readers.load_directory(self.spark, path, **more)

    def build(self, docs: DataFrame, **more) -> Engine:
        self.index, self.vocabulary = ix.build(docs, self.processor, **more), None
        return self

    def update(self, docs: DataFrame) -> Engine:
        self.index, self.vocabulary = ix.update(self.index, docs, self.processor), None
        return self

    def remove(self, ids: DataFrame) -> Engine:
        self.index, self.vocabulary = ix.remove(self.index, ids), None
        return self

    def stats(self) -> DataFrame:
        return ix.stats(self.index)

    def words(self) -> DataFrame:
        """The spelling vocabulary: all tokens of all documents, those of short documents and rare terms too. It's made once."""
        if self.vocabulary is None:
            t = self.index.corpus.select("doc_idx", F.posexplode("tokens").alias("i", "token"))
            self.vocabulary = written(spell.learn(t.select("token", F.struct("doc_idx", "i").alias("pos"))), "words")
        return self.vocabulary

    def _corrector(self, max_distance: int):
        words = self.words()
        cut = written(spell.pieces(words, max_distance), "pieces")
        return lambda t: spell.correct(t, words, max_distance, cut=cut)

    def fit(self, k: int = 100, threshold: float = 0.4, max_distance: int = 2) -> Engine:
        """Fits the retriever; with a path also fills the stores of index, words, documents, model and vectors."""
        self.retriever = LsiRetriever(self.processor, k, threshold, self._corrector(max_distance)).fit(self.index)
        if self.path is not None:
            self.save(self.path)
        return self

    def save(self, path: str) -> None:
        index = stores.IndexStore(self.spark, f"{path}/index")
        words = self.words()  # before the files it may be made of are replaced
        index.save(self.index)
        self.index = index.load()
        index.save_words(words)
        docs = self.index.texts().select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce("url", F.lit("")).alias("url"), "metadata")
        stores.DocumentStore(self.spark, f"{path}/documents").replace({"documents": stores.last_of_each(docs)})
        self.retriever.save(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, processor: TextProcessor, threshold: float = 0.4, max_distance: int = 2) -> Engine:
        """The engine as ``fit`` or ``save`` left it; nothing is computed from texts again."""
        store = stores.IndexStore(spark, f"{path}/index")
        e = cls(spark, processor, store.load(), None, path)
        e.vocabulary = store.load_words()
        e.retriever = LsiRetriever.load(spark, path, processor, threshold, e._corrector(max_distance))
        return e

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return stores.IndexStore(spark, f"{path}/index").exists() and stores.ModelStore(spark, f"{path}/model").exists()

    def search(self, queries: DataFrame, top_k: int = 10, threshold: float | None = None) -> DataFrame:
        """(query_id, rank, score, document columns); texts are fetched for what was found."""
        if self.retriever is None:
            raise RuntimeError("fit first")
        found = search.RetrievalContext(self.retriever).execute_search(queries, top_k, threshold=threshold)
        return search.fetch(found, self.index.texts())
