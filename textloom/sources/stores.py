"""Tables that documents, vectors, indexes and models are kept in.

A rewrite goes to a new version folder first and a small pointer file is flipped at the end, so readers see the old or the new
state and a failed write changes nothing."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import safe_key
from ..functions.text import source_key
from ..operators.index import IndexedCorpus
from ..operators.lsi import LsiModel, components_table
from ..operators.tfidf import TfidfModel
from ..plans.runtime import written
from ..schemas import DOCUMENT
from .readers import _fs_path, exists


class StoreError(Exception):
    pass


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside the file and renamed."""
    fs, p = _fs_path(spark, path)
    _, tmp = _fs_path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(tmp, p)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p) and fs.delete(p, True)


class Versioned:
    """Named tables in one folder, replaced together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _current(self) -> str | None:
        at = _read_text(self.spark, f"{self.path}/CURRENT")
        return f"{self.path}/{at.strip()}" if at else None

    def exists(self) -> bool:
        return self._current() is not None

    def replace(self, tables: dict[str, DataFrame]) -> None:
        version, old = f"v-{uuid.uuid4().hex}", self._current()
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{version}/{name}")
        write_text(self.spark, f"{self.path}/CURRENT", version)
        if old:
            _delete(self.spark, old)

    def table(self, name: str) -> DataFrame:
        at = self._current()
        if at is None or not exists(self.spark, f"{at}/{name}"):
            raise StoreError(f"there is no {name} in {self.path}")
        return self.spark.read.parquet(f"{at}/{name}")

    def clear(self) -> None:
        _delete(self.spark, self.path)


class RawStore:
    """JSON lines by source; append only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, docs: DataFrame, max_records_per_file: int = 0) -> int:
        """Appends documents with a column ``source``, partitioned by its key; rows without doc_id or text are left out. Gives
        the number of rows written."""
        rows = docs.where("doc_id is not null and text is not null").withColumn("source", source_key(F.coalesce("source", F.lit("unknown"))))
        from pyspark.sql import Observation

        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("append").option("maxRecordsPerFile", max_records_per_file).partitionBy("source").json(self.path)
        return seen.get["n"]

    def append(self, doc: dict, source: str) -> None:
        """One document; an error if it lacks a field or can't be written as JSON."""
        try:
            json.dumps(doc)
            row = (str(doc["doc_id"]), str(doc["text"]), str(doc.get("url") or ""), {str(k): str(v) for k, v in (doc.get("metadata") or {}).items()}, source)
        except (TypeError, ValueError, KeyError, AttributeError) as e:
            raise StoreError(f"not a document: {e!r}") from e
        self.save(self.spark.createDataFrame([row], "doc_id string, text string, url string, metadata map<string,string>, source string"))

    def load(self, source: str | None = None) -> DataFrame:
        """All documents or those of a source; only its partition is read."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], DOCUMENT)
        d = self.spark.read.schema(T.StructType([*DOCUMENT.fields, T.StructField("source", T.StringType())])).json(self.path)
        d = d if source is None else d.where(F.col("source") == source_name(source))
        return d.select(*DOCUMENT.names)

    def exists(self, source: str) -> bool:
        """There and not empty."""
        return bool(self.load(source).head(1))

    def clear(self, source: str) -> None:
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source_name(source))
        _delete(self.spark, f"{self.path}/source={name}")


def source_name(source: str) -> str:
    """As ``source_key`` spells it."""
    return re.sub(r"[ \t\n\x0b\f\r]+", "_", source.strip(" \t\n\x0b\f\r")).lower()


def last_of_each(rows: DataFrame, order: str | None = None) -> DataFrame:
    """The last row of each doc_id: by a column, or as the rows come if there's none."""
    others = [c for c in rows.columns if c not in ("doc_id", order)]
    at = F.col(order) if order else F.monotonically_increasing_id()
    last = rows.where("doc_id is not null").withColumn("_at", at).groupBy("doc_id").agg(F.max_by(F.struct(*others), "_at").alias("_last"))
    return last.select("doc_id", "_last.*")


class DocumentStore(Versioned):
    """Documents by doc_id."""

    def _all(self) -> DataFrame:
        return self.table("documents") if self.exists() else self.spark.createDataFrame([], DOCUMENT)

    def add(self, docs: DataFrame, order: str | None = None) -> None:
        """Inserts, or replaces those with the same doc_id; of several in the batch the last stays, by the column ``order`` or as they
        come."""
        new = last_of_each(docs.select(*dict.fromkeys([*DOCUMENT.names, *([order] if order else [])])), order).select(*DOCUMENT.names)
        new = written(new, "new-documents")
        kept = self._all().join(new.select("doc_id"), "doc_id", "left_anti")
        self.replace({"documents": kept.unionByName(new)})

    def get(self, doc_id: str) -> DataFrame:
        return self._all().where(F.col("doc_id") == doc_id)

    def get_many(self, ids: DataFrame) -> DataFrame:
        """Documents of (pos, doc_id) in that order; missing ones drop."""
        return ids.join(self._all(), "doc_id").orderBy("pos")

    def has(self, doc_id: str) -> bool:
        return bool(self.get(doc_id).select("doc_id").head(1))

    def delete(self, doc_id: str) -> bool:
        if not self.has(doc_id):
            return False
        self.replace({"documents": self._all().where(F.col("doc_id") != doc_id)})
        return True

    @staticmethod
    def key(doc_id: Column) -> Column:
        return safe_key(doc_id)


class VectorStore(Versioned):
    """(doc_id, url, vec), without texts."""

    def add(self, vectors: DataFrame, order: str | None = None) -> None:
        """Inserts or replaces, as ``DocumentStore.add``."""
        new = last_of_each(vectors.select(*dict.fromkeys(["doc_id", "url", "vec", *([order] if order else [])])), order).select("doc_id", "url", "vec")
        new = written(new, "new-vectors")
        old = self.table("vectors") if self.exists() else new.limit(0)
        self.replace({"vectors": old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)})

    def load(self) -> DataFrame:
        return self.table("vectors")


class IndexStore(Versioned):
    """Snapshots of an index, its spelling vocabulary and a manifest."""

    VERSION = "1.0"

    def save(self, index: IndexedCorpus) -> None:
        before = self.manifest()
        self.replace({"corpus": index.corpus, "postings": index.postings, "vocabulary": index.vocabulary})
        now = dt.datetime.now(dt.UTC).isoformat()
        m = {"schema_version": self.VERSION, "created_at": before.get("created_at", now), "updated_at": now, "n_documents": self.table("corpus").count(), "n_terms": self.table("vocabulary").count()}
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(m))

    def load(self) -> IndexedCorpus:
        return IndexedCorpus(self.table("corpus"), self.table("postings"), self.table("vocabulary"))

    def manifest(self) -> dict:
        """Empty if missing or broken."""
        try:
            return json.loads(_read_text(self.spark, f"{self.path}/manifest.json") or "{}")
        except ValueError:
            return {}

    def doc_ids(self) -> DataFrame:
        """Only that column is read."""
        return self.table("corpus").select("doc_id").distinct()

    def save_words(self, words: DataFrame) -> None:
        """Sorted, one a line."""
        words = written(words.select("word").distinct(), "words")  # they may come from the file that's replaced
        words.orderBy("word").write.mode("overwrite").text(f"{self.path}/words")

    def load_words(self, live: DataFrame | None = None) -> DataFrame:
        """(word, pos) of the saved words, numbered in their order, after those of ``live``; none if there's no file."""
        if exists(self.spark, f"{self.path}/words"):
            w = self.spark.read.text(f"{self.path}/words").where("value <> ''").select(F.col("value").alias("word"))
        else:
            w = self.spark.createDataFrame([], "word string")
        w = w.distinct().select("word", F.lit(1).alias("saved"), F.lit(0).cast("long").alias("pos"))
        if live is not None:
            w = live.select("word", F.lit(0).alias("saved"), F.col("pos").cast("long")).unionByName(w)
        first = w.groupBy("word").agg(F.min(F.struct("saved", "pos")).alias("p"))
        return first.select("word", F.struct("p.saved", "p.pos", F.when(F.col("p.saved") == 1, F.col("word")).alias("name")).alias("pos"))


class ModelStore(Versioned):
    """TF-IDF and projection models."""

    def save(self, tfidf: TfidfModel, lsi: LsiModel | None = None) -> None:
        tables = {"vocabulary": tfidf.vocabulary}
        if lsi is not None:
            tables["components"] = components_table(self.spark, lsi)
        self.replace(tables)
        meta = {"n_docs": tfidf.n_docs, "singular": lsi.singular.tolist() if lsi is not None else None}
        write_text(self.spark, f"{self.path}/model.json", json.dumps(meta))

    def load(self) -> tuple[TfidfModel, LsiModel | None]:
        meta = json.loads(_read_text(self.spark, f"{self.path}/model.json") or "null")
        if meta is None:
            raise StoreError(f"there is no model in {self.path}")
        lsi = None
        if meta["singular"] is not None:
            lsi = LsiModel(self.table("components"), np.array(meta["singular"]), self.table("vocabulary").count())
        return TfidfModel(self.table("vocabulary"), meta["n_docs"]), lsi
