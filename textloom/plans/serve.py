"""Answers to single queries from memory, for an index that is small enough; larger ones answer tables of queries with ``Engine.search``.

A Spark job takes some 50 to 100 ms however little it does, and ``Engine.search`` takes several. ``Session`` loads what a query needs
once, after checking its size, and gives the same rows as ``Engine.search``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.spell import WordIndex
from .engine import Engine

#: Bytes of vectors, and of texts, that may be loaded; rows of the vocabulary and words.
MOST_BYTES, MOST_TEXT, MOST_WORDS = 1 << 30, 256 << 20, 2_000_000


class TooLarge(Exception):
    pass


class Session:
    """``search(text)`` gives [(rank, score, document)], a document being a dict of doc_id, text, url and metadata. Texts over
    ``MOST_TEXT`` in all stay in the store and are looked up by id."""

    def __init__(self, engine: Engine, max_distance: int = 2):
        r = engine.retriever
        if r is None:
            raise RuntimeError("fit first")
        self.engine, self.retriever = engine, r
        n = r.vectors.count()
        if n * r.lsi.k * 8 > MOST_BYTES or r.lsi.n_terms > MOST_WORDS or engine.words().count() > MOST_WORDS:
            raise TooLarge(f"{n} vectors of {r.lsi.k} numbers and their vocabulary aren't loaded; use Engine.search")
        v = r.vectors.orderBy("doc_id").toArrow()
        self.ids = v.column("doc_id").to_pylist()
        x = np.asarray(v.column("vec").combine_chunks().flatten()).reshape(-1, r.lsi.k) if n else np.zeros((0, r.lsi.k))
        self.x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
        terms = r.tfidf.vocabulary.select("term", "term_idx", "idf").toArrow()
        self.terms = dict(zip(terms.column("term").to_pylist(), zip(terms.column("term_idx").to_pylist(), terms.column("idf").to_pylist())))
        self.words = WordIndex([w for w in engine.words().select("word").toArrow().column("word").to_pylist()], max_distance) if r.corrector else None
        texts = engine.index.texts()
        self.docs = None
        if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= MOST_TEXT:
            self.docs = {d["doc_id"]: d for d in texts.toArrow().to_pylist()}

    def search(self, text: str, top_k: int = 10, threshold: float | None = None) -> list[tuple[int, float, dict]]:
        counts: dict[str, int] = {}
        for t in (self.engine.processor.tokens_of(text)):
            fixed = self.words.nearest(t) if self.words else None
            t = fixed[0] if fixed else t
            counts[t] = counts.get(t, 0) + 1
        q = np.zeros(self.retriever.lsi.k)
        known = [(self.terms[t], n) for t, n in counts.items() if t in self.terms]
        if not known:
            return []
        for (i, idf), n in known:
            q += n * idf * self.retriever.lsi.components[i]
        s = self.x @ (q / max(np.linalg.norm(q), 1e-300))
        at = np.arange(len(s)) if len(s) <= top_k else np.flatnonzero(s >= np.partition(s, len(s) - top_k)[len(s) - top_k])
        at = at[np.argsort(-s[at], kind="stable")][:top_k]
        least = self.retriever.threshold if threshold is None else threshold
        found = [(rank, min(1.0, max(0.0, float(s[i]))), self.ids[i]) for rank, i in enumerate(at.tolist(), 1)]
        found = [f for f in found if f[1] >= least]
        docs = self.docs
        if docs is None and found:
            rows = self.engine.index.texts().where(F.col("doc_id").isin([f[2] for f in found])).toArrow().to_pylist()
            docs = {d["doc_id"]: d for d in rows}
        return [(rank, score, docs[i]) for rank, score, i in found if i in docs]
