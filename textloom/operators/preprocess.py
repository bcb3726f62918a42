"""From raw text to tokens: normalise, tokenise, drop stop words, lemmatise, bound lengths."""

from __future__ import annotations

import os
import re
import unicodedata
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pyspark
from pyspark import SparkContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import drop_words, keep_lengths, normalize_text, tokens

# General Spanish words that are dropped besides the standard list.
EXTRA_SPANISH = [
    "etc", "etcétera",
    "así", "además", "siendo",
    "hacer", "hace", "hacen", "hecho",
    "decir", "dice", "dicen", "dicho",
    "ver", "vemos", "vez", "veces",
    "ir", "va", "van", "ido",
    "dar", "da", "dan", "dado",
    "poner", "pone", "ponen", "puesto",
    "cada", "cada uno",
    "mientras", "aunque", "sino",
    "según", "mediante", "través",
    "mismo", "misma", "mismos", "mismas",
    "propio", "propia", "propios", "propias",
    "cierto", "cierta", "ciertos", "ciertas",
    "varios", "varias",
    "algún", "alguna", "algunos", "algunas",
    "ningún", "ninguna", "ningunos", "ningunas",
    "tal", "tales",
    "cualquier", "cualquiera",
    "uno", "dos", "tres", "cuatro", "cinco",
    "seis", "siete", "ocho", "nueve", "diez",
    "primero", "segundo", "tercero", "cuarto", "quinto",
    "primera", "segunda", "tercera", "cuarta", "quinta",
]

#: Token array column -> token array column of the same length or not; the identity if there's no lemmatiser.
Lemmatizer = Callable[[Column], Column]


def _standard(language: str) -> list[str]:
    """Spark's list of a language; read from its library if no session runs, as for making SQL."""
    if SparkContext._active_spark_context is not None:
        return StopWordsRemover.loadDefaultStopWords(language)
    jars = Path(os.environ.get("SPARK_HOME") or Path(pyspark.__file__).parent) / "jars"
    with zipfile.ZipFile(next(jars.glob("spark-mllib_*.jar"))) as jar:
        return jar.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split()


def stop_words(language: str = "spanish", extra: list[str] | None = None, custom: list[str] = ()) -> list[str]:
    """The standard list of the language, extra words (by default those for Spanish) and custom ones, sorted."""
    if extra is None:
        extra = EXTRA_SPANISH if language == "spanish" else []
    return sorted({*_standard(language), *extra, *custom})


@dataclass
class TextProcessor:
    """The pipeline's settings; ``process`` and ``token_column`` apply them."""

    stopwords: list[str] = field(default_factory=list)
    lowercase: bool = True
    accents: bool = True
    least: int = 2
    most: int = 20
    lemmatizer: Lemmatizer | None = None
    #: Normalised text column -> token array column, instead of cutting at blanks.
    tokenizer: Callable[[Column], Column] | None = None

    def token_column(self, text: Column) -> Column:
        """Tokens of a text. Stop words go before lemmas are formed, so a lemma that is a stop word stays."""
        arr = drop_words((self.tokenizer or tokens)(normalize_text(text, self.lowercase, self.accents)), self.stopwords)
        arr = self.lemmatizer(arr) if self.lemmatizer else arr
        return keep_lengths(arr, self.least, self.most)

    def tokens_of(self, text: str | None) -> list[str]:
        """The same in Python for a single text, such as a query. Not for processors with functions on columns."""
        if self.lemmatizer or self.tokenizer:
            raise ValueError("the processor works on columns only")
        t = text or ""
        t = unicodedata.normalize("NFC", t.lower() if self.lowercase else t)
        if not self.accents:
            t = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        stop = set(self.stopwords)
        return [w for w in re.sub(r"\W+", " ", t).split(" ") if w not in stop and self.least <= len(w) <= self.most]

    def process(self, df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
        return df.withColumn(out, self.token_column(F.col(text)))


def dictionary_lemmatizer(lemmas: dict[str, str]) -> Lemmatizer:
    """Lemmas from a bounded dictionary; other tokens stay."""
    table = F.create_map(*[F.lit(x) for kv in sorted(lemmas.items()) for x in kv]) if lemmas else None
    return lambda arr: arr if table is None else F.transform(arr, lambda t: F.coalesce(F.try_element_at(table, t), t))


def lemmatize_by_join(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(.., token) with the lemma from (token, lemma) where there's one; for dictionaries of any size."""
    return tokens.join(lemmas.withColumnRenamed("lemma", "_lemma"), "token", "left").withColumn("token", F.coalesce("_lemma", "token")).drop("_lemma")
