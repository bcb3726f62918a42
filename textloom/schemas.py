"""Explicit schemas of the tables that the engine reads and writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.MapType(T.StringType(), T.StringType())
DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("url", T.StringType()), T.StructField("metadata", METADATA)])
CORPUS = T.StructType([T.StructField("doc_idx", T.LongType()), *DOCUMENT.fields, T.StructField("tokens", T.ArrayType(T.StringType()))])
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_idx", T.LongType()), T.StructField("tf", T.LongType())])
VOCABULARY = T.StructType([T.StructField("term", T.StringType()), T.StructField("term_idx", T.LongType()), T.StructField("df", T.LongType()), T.StructField("cf", T.LongType())])
QUERY = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("text", T.StringType())])
RESULT = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.StringType()), T.StructField("score", T.DoubleType())])
VECTORS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
SCRAPED = T.StructType([T.StructField(x, T.StringType()) for x in ("title", "text", "source", "language", "date", "category")])
