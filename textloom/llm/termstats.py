"""Problem 6: how often every term occurs, and in how many records.

``term_frequencies`` takes (term, doc_idx, tf) postings and the records they belong to. Defined results: rows repeated
exactly and spellings that are equal after trimming, NFC and lower case count once per (term, record, tf); postings with a
null term, a blank term, a null record, a null tf, or of no live record count nothing; a vocabulary term without postings has
0 occurrences in 0 records and is rare; empty tables give no rows, or all terms rare. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_term


def live_records(corpus: DataFrame) -> DataFrame:
    """Ids of the records with non-blank text, once each. Takes (doc_idx, processed_text)."""
    return corpus.where(F.col("processed_text").rlike(r"[^\s\p{Z}]") & F.col("doc_idx").isNotNull()).select("doc_idx").distinct()


def clean_postings(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, doc_idx, tf): canonical terms, each record's term once, of live records only.

    Rows are made distinct before the records are looked up, so that the one shuffle by (term, record) is of hashed,
    map-side combined rows; the most frequent term is spread over all tasks by its records."""
    p = postings.select(canonical_term(F.col("term")).alias("term"), "doc_idx", F.col("tf").cast("bigint").alias("tf"))
    p = p.where((F.col("term") != "") & F.col("doc_idx").isNotNull() & F.col("tf").isNotNull()).distinct()
    p = p.join(live_records(corpus), "doc_idx", "left_semi")
    return p.groupBy("term", "doc_idx").agg(F.sum("tf").alias("tf"))


def term_frequencies(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, occurrences, records). Counts are combined in each task before they're shuffled, so a hot term costs a
    shuffle of one row a task."""
    return clean_postings(postings, corpus).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("records"))


def marked_vocabulary(vocabulary: DataFrame, postings: DataFrame, corpus: DataFrame, least_records: int = 3, most_share: float = 0.5) -> DataFrame:
    """(term, occurrences, records, mark) of every vocabulary term: ``rare`` in fewer than ``least_records`` records,
    ``common`` in more than ``most_share`` of the live records, else null."""
    v = vocabulary.select(canonical_term(F.col("term")).alias("term")).where(F.col("term") != "").distinct()
    n = live_records(corpus).agg(F.count(F.lit(1)).alias("_n"))
    out = v.join(term_frequencies(postings, corpus), "term", "left").na.fill(0, ["occurrences", "records"])
    mark = F.when(F.col("records") < least_records, "rare").when(F.col("records") > F.col("_n") * most_share, "common")
    return out.crossJoin(F.broadcast(n)).select("term", "occurrences", "records", mark.alias("mark"))  # n is one row
