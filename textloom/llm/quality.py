"""Problem 10: statistics of each text, and what kind of text it is.

A pass over the texts counts words, symbols, stops, common words and so on by line; the source's repeated lines are left
out of the sums by document. Thresholds on the statistics are noisy labelling functions, each of which votes for one kind
or abstains. Their rates of voting by kind are learned by expectation-maximisation on how they agree, over the counts of all
vote patterns (at most 2 ** number of functions, whatever the corpus), and give the posterior of each kind. The likeliest kind
is the text's, the first of ``KINDS`` among equals.

An exact check follows, which can only reject: a text of which not most lines are entries, not most are rows, or not most
characters are in lines that aren't meaningful isn't a list, a table or junk, and counts as prose.

Defined results: null texts have no row; blank texts, and texts of which only repeated lines remain, are ``prose`` with
zeros; texts of null sources have no repeated lines; doc_id is unique; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import written
from .lines import FEATS, scan_lines
from .repeated import repeated_of

KINDS = ("prose", "list", "table", "junk")
SUMS = [f"s_{x}" for x in FEATS]
#: At most so many common words are sent to the tasks.
MOST_COMMON_WORDS = 100_000

#: (name, kind it votes for, threshold on the statistics of a frame).
LABELLERS = [
    ("entries", "list", lambda d: d.share_item > 0.5),
    ("marks", "list", lambda d: d.share_marked > 0.5),
    ("short_lines", "list", lambda d: (d.words_a_line < 7) & (d.share_row < 0.3) & (d.share_junk < 0.3) & (d.share_stop < 0.3)),
    ("rows", "table", lambda d: d.share_row > 0.5),
    ("values", "table", lambda d: (d.share_row > 0.3) & (d.share_numbers > 0.15)),
    ("noise", "junk", lambda d: d.share_junk > 0.5),
    ("symbols", "junk", lambda d: d.symbol_ratio > 0.25),
    ("no_vowels", "junk", lambda d: d.share_vowelless > 0.4),
    ("repetition", "junk", lambda d: (d.distinct_ratio < 0.4) & (d.words > 8)),
    ("numbers", "junk", lambda d: (d.share_numbers > 0.6) & (d.share_row < 0.3)),
    ("common", "prose", lambda d: d.share_common > 0.25),
    ("long_lines", "prose", lambda d: (d.words_a_line > 9) & (d.share_junk < 0.3) & (d.share_row < 0.3)),
    ("stops", "prose", lambda d: (d.share_stop > 0.5) & (d.words_a_line > 5)),
]


def _by_document(b: pa.RecordBatch) -> pd.DataFrame:
    """Sums of the counts of each document's lines, without blank lines and those of the numbers in ``drop``."""
    x = np.frombuffer(b"".join(b.column("feats").to_pylist()), np.float32).reshape(-1, len(FEATS)).astype(float)
    n = np.asarray(pc.binary_length(b.column("feats"))).astype(np.int64) // (4 * len(FEATS))
    end = np.cumsum(n)
    keep = x[:, 0] > 0
    many = np.asarray(pc.fill_null(pc.list_value_length(b.column("drop")), 0)).astype(np.int64)
    keep[np.repeat(end - n, many) + np.asarray(pc.list_flatten(b.column("drop")), np.int64)] = False
    x[~keep] = 0
    noise = np.where(x[:, FEATS.index("junk")] > 0, x[:, 0], 0)
    done = np.concatenate([np.zeros((1, len(FEATS) + 2)), np.cumsum(np.column_stack([keep, noise, x]), 0)])
    return pd.DataFrame(done[end] - done[end - n], columns=["lines", "s_noise", *SUMS])


def _statistics(d: pd.DataFrame) -> pd.DataFrame:
    n, w, c = d["lines"].clip(lower=1), d["s_words"].clip(lower=1), d["s_chars"].clip(lower=1)
    return pd.DataFrame({
        "lines": d["lines"].astype("int64"), "words": d["s_words"].astype("int64"), "mean_word_length": d["s_letters"] / w,
        "symbol_ratio": d["s_symbols"] / c, "share_stop": d["s_stop"] / n, "share_common": d["s_common"] / w, "share_numbers": d["s_numbers"] / w,
        "share_vowelless": d["s_vowelless"] / w, "distinct_ratio": d["s_distinct"] / w, "words_a_line": d["s_words"] / n,
        "share_item": d["s_item"] / n, "share_row": d["s_row"] / n, "share_marked": d["s_marked"] / n, "share_junk": d["s_noise"] / c,
    })


_TYPES = "lines long, words long, mean_word_length double, symbol_ratio double, share_stop double, share_common double, share_numbers double, share_vowelless double, distinct_ratio double, words_a_line double, share_item double, share_row double, share_marked double, share_junk double, votes long"


def _with_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = _statistics(_by_document(b))
        bits = np.zeros(len(s), np.int64)
        for k, (_, _, rule) in enumerate(LABELLERS):
            bits |= rule(s).to_numpy().astype(np.int64) << k
        s["votes"] = np.where(s["lines"] > 0, bits, -1)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[c]) for c in s)], ["doc_id", *s])


def statistics_of(scan: DataFrame, repeated: DataFrame) -> DataFrame:
    """The statistics and votes by document. Documents meet with their repeated line numbers by doc_id: what is shuffled are
    a few counts a line, not texts."""
    drop = repeated.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("line_no").alias("drop"))
    d = scan.join(drop, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "feats", "drop")
    return d.mapInArrow(_with_votes, f"doc_id {scan.schema['doc_id'].dataType.simpleString()}, {_TYPES}")


def fit_labellers(patterns: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: share of each kind, and how often each labelling function votes when the kind is given."""
    on = (patterns[:, None] >> np.arange(len(LABELLERS)) & 1).astype(float)
    for_kind = np.array([[k == kind for _, kind, _ in LABELLERS] for k in KINDS], float)
    got = on @ for_kind.T + np.array([0.5, 0.1, 0.1, 0.1])
    post = got / got.sum(1, keepdims=True)
    for _ in range(rounds):
        w = post * count[:, None]
        total = w.sum(0)
        prior = (total + 1) / (total.sum() + len(KINDS))
        rate = (w.T @ on + 0.5 * (for_kind + 0.02)) / (total[:, None] + 1)
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        post = _posterior(on, prior, rate)
    return prior, rate


def _posterior(on: np.ndarray, prior: np.ndarray, rate: np.ndarray) -> np.ndarray:
    z = np.log(prior) + on @ np.log(rate).T + (1 - on) @ np.log1p(-rate).T
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def text_kinds(docs: DataFrame, common_words: list[str], least_documents: int = 6) -> DataFrame:
    """Statistics of every text with kind and the posterior of each kind."""
    if len(common_words) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    scan = written(scan_lines(docs, common_words), "scan")
    stats = written(statistics_of(scan, repeated_of(scan, least_documents)), "statistics")
    seen = stats.where("votes >= 0").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toPandas()  # bounded by 2 ** labellers
    patterns = seen["votes"].to_numpy(np.int64)
    if not len(patterns):
        patterns, seen = np.zeros(1, np.int64), pd.DataFrame({"n": [0]})
    prior, rate = fit_labellers(patterns, seen["n"].to_numpy(float))
    none = [1.0, 0.0, 0.0, 0.0]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = b["votes"].to_numpy(np.int64)
            on = (np.maximum(v, 0)[:, None] >> np.arange(len(LABELLERS)) & 1).astype(float)
            post = np.where((v < 0)[:, None], none, _posterior(on, prior, rate))
            pick = post.argmax(1)
            most = np.stack([np.ones(len(b), bool), b["share_item"] > 0.5, b["share_row"] > 0.5, b["share_junk"] > 0.5], 1)
            pick = np.where(most[np.arange(len(b)), pick], pick, 0)
            out = b.drop(columns="votes")
            out["kind"] = np.array(KINDS, object)[pick]
            for k, name in enumerate(KINDS):
                out[f"p_{name}"] = post[:, k]
            yield out

    types = _TYPES.removesuffix(", votes long") + ", kind string, " + ", ".join(f"p_{k} double" for k in KINDS)
    return stats.mapInPandas(label, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {types}")
