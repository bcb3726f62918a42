"""Problem 2: how distinctive a term is for a record.

Each term's occurrence counts are seen as a mixture of two Poisson distributions, the elite records (about the term) and
the rest. The mixture is fitted by expectation-maximisation on the term's frequency histogram: how many records have it
0, 1, 2 ... times. The posterior of the elite component scores each count; the same histogram gives df and so the weight
tf * (ln((1 + N) / (1 + df)) + 1).

Defined results: postings as in ``termstats``; a term with one distinct count (all records alike) can't be told apart into
two components unless zeros do it, so zeros are part of the histogram; empty tables give no rows. The histogram of a term
has as many entries as it has distinct counts, not records, so no task holds a hot term's records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import lookup, written
from .termstats import clean_postings, live_records

#: Rounds at most, and the largest change of a posterior in a round at which a term is done.
ROUNDS, CLOSE = 3000, 1e-8


def _start(owner, tf, n, terms):
    total = np.bincount(owner, n, terms)
    mean = np.bincount(owner, n * tf, terms) / np.maximum(total, 1)
    pos = tf > 0
    seen = np.bincount(owner[pos], n[pos], terms)
    high = np.maximum(np.bincount(owner[pos], (n * tf)[pos], terms) / np.maximum(seen, 1), 1e-3) + 0.5
    share = np.clip(seen / np.maximum(total, 1), 1e-6, 1 - 1e-6) * 0.5
    return share, high, np.maximum(mean * 0.5, 1e-6)


def _step(owner, tf, n, share, high, low):
    """A round of expectation and maximisation, and the log-likelihood of what it was given (up to a constant of the data)."""
    terms = len(share)
    s, h, l = share[owner], high[owner], low[owner]
    z = np.log(s) - np.log1p(-s) + tf * (np.log(h) - np.log(l)) - (h - l)
    like = np.bincount(owner, n * (np.log1p(-s) + tf * np.log(l) - l + np.logaddexp(0, z)), terms)
    w = n / (1 + np.exp(-np.clip(z, -500, 500)))
    r = n - w
    got, rest = np.bincount(owner, w, terms), np.bincount(owner, r, terms)
    share = np.clip(got / np.maximum(got + rest, 1e-12), 1e-9, 1 - 1e-9)
    high = np.maximum(np.bincount(owner, w * tf, terms) / np.maximum(got, 1e-12), 1e-6)
    low = np.maximum(np.bincount(owner, r * tf, terms) / np.maximum(rest, 1e-12), 1e-9)
    swap = low > high
    return np.where(swap, 1 - share, share), np.where(swap, low, high), np.where(swap, high, low), like


def fit_two_poisson(owner: np.ndarray, tf: np.ndarray, n: np.ndarray, terms: int, rounds: int = ROUNDS, close: float = CLOSE):
    """EM of many terms at once until no posterior of a term changes by more than ``close`` in a round; terms that are done take no
    further part. Every third step goes on in the direction of the two before it (squared extrapolation, Varadhan and Roland
    2008) where that doesn't lower the likelihood. owner: the term of each histogram entry; tf, n: count and number of records.
    Gives (share of elite, rate of elite, rate of the rest) by term."""
    theta = [x.copy() for x in _start(owner, tf, n, terms)]
    live = np.arange(terms)
    o, t, m = owner, tf, n
    for _ in range(max(1, rounds // 3)):
        if not len(live):
            break
        zero = [x[live] for x in theta]
        *one, _ = _step(o, t, m, *zero)
        *two, _ = _step(o, t, m, *one)
        # The jump, in coordinates that know no bounds.
        flat = lambda p: np.stack([np.log(p[0]) - np.log1p(-p[0]), np.log(p[1]), np.log(p[2])])
        x0, x1, x2 = flat(zero), flat(one), flat(two)
        r, v = x1 - x0, x2 - 2 * x1 + x0
        a = -np.clip(np.sqrt((r * r).sum(0) / np.maximum((v * v).sum(0), 1e-300)), 1, 256)
        x = np.clip(x0 - 2 * a * r + a * a * v, -20, 20)
        jump = [np.clip(1 / (1 + np.exp(-x[0])), 1e-9, 1 - 1e-9), np.exp(x[1]), np.exp(x[2])]
        *after, like = _step(o, t, m, *jump)
        *plain, before = _step(o, t, m, *two)
        better = like >= before
        base = [np.where(better, j, p) for j, p in zip(jump, two)]
        new = [np.where(better, j, p) for j, p in zip(after, plain)]
        change = np.zeros(len(live))
        np.maximum.at(change, o, np.abs(elite(t, *(x[o] for x in new)) - elite(t, *(x[o] for x in base))))
        for x, y in zip(theta, new):
            x[live] = y
        open_ = change > close
        if not open_.all():
            keep = open_[o]
            o, t, m = (np.cumsum(open_) - 1)[o[keep]], t[keep], m[keep]
            live = live[open_]
    return tuple(theta)


def elite(tf, share, high, low):
    """Posterior of the elite component given a count; stays finite for any count."""
    z = np.log(share) - np.log1p(-share) + tf * (np.log(high) - np.log(low)) - (high - low)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _scores(n_records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hist, terms = b.column("hist"), b.num_rows
            if not terms:
                continue
            sizes = np.asarray(pc.list_value_length(hist)).astype(np.int64)
            flat = pc.list_flatten(hist)
            counts, records = (np.asarray(pc.struct_field(flat, k)) for k in ("tf", "n"))
            owner, k = np.repeat(np.arange(terms), sizes), np.arange(terms)
            tf, n = counts.astype(float), records.astype(float)
            df = np.bincount(owner, n, terms)
            zeros = np.maximum(n_records - df, 0)
            share, high, low = fit_two_poisson(np.concatenate([owner, k]), np.concatenate([tf, np.zeros(terms)]), np.concatenate([n, zeros]), terms)
            yield pa.RecordBatch.from_arrays([b.column("term").take(pa.array(owner)), pa.array(counts), pa.array(records), pa.array(df[owner].astype(np.int64)), pa.array(elite(tf, share[owner], high[owner], low[owner]))], ["term", "tf", "n", "df", "elite"])

    return run


def term_scores(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_idx, term, tf, df, elite, weight): each term of each live record, with the posterior that the record is about
    the term and the smoothed tf-idf weight rounded to 6 places. Records look their scores up by (term, tf), of which the most
    frequent are broadcast, so a term that a tenth of all records have once makes no hot task."""
    n = live_records(corpus).count()
    p = written(clean_postings(postings, corpus), "clean-postings")
    hist = p.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.collect_list(F.struct("tf", "n")).alias("hist"))
    s = written(hist.mapInArrow(_scores(n), "term string, tf long, n long, df long, elite double"), "term-scores")
    weight = F.round(F.col("tf") * (F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1), 6)
    return lookup(p, s, ["term", "tf"], "n", "inner").select("doc_idx", "term", "tf", "df", "elite", weight.alias("weight"))


def top_terms(scores: DataFrame) -> DataFrame:
    """(doc_idx, term, weight, elite): each record's term of the largest weight, the first by code points among equals.
    A minimum over structs is combined in each task, so a long record isn't gathered."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("term"), F.col("elite"))).alias("b")
    return scores.groupBy("doc_idx").agg(best).select("doc_idx", "b.term", (-F.col("b.w")).alias("weight"), "b.elite")
