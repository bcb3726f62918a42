"""Spelling correction against a vocabulary: the nearest word within an edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def learn(*tokens: DataFrame) -> DataFrame:
    """(word, pos): distinct words of (token, pos) tables with where each was first seen."""
    out = tokens[0].select("token", "pos")
    for t in tokens[1:]:
        out = out.unionByName(t.select("token", "pos"))
    return out.groupBy(F.col("token").alias("word")).agg(F.min("pos").alias("pos"))


def known(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The tokens that are words."""
    return tokens.join(vocabulary.select(F.col("word").alias("token")), "token", "left_semi")


def _start(length, i, parts: int):
    return F.floor(i * length / parts).cast("int")


def pieces(vocabulary: DataFrame, max_distance: int = 2) -> DataFrame:
    """(word, length, i, piece): each word cut into ``max_distance + 1`` pieces, for ``candidates``. Can be written once."""
    parts = max_distance + 1
    v = vocabulary.select("word").distinct().select("word", F.length("word").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(max_distance))).alias("i"))
    lo, hi = _start(F.col("length"), F.col("i"), parts), _start(F.col("length"), F.col("i") + 1, parts)
    return v.select("word", "length", "i", F.substr("word", lo + 1, hi - lo).alias("piece"))


def candidates(tokens: DataFrame, vocabulary: DataFrame, max_distance: int = 2, cut: DataFrame | None = None) -> DataFrame:
    """(token, word, distance) of all words within the distance. ``cut``: the vocabulary's ``pieces``, if they're there already.

    An equi-join, not a comparison of all pairs: a word cut into ``max_distance + 1`` pieces keeps at least one of them
    unchanged under as many edits, moved by at most ``max_distance`` places. A word has that many rows; a token has one for
    each place where a piece of a word of a possible length could stand."""
    d, parts = max_distance, max_distance + 1
    v = pieces(vocabulary, d) if cut is None else cut
    lo, hi = _start(F.col("length"), F.col("i"), parts), _start(F.col("length"), F.col("i") + 1, parts)
    t = tokens.select("token").distinct().select("token", F.length("token").alias("m"))
    t = t.select("token", "m", F.explode(F.sequence(F.greatest(F.col("m") - d, F.lit(0)), F.col("m") + d)).alias("length"))
    t = t.select("token", "m", "length", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("i"))
    t = t.select("token", "m", "length", "i", lo.alias("lo"), (hi - lo).alias("size")).where(F.col("size") <= F.col("m"))
    first, last = F.greatest(F.col("lo") - d, F.lit(0)), F.least(F.col("lo") + d, F.col("m") - F.col("size"))
    t = t.where(first <= last).select("token", "length", "i", "size", F.explode(F.sequence(first, last)).alias("p"))
    t = t.select("token", "length", "i", F.substr("token", F.col("p") + 1, F.col("size")).alias("piece")).distinct()
    pairs = t.join(v, ["length", "i", "piece"]).select("token", "word").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("token", "word", d))
    return pairs.where(F.col("distance") >= 0)


def trie_order(vocabulary: DataFrame) -> DataFrame:
    """(word, path): the order in which a trie that keeps children as they came lists its words, as an array to sort by: for
    each prefix of the word the place where the first word with that prefix was seen."""
    p = vocabulary.select("word", "pos", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n")).select("word", "pos", "n", F.substr("word", F.lit(1), F.col("n")).alias("prefix"))
    first = p.groupBy("prefix").agg(F.min("pos").alias("first"))
    path = p.join(first, "prefix").groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "first"))), lambda x: x["first"]).alias("path"))
    return path


def corrections(tokens: DataFrame, vocabulary: DataFrame, max_distance: int = 2, tie_break: str = "word", cut: DataFrame | None = None) -> DataFrame:
    """(token, correction, distance) of tokens with a word near enough. Ties go to the first word by code points, or with
    ``tie_break="insertion"`` to the first in trie order; the vocabulary then needs pos."""
    c = candidates(tokens, vocabulary, max_distance, cut)
    if tie_break == "insertion":
        c = c.join(trie_order(vocabulary), "word")
        best = F.min(F.struct("distance", "path", "word"))
    else:
        best = F.min(F.struct("distance", "word"))
    return c.groupBy("token").agg(best.alias("b")).select("token", F.col("b.word").alias("correction"), F.col("b.distance").alias("distance"))


def correct(tokens: DataFrame, vocabulary: DataFrame, max_distance: int = 2, tie_break: str = "word", cut: DataFrame | None = None) -> DataFrame:
    """``tokens`` with each token replaced by its correction if there is one; other columns stay."""
    fixed = corrections(tokens, vocabulary, max_distance, tie_break, cut).select("token", F.col("correction").alias("_fixed"))
    return tokens.join(fixed, "token", "left").withColumn("token", F.coalesce("_fixed", "token")).drop("_fixed")


class WordIndex:
    """A vocabulary of bounded size in memory, for correcting single words at once; finds what ``corrections`` does with ties by word."""

    def __init__(self, words: list[str], max_distance: int = 2):
        self.d, self.words = max_distance, set(words)
        self.by_piece: dict[tuple[int, int, str], list[str]] = {}
        for w in self.words:
            for i, lo, hi in self._cuts(len(w)):
                self.by_piece.setdefault((len(w), i, w[lo:hi]), []).append(w)

    def _cuts(self, n: int):
        parts = self.d + 1
        return [(i, i * n // parts, (i + 1) * n // parts) for i in range(parts)]

    def nearest(self, token: str) -> tuple[str, int] | None:
        """(word, distance) of the nearest word within the distance, the first by code points among equals."""
        if token in self.words:
            return token, 0
        found = set()
        for n in range(max(0, len(token) - self.d), len(token) + self.d + 1):
            for i, lo, hi in self._cuts(n):
                for at in range(max(0, lo - self.d), min(lo + self.d, len(token) - (hi - lo)) + 1):
                    found.update(self.by_piece.get((n, i, token[at : at + hi - lo]), ()))
        best = min(((x, w) for w in found if (x := within(token, w, self.d)) is not None), default=None)
        return (best[1], best[0]) if best else None


def within(a: str, b: str, most: int) -> int | None:
    """Edit distance, or None if it's more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None
