"""Problem 7: the language of each block and each document.

For each language an interpolated Kneser-Ney model over the characters of words (with their edges) is trained on paragraphs
of known language. The models are kept together in sorted hash arrays: by order, the hashes of all n-grams with a row of
probabilities by language, and those of all contexts with a row of back-off weights. A word is scored when it is first met;
a task keeps the scores of at most ``MEMO`` words, by their hashes. A sentence's cross-entropy is the sum over its words by
characters. A block's language is that of most of its words, sentence by sentence; where a sentence can't tell, by the block,
and where a block can't, by the document.
A block is rejected (language null) if even its best cross-entropy is as high as that of held-out paragraphs whose words' letters
have been shuffled, and higher than that of any held-out sentence.

Confidence: softmax of the log-likelihoods, tempered so that held-out sentences are calibrated.

Defined results: null texts have no rows; blank texts have no blocks and a null language; blocks without a letter are
rejected; ties go to the language first by name; repeated rows come out repeatedly; extra columns are ignored; whole texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.flat import LETTER, NUMBER, SPACE, Flat, flatten
from .lines import cut_lines

ORDER = 5
#: The models are trained on the driver; more sample text than this isn't accepted.
MOST_SAMPLE_CHARS = 20_000_000
#: Places for words whose scores a task keeps; a word takes the place of another.
MEMO = 1 << 16
#: Names and codes by language; what stands before - or _ counts.
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "esp", "spanish", "español", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "pt": ("pt", "por", "portuguese", "português"),
}


def stated_language(c: Column, langs: list[str] = ()) -> Column:
    """The language that a label states, or null. Languages beyond those of ``NAMES`` are known by their own codes."""
    code = F.lower(F.regexp_extract(F.trim(c), r"^([^-_]+)", 1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lang, names in {**{x: (x.lower(),) for x in langs}, **NAMES}.items():
        out = out.when(code.isin(*names), F.lit(lang))
    return out


def _flat_of(words: list[str]) -> tuple[Flat, np.ndarray]:
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return Flat(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), off), off


def _kneser_ney(words: Counter, alphabet: int) -> tuple[list[dict], list[dict]]:
    """Probability of every n-gram seen and back-off weight of every context, by order from 1."""
    raw = [Counter() for _ in range(ORDER + 1)]
    for w, n in words.items():
        for i in range(1, len(w)):
            for k in range(1, min(ORDER, i + 1) + 1):
                raw[k][w[i - k + 1 : i + 1]] += n
    probs, backs = [], []
    lower: dict[str, float] = {}
    for k in range(1, ORDER + 1):
        if k == ORDER:
            count = dict(raw[k])
        else:  # in how many ways it's continued to the left; n-grams at a word's beginning have no left
            count = Counter(g[1:] for g in raw[k + 1])
            for g, n in raw[k].items():
                if g[0] == " " and k > 1:
                    count[g] = n
            count = {g: n for g, n in count.items() if g in raw[k]}
        total, kinds = defaultdict(int), defaultdict(int)
        for g, n in count.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        ones, twos = sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        back = {h: d * kinds[h] / total[h] for h in total}
        prob = {g: max(n - d, 0) / total[g[:-1]] + back[g[:-1]] * (lower.get(g[1:], 1 / alphabet) if k > 1 else 1 / alphabet) for g, n in count.items()}
        probs.append(prob)
        backs.append(back)
        lower = prob
    return probs, backs


class Model:
    """langs, and by order sorted hashes with rows of log-probabilities (NaN where not seen) and of log back-off weights."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        if not self.langs:
            raise ValueError("no samples of known language")
        if sum(len(t) for _, t in samples) > MOST_SAMPLE_CHARS:
            raise ValueError(f"more than {MOST_SAMPLE_CHARS} characters of samples")
        self.limit, self.temper = np.inf, 1.0
        train = [x for i, x in enumerate(samples) if i % 5]
        held = [x for i, x in enumerate(samples) if not i % 5]
        if {a for a, _ in train} == set(self.langs) and held:
            self._fit(train)
            self._calibrate(held)
        self._fit(samples)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_memo": None}

    def _fit(self, samples) -> None:
        self._memo = None
        words = {lang: Counter() for lang in self.langs}
        for lang, text in samples:
            for _, _, f in flatten(pa.array([text], pa.string()), nfc=True, lower=True):
                for a, b in zip(*(x.tolist() for x in f.runs(f.cls == LETTER))):
                    words[lang][f" {f.text(a, b)} "] += 1
        alphabet = len({c for w in words.values() for x in w for c in x}) + 50
        fitted = [_kneser_ney(words[lang], alphabet) for lang in self.langs]
        self.floor = float(np.log(1 / alphabet))
        self.grams, self.contexts = [], []
        for k in range(ORDER):
            for into, which, missing in ((self.grams, 0, np.nan), (self.contexts, 1, 0.0)):
                keys = sorted({g for m in fitted for g in m[which][k]})
                f, off = _flat_of(keys)
                h = f.hashes(off[:-1], off[1:])
                order = np.argsort(h)
                value = np.array([[np.log(m[which][k][g]) if g in m[which][k] else missing for m in fitted] for g in keys], np.float32).reshape(-1, len(self.langs))
                into.append((h[order], value[order]))

    def word_scores(self, f: Flat, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood by language and number of characters of each word; all begin and end with a blank in the model."""
        size = end - start + 2
        off = np.concatenate([[0], np.cumsum(size)])
        cp = np.full(off[-1], 32, np.uint32)
        inner = np.repeat(start - off[:-1] - 1, size) + np.arange(off[-1])
        mask = np.ones(off[-1], bool)
        mask[off[:-1]] = mask[off[1:] - 1] = False
        cp[mask] = f.cp[inner[mask]]
        g = Flat(cp, off)
        first = np.repeat(off[:-1], size)
        pos = np.flatnonzero(np.arange(off[-1]) > first)
        score = np.full((len(pos), len(self.langs)), self.floor, np.float32)
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(pos - k + 1 >= first[pos])
            p = pos[at]
            back = self._look(self.contexts[k - 1], g.hashes(p - k + 1, p), 0.0)
            seen = self._look(self.grams[k - 1], g.hashes(p - k + 1, p + 1), np.nan)
            score[at] = np.where(np.isnan(seen), score[at] + back, seen)
        word = np.repeat(np.arange(len(size)), size)[pos]
        ll = np.stack([np.bincount(word, score[:, j], len(size)) for j in range(len(self.langs))], 1)
        return ll, size - 1

    @staticmethod
    def _look(table, h: np.ndarray, missing: float) -> np.ndarray:
        keys, value = table
        if not len(keys):
            return np.full((len(h), value.shape[1]), missing, np.float32)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = value[at]
        out[keys[at] != h] = missing
        return out

    def score(self, f: Flat, start: np.ndarray, end: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods by language, and characters, of each owner of words."""
        if not len(start):
            return np.zeros((owners, len(self.langs))), np.zeros(owners)
        code, distinct = pd.factorize(f.hashes(start, end))
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        ll, n = self._known(distinct, f, start[first], end[first]), end[first] - start[first] + 1
        return np.stack([np.bincount(owner, ll[code, j], owners) for j in range(len(self.langs))], 1), np.bincount(owner, n[code], owners)

    def _known(self, h: np.ndarray, f: Flat, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-likelihoods by language of words of these hashes, which are scored only if they aren't among those kept."""
        if self._memo is None:
            self._memo = np.zeros(MEMO, np.uint64), np.zeros((MEMO, len(self.langs)))
            self._memo[0][0] = 1  # place 0 is no other's than hash 0's, so that no free place looks taken
        keys, value = self._memo
        at = (h & np.uint64(MEMO - 1)).astype(np.int64)
        out = value[at]
        new = np.flatnonzero(keys[at] != h)
        if len(new):
            out[new] = self.word_scores(f, start[new], end[new])[0]
            keys[at[new]] = h[new]
            new = new[keys[at[new]] == h[new]]  # the one that stayed of several at a place
            value[at[new]] = out[new]
        return out

    def _calibrate(self, held) -> None:
        best, lls, right, noise = [], [], [], []
        rng = np.random.default_rng(0)
        mixed = [" ".join("".join(rng.permutation(list(w))) for w in t.lower().split()) for _, t in held]
        for _, _, f in flatten(pa.array(mixed, pa.string()), nfc=True, lower=True):
            ws, we = f.runs(f.cls == LETTER)
            ll, n = self.score(f, ws, we, f.rows_of(ws), len(mixed))
            noise += (-ll[n > 0].max(1) / n[n > 0]).tolist()
        for _, _, f in flatten(pa.array([t for _, t in held], pa.string()), nfc=True, lower=True):
            ws, we = f.runs(f.cls == LETTER)
            sent = sentences(f)
            ll, n = self.score(f, ws, we, np.searchsorted(sent, ws, "right") - 1, len(sent))
            row = f.rows_of(sent)
            truth = np.array([self.langs.index(held[r][0]) for r in row.tolist()])
            ok = n > 0
            best += (-ll[ok].max(1) / n[ok]).tolist()
            lls.append(ll[ok])
            right.append(truth[ok])
        ll, right = np.concatenate(lls), np.concatenate(right)
        self.limit = max(float(np.max(best)), float(np.min(noise)) if noise else np.inf)
        temper = (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)
        loss = [-np.log(np.maximum(softmax(ll * t)[np.arange(len(right)), right], 1e-9)).mean() for t in temper]
        self.temper = temper[int(np.argmin(loss))]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def sentences(f: Flat) -> np.ndarray:
    """Where sentences begin: at rows, at lines, and after a full stop, question or exclamation mark before white space."""
    cp = f.cp
    stop = ((cp == 46) | (cp == 33) | (cp == 63))[:-1] & (f.cls[1:] == SPACE) if len(cp) > 1 else np.zeros(0, bool)
    return np.unique(np.concatenate([f.off[:-1], np.flatnonzero(cp == 10) + 1, np.flatnonzero(stop) + 1]))


def blocks_of(f: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, block_no, start, end) of the longest runs of non-blank lines."""
    row, _, start, end = cut_lines(f)
    solid = np.flatnonzero(f.cls != SPACE)
    full = np.searchsorted(solid, end) > np.searchsorted(solid, start)
    begins = full.copy()
    begins[1:] &= ~full[:-1] | (row[1:] != row[:-1])
    ends = full.copy()
    ends[:-1] &= ~full[1:] | (row[1:] != row[:-1])
    row, start, end = row[begins], start[begins], end[ends]
    no = np.arange(len(row)) - np.searchsorted(row, row)
    return row, no, start, end


def _segments(has, block, lang, s_lang, s_score, s_words) -> dict[str, np.ndarray]:
    """Stretches of sentences of one language in a block; sentences without a letter belong to what is before."""
    at = np.flatnonzero(has & (block >= 0) & (lang[np.maximum(block, 0)] >= 0)) if len(lang) else np.zeros(0, np.int64)
    cut = np.append(True, (block[at][1:] != block[at][:-1]) | (s_lang[at][1:] != s_lang[at][:-1]))[: len(at)]
    seg, n, first = np.cumsum(cut) - 1, int(cut.sum()), at[cut]
    post = softmax(np.stack([np.bincount(seg, s_score[at, j], n) for j in range(s_score.shape[1])], 1))
    return {"block": block[first], "no": np.arange(n) - np.searchsorted(block[first], block[first]), "words": np.bincount(seg, s_words[at], n).astype(np.int64), "lang": s_lang[first], "conf": post[np.arange(n), s_lang[first]]}


def label_flat(model: Model, f: Flat, by_segment: bool = False) -> dict[str, np.ndarray]:
    """Blocks with their language (-1: rejected), confidence and number of words; ``doc`` and ``doc_conf`` by row; ``segments`` if they're
    asked for."""
    rows = len(f.off) - 1
    L = len(model.langs)
    row, no, start, end = blocks_of(f)
    nb = len(row)
    words = f.runs((f.cls == LETTER) | (f.cls == NUMBER))[0]
    words = np.searchsorted(words, end) - np.searchsorted(words, start)
    ws, we = f.runs(f.cls == LETTER)
    sent = sentences(f)
    s_of = np.repeat(np.arange(len(sent)), np.diff(np.append(np.searchsorted(ws, sent), len(ws))))
    ll, n = model.score(f, ws, we, s_of, len(sent))
    s_words = np.bincount(s_of, minlength=len(sent))
    # A sentence lies in one block, as blocks end at lines.
    block = np.searchsorted(start, np.maximum(sent, 0), "right") - 1
    has = n > 0
    if nb:  # a sentence that begins with a line break's blanks belongs to the block of its first word
        firstword = np.full(len(sent), -1, np.int64)
        firstword[s_of[::-1]] = ws[::-1]
        block = np.where(has, np.searchsorted(start, firstword, "right") - 1, -1)
    sum_by = lambda owner, m, v, k: np.stack([np.bincount(owner[m], v[m, j], k) for j in range(L)], 1) if k else np.zeros((0, L))
    b_ll, b_n = sum_by(block, has, ll, nb), np.bincount(block[has], n[has], nb) if nb else np.zeros(0)
    d_ll = np.stack([np.bincount(row, b_ll[:, j], rows) for j in range(L)], 1)
    d_words = np.bincount(row, b_n, rows)
    doc_post = softmax(d_ll * model.temper)
    prior = np.log(0.9 * doc_post + 0.1 / L)
    b_score = b_ll * model.temper + prior[row]
    s_score = ll * model.temper
    if nb:
        ok = block >= 0
        s_score = s_score.copy()
        s_score[ok] += np.log(0.9 * softmax(b_score) + 0.1 / L)[block[ok]]
    s_lang = s_score.argmax(1)
    votes = np.zeros((nb, L))
    if nb:
        np.add.at(votes, (block[has], s_lang[has]), s_words[has])
    post = softmax(b_score)
    lang = np.where(votes.sum(1) > 0, (votes + 1e-6 * post).argmax(1), -1) if nb else np.zeros(0, np.int64)
    conf = np.where(lang >= 0, post[np.arange(nb), np.maximum(lang, 0)], 0.0)
    entropy = -b_ll[np.arange(nb), np.maximum(lang, 0)] / np.maximum(b_n, 1)
    lang = np.where((b_n > 0) & (entropy <= model.limit), lang, -1)
    ok = lang >= 0
    by_doc = np.zeros((rows, L))
    np.add.at(by_doc, (row[ok], lang[ok]), words[ok])
    doc = np.where(by_doc.sum(1) > 0, by_doc.argmax(1), -1)
    doc_conf = np.where(doc >= 0, doc_post[np.arange(rows), np.maximum(doc, 0)], 0.0)
    segments = _segments(has, block, lang, s_lang, s_score, s_words) if by_segment else None
    return {"segments": segments, "row": row, "no": no, "words": words, "lang": lang, "conf": np.where(ok, conf, 0.0), "doc": doc, "doc_conf": doc_conf, "chars": d_words}


def train(samples: DataFrame) -> Model:
    """A model of (lang, text) rows; rows of null or empty text or language are left out. The rows come to the driver: their
    size is checked first."""
    s = samples.where("lang is not null and text is not null").select("lang", "text")
    if (s.agg(F.sum(F.length("text"))).first()[0] or 0) > MOST_SAMPLE_CHARS:
        raise ValueError(f"more than {MOST_SAMPLE_CHARS} characters of samples")
    return Model(sorted((r[0], r[1]) for r in s.collect()))


def _label(docs: DataFrame, model: Model, by: str) -> DataFrame:
    key = docs.schema["doc_id"].dataType
    out = StructType([StructField("doc_id", key)])
    for c in {"document": (), "block": ("block_no", "words"), "segment": ("block_no", "segment_no", "words")}[by]:
        out = out.add(c, LongType())
    out = out.add("lang", StringType()).add("confidence", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: see MOST_SAMPLE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, None], object)
        for b in batches:
            for lo, to, f in flatten(b.column("text"), nfc=True, lower=True):
                x = label_flat(m, f, by == "segment")
                ids = b.column("doc_id").slice(lo, to - lo)
                if by == "segment":
                    g = x["segments"]
                    cols = [ids.take(pa.array(x["row"][g["block"]])), *(pa.array(v, pa.int64()) for v in (x["no"][g["block"]], g["no"], g["words"])), pa.array(names[g["lang"]], pa.string()), pa.array(g["conf"])]
                elif by == "block":
                    cols = [ids.take(pa.array(x["row"])), pa.array(x["no"], pa.int64()), pa.array(x["words"], pa.int64()), pa.array(names[x["lang"]], pa.string()), pa.array(x["conf"])]
                else:
                    cols = [ids, pa.array(names[x["doc"]], pa.string()), pa.array(x["doc_conf"])]
                yield pa.RecordBatch.from_arrays(cols, out.names)

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, out)


def block_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, block_no, words, lang, confidence) of every block."""
    return _label(docs, model, "block")


def segment_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, block_no, segment_no, words, lang, confidence): stretches of sentences of one language in each block that isn't
    rejected; words are those of letters. A block of two languages has two segments or more."""
    return _label(docs, model, "segment")


def document_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, confidence): the language of most words of each text."""
    return _label(docs, model, "document")


def wrong_labels(docs: DataFrame, model: Model, kinds: DataFrame, least_words: int = 12) -> DataFrame:
    """(doc_id, block_no, lang, confidence): blocks of prose texts in another language than the row's label states. ``docs``
    has lang; ``kinds`` (doc_id, kind). Only blocks that differ are joined, by doc_id."""
    b = block_languages(docs.select("doc_id", "text"), model)
    b = b.where((F.col("words") >= least_words) & F.col("lang").isNotNull())
    said = docs.select(F.col("doc_id").alias("_d"), stated_language(F.col("lang"), model.langs).alias("_said"))
    other = kinds.where("kind <> 'prose'").select(F.col("doc_id").alias("_d"))
    b = b.join(said, F.col("doc_id") == F.col("_d")).where(F.col("_said").isNull() | (F.col("_said") != F.col("lang"))).drop("_d")
    return b.join(other, F.col("doc_id") == F.col("_d"), "left_anti").select("doc_id", "block_no", "lang", "confidence")
