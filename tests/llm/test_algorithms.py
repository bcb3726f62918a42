"""Terms, vectors and histories against brute force."""

import math
import random
import re
import unicodedata
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import distinctive, history, neighbours, termstats


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def terms(spark):
    corpus = spark.createDataFrame([(0, "aa bb"), (0, "aa bb"), (1, "aa"), (2, None), (3, "  "), (4, "aa cc"), (None, "x")], "doc_idx long, processed_text string")
    rows = [("aa", 0, 2), ("aa", 0, 2), (" AA", 0, 2), ("bb", 0, 1), ("aa", 1, 1), ("aa", 4, 1), ("cé", 4, 3), ("cé", 4, 3), ("aa", 9, 5), (None, 0, 1), ("zz", None, 1), ("zz", 0, None), (" ", 0, 1), ("aa", 2, 7)]
    return spark.createDataFrame([(*r, "x") for r in rows], "term string, doc_idx long, tf long, records string"), corpus


def test_frequencies_and_marks(spark, terms):
    postings, corpus = terms
    vocabulary = spark.createDataFrame([("aa", None), ("bb", None), ("cé", None), ("gone", None), (None, None)], "term string, added_at string")
    got = termstats.marked_vocabulary(vocabulary, postings, corpus, least_records=2)
    assert pairs(got, "term", "occurrences", "records", "mark") == [("aa", 4, 3, "common"), ("bb", 1, 1, "rare"), ("cé", 3, 1, "rare"), ("gone", 0, 0, "rare")]
    assert pairs(termstats.marked_vocabulary(vocabulary, postings.limit(0), corpus.limit(0)), "records", "mark")[0] == (0, "rare")
    assert termstats.term_frequencies(postings, corpus.limit(0)).count() == 0


def test_top_terms(spark, terms):
    s = distinctive.term_scores(*terms)
    w = {(r["doc_idx"], r["term"]): r["weight"] for r in s.collect()}
    assert w[0, "bb"] == pytest.approx(math.log(4 / 2) + 1, abs=1e-6) and w[0, "aa"] == 2.0 and set(w) == {(0, "aa"), (0, "bb"), (1, "aa"), (4, "aa"), (4, "cé")}
    assert pairs(distinctive.top_terms(s), "doc_idx", "term") == [(0, "aa"), (1, "aa"), (4, "cé")]
    assert distinctive.term_scores(terms[0].limit(0), terms[1].limit(0)).count() == 0


def test_ties_go_to_the_first_term(spark):
    corpus = spark.createDataFrame([(0, "b a"), (1, "a b")], "doc_idx long, processed_text string")
    postings = spark.createDataFrame([("b", 0, 1), ("a", 0, 1), ("a", 1, 1), ("b", 1, 1)], "term string, doc_idx long, tf long")
    assert pairs(distinctive.top_terms(distinctive.term_scores(postings, corpus)), "doc_idx", "term") == [(0, "a"), (1, "a")]


def test_em_finds_the_components():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.poisson(0.3, 9000), rng.poisson(6, 1000)])
    tf, n = np.unique(x, return_counts=True)
    share, high, low = distinctive.fit_two_poisson(np.zeros(len(tf), int), tf.astype(float), n.astype(float), 1, 200)
    assert share[0] == pytest.approx(0.1, abs=0.01) and high[0] == pytest.approx(6, abs=0.3) and low[0] == pytest.approx(0.3, abs=0.03)
    p = distinctive.elite(np.array([0.0, 1, 5, 1e6]), share[0], high[0], low[0])
    assert (np.diff(p) >= 0).all() and p[0] < 0.01 and p[2] > 0.99 and np.isfinite(p).all()


def test_em_has_converged_on_the_tables(spark):
    """p2_scores' mixtures against plain rounds, term by term: none has a lower likelihood, and the posteriors are those of the mixtures."""
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    postings, corpus = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("postings", "indexed_corpus"))
    n = termstats.live_records(corpus).count()
    got = {}
    for r in distinctive.term_scores(postings, corpus).groupBy("term", "tf", "elite").count().collect():
        got.setdefault(r["term"], []).append((r["tf"], r["count"], r["elite"]))
    assert len(got) > 100

    def likelihood(w, hi, lo):
        return (m * np.log(w * np.exp(-hi) * hi**tf + (1 - w) * np.exp(-lo) * lo**tf)).sum()

    for entries in got.values():
        tf = np.array([0, *(e[0] for e in entries)], float)
        m = np.array([n - sum(e[1] for e in entries), *(e[1] for e in entries)], float)
        share, high, low = (x[0] for x in distinctive.fit_two_poisson(np.zeros(len(tf), int), tf, m, 1))
        w, hi, lo = (x[0] for x in distinctive._start(np.zeros(len(tf), int), tf, m, 1))
        for _ in range(1000):
            p = 1 / (1 + (1 - w) / w * (lo / hi) ** tf * np.exp(hi - lo))
            w, hi, lo = np.clip((p * m).sum() / m.sum(), 1e-9, 1 - 1e-9), max((p * m * tf).sum() / (p * m).sum(), 1e-6), max(((1 - p) * m * tf).sum() / ((1 - p) * m).sum(), 1e-9)
        assert likelihood(share, high, low) >= likelihood(w, hi, lo) - 1e-6
        assert np.allclose(distinctive.elite(tf[1:], share, high, low), [e[2] for e in entries], atol=1e-6)


def test_hot_term_counts(spark, monkeypatch, terms):
    from textloom.plans import runtime

    want = pairs(distinctive.term_scores(*terms), "doc_idx", "term", "weight", "elite")
    monkeypatch.setattr(runtime, "SMALL_ROWS", 1)
    monkeypatch.setattr(runtime, "HOT_KEYS", 2)
    assert pairs(distinctive.term_scores(*terms), "doc_idx", "term", "weight", "elite") == want


def make_vectors(seed=1, n=900, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n - 4, 9):  # groups of like vectors of any length
        for j in range(1, 4):
            x[i + j] = (x[i] / np.linalg.norm(x[i]) + rng.normal(size=dim) * 0.02) * rng.uniform(0.01, 50)
    return x


def test_neighbours_against_brute_force(spark):
    x = make_vectors()
    rows = [(f"d{i:04d}", v.tolist(), "u") for i, v in enumerate(x)] + [("d0005", x[5].tolist(), "u"), ("n", None, "u"), ("e", [], "u"), ("z", [0.0] * 64, "u"), ("s", [1.0] * 3, "u"), ("nan", [float("nan")] * 64, "u")]
    d = spark.createDataFrame(rows, "doc_id string, embedding array<double>, key string")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    top = np.argsort(-cos, axis=1)[:, :5]
    want = {tuple(sorted((f"d{a:04d}", f"d{b:04d}"))) for a in range(len(x)) for b in top[a] if cos[a, b] >= 0.9}
    assert set(pairs(neighbours.alike_pairs(d), "doc_a", "doc_b")) == want and want
    got = set(pairs(neighbours.most_alike(d), "doc_id", "other"))
    full = {(f"d{a:04d}", f"d{b:04d}") for a in range(len(x)) for b in top[a]}
    assert len(got & full) / len(full) >= 0.9
    assert neighbours.alike_pairs(d.limit(0)).count() == 0


def test_a_third_of_all_vectors_are_copies(spark):
    x = make_vectors(2, 200)
    rows = [(f"d{i:03d}", (v * (i + 1)).tolist()) for i, v in enumerate(x)] + [(f"c{i:03d}", (x[0] * (i + 1)).tolist()) for i in range(100)]
    got = neighbours.most_alike(spark.createDataFrame(rows, "doc_id string, embedding array<double>"), 5, 0.9)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r["other"])
    assert sorted(by["c050"]) == [f"c{i:03d}" for i in range(5)] and sorted(by["c000"]) == [f"c{i:03d}" for i in range(1, 6)] and all(len(v) <= 5 for v in by.values())


@pytest.mark.parametrize("url, page", [
    ("https://www.X.org:443/a/?utm_source=m&id=1#top", "x.org/a?id=1"), ("http://x.org:80/a?id=1&gclid=2", "x.org/a?id=1"), ("http://x.org:443/a", "x.org:443/a"),
    ("https://x.org/A", "x.org/A"), ("https://x.org", "x.org"), ("https://x.org/", "x.org"), ("", None), (None, None), ("  ", None), ("x.org/a", "x.org/a"), ("https://x.org:bad/", "https://x.org:bad/"),
])
def test_pages(spark, url, page):
    assert page_of(url) == page
    assert spark.createDataFrame([(url,)], "u string").select(history.page_of(F.col("u"))).first()[0] == page


def page_of(url):
    """Row by row, as the library's parser cuts urls."""
    if url is None or not url.strip():
        return None
    url = url.strip()
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url
    ports = {"http": 80, "https": 443}
    if u.scheme.lower() not in ports:
        return url
    port = "" if port is None or port == ports[u.scheme.lower()] else f":{port}"
    query = "&".join(p for p in u.query.split("&") if p and not re.match(r"^(utm_.*|fbclid|gclid)$", p.split("=", 1)[0]))
    user = u.netloc.rpartition("@")[0]
    return f"{user + '@' if user else ''}{host.removeprefix('www.')}{port}{u.path.removesuffix('/')}" + (f"?{query}" if query else "")


def test_pages_of_many_urls(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    urls = []
    for _ in range(3000):
        query = "&".join(pick("a=1", "utm_source=x", "utm", "b", "", "gclid=3", "gclidx=3", "fbclid", "c=?/", "=", "q=ñ") for _ in range(rng.randrange(4)))
        urls.append(pick("http", "https", "HTTPS", "ftp", "") + pick("://", "://", "://", "//") + pick("", "", "u@", "u:p@", "a@b@") + pick("www.", "WWW.", "") + pick("x.org", "X.Org", "é.org", "") + pick("", "", ":80", ":443", ":0443", ":8080", ":", ":99999", ":ab")
                    + pick("", "/", "/a/b/", "/a//", "/a;x=1", "/A%20b") + pick("", "?" + query, "?" + query, "?") + pick("", "#f", "#f?x=/", "#"))
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", history.page_of(F.col("u")).alias("p")).collect()
    assert [(urls[r["i"]], r["p"]) for r in got if r["p"] != page_of(urls[r["i"]])] == []


def runs(text):
    import regex

    w = regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFC", text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def brute(accepted, incoming):
    out, held = set(), list(accepted)
    for b in sorted(incoming, key=lambda r: (r[4], r[0])):
        found = set()
        for a in held:
            x, y = runs(a[2]), runs(b[2])
            like = x and y and len(x & y) >= 0.7 * len(x | y)
            same = a[1] and a[1] == b[1] or page_of(a[3]) and page_of(a[3]) == page_of(b[3])
            if like or same:
                found.add((a[0], b[0]))
        out |= found
        if not found:
            held.append(b)
    return sorted(out)


def test_repeats_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))

    def changed(t, share):
        w = t.split()
        for i in rng.choice(len(w), int(len(w) * share), replace=False):
            w[i] = "new"
        return "  ".join(w).upper()

    base = [text(int(rng.integers(5, 120))) for _ in range(60)]
    accepted = [(i, f"a{i}", t, f"https://www.x.org/{i}/") for i, t in enumerate(base)] + [(900, None, None, None), (901, "", " ", "")]
    incoming = []
    for k in range(160):
        t = base[rng.integers(60)] if rng.random() < 0.6 else incoming[rng.integers(len(incoming))][2] if incoming and rng.random() < 0.5 else text(60)
        t = changed(t, rng.choice([0, 0.03, 0.06, 0.1, 0.2])) if t else t
        doc = f"a{rng.integers(90)}" if rng.random() < 0.2 else [None, "", f"n{k}"][rng.integers(3)]
        url = f"http://X.org/{rng.integers(200)}?utm_x=1" if rng.random() < 0.3 else [None, "", f"https://y.org/{k}"][rng.integers(3)]
        incoming.append((1000 + k, doc, t if rng.random() > 0.05 else None, url, int(rng.integers(1, 4))))
    hot = "the very same text in a third of all of the rows of this batch"
    incoming += [(2000 + k, None, hot, None, 2) for k in range(80)]
    a = spark.createDataFrame([(*r, "x") for r in accepted], "item_id long, doc_id string, text string, url string, key string")
    b = spark.createDataFrame([(*r, "x") for r in incoming], "item_id long, doc_id string, text string, url string, batch_no int, key string")
    assert pairs(history.repeats(a, b), "item_a", "item_b") == brute(accepted, incoming)
    assert pairs(history.repeats_by_batch(a, b, str(tmp_path / "history")), "item_a", "item_b") == brute(accepted, incoming)
    table = history.history_table(a)
    assert pairs(history.repeats(a, b, table=table), "item_a", "item_b") == brute(accepted, incoming)
    assert history.repeats(a.limit(0), b.limit(0)).count() == 0
    assert history.new_items(a, b).count() == len(incoming) - len({y for _, y in brute(accepted, incoming)})


def test_chains_and_hot_groups(spark, monkeypatch):
    """Items each like the next only, and groups that hold most of a batch, also beyond what may be broadcast."""
    from textloom.plans import runtime

    monkeypatch.setattr(runtime, "SMALL_ROWS", 3)
    monkeypatch.setattr(runtime, "HOT_KEYS", 4)
    monkeypatch.setattr(history, "MOST_KEYS", 3)
    monkeypatch.setattr(history, "HOT_GROUP", 3)
    words = [f"w{i}" for i in range(200)]
    chain = [(100 + i, f"c{i}", " ".join(words[i * 6 : i * 6 + 60]), None, 1) for i in range(12)]
    hot = [(300 + i, "same id", f"text {i} of its own kind {i}", None, 2) for i in range(40)] + [(400 + i, None, None, f"http://x.org/p?utm_a={i}", 1) for i in range(40)]
    copies = [(500 + i, None, " ".join(words[: 60 - i % 3]), None, 3) for i in range(60)]
    accepted = [(1, "a", "nothing like the others here", None), (2, None, None, "https://www.x.org/p/"), (3, "c11", "", "")]
    incoming = chain + hot + copies
    a = spark.createDataFrame(accepted, "item_id long, doc_id string, text string, url string")
    b = spark.createDataFrame(incoming, "item_id long, doc_id string, text string, url string, batch_no int")
    assert pairs(history.repeats(a, b), "item_a", "item_b") == brute(accepted, incoming)


def test_history_is_appended_to(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"))
    rows = lambda *r: spark.createDataFrame(r, "item_id long, doc_id string, text string, url string")
    h.append(rows((1, "a", "one two three four", None)), "0")
    assert pairs(h.take(rows((2, "a", None, None), (3, "b", "five six seven", "http://x.org"), (4, "b", "z", None)), "1"), "item_a", "item_b") == [(1, 2), (3, 4)]
    assert sorted(r[0] for r in h.items().select("item_id").collect()) == [1, 3]
    assert pairs(h.take(rows((5, None, "FIVE six: seven!", None), (6, None, "x", "https://www.x.org/#a")), "2"), "item_a", "item_b") == [(3, 5), (3, 6)]
    assert h.items().count() == 2 and h.repeats(rows((7, None, None, None)).limit(0)).count() == 0


def test_pivot_counts_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (rng.integers(0, 400, 150).astype(np.uint64) for _ in range(2))
        x, y = (np.unique(v) * np.uint64(0x9E3779B97F4A7C15) for v in (x, y))
        p = [history._signatures(np.zeros(len(v), np.int64), v, 1)[1][0] for v in (x, y)]
        assert np.abs(p[0] - p[1]).sum() <= len(np.setxor1d(x, y))


def exact_neighbours(docs, x, k=5, least=-1.0):
    """{doc_id: its k others} by all cosines; each doc_id by its best embedding."""
    names, at = np.unique(docs, return_inverse=True)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(names)))
    cos = np.maximum.reduceat((unit @ unit.T)[order][:, order], starts, axis=1)
    cos = np.maximum.reduceat(cos, starts, axis=0)
    np.fill_diagonal(cos, -2)
    top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
    return {names[i]: {names[j] for j in top[i] if cos[i, j] >= max(least, -1)} for i in range(len(names))}


def found_neighbours(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["doc_id"], set()).add(r["other"])
    return by


@pytest.mark.parametrize("least", [-1.0, 0.9])
def test_all_neighbours_among_a_third_of_near_copies(spark, monkeypatch, least):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x[:1000] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(1000, 64)) * 0.02
    docs = np.array([f"d{i:04d}" for i in rng.permutation(3000)])
    monkeypatch.setattr(neighbours, "PACK", 700)
    monkeypatch.setattr(neighbours, "LEAST_PACK", 300)
    d = spark.createDataFrame([(a, v.tolist()) for a, v in zip(docs, x)], "doc_id string, embedding array<double>")
    want = {a: v for a, v in exact_neighbours(docs, x, 5, least).items() if v}
    assert found_neighbours(neighbours.most_alike(d, 5, least, exact=True)) == want
    got = found_neighbours(neighbours.most_alike(d, 5, least, probes=32))  # noise has no cells to speak of
    crowd = set(docs[:1000].tolist())
    share = lambda some: sum(len(v & got.get(a, set())) for a, v in want.items() if (a in crowd) == some) / max(1, sum(len(v) for a, v in want.items() if (a in crowd) == some))
    assert share(True) >= 0.98 and (least > 0 or share(False) >= 0.9)


def test_doc_ids_of_many_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x[:40] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(40, 64)) * 0.01
    docs = np.array([0] * 9 + [1] * 9 + list(range(2, 384)))  # two doc_ids of nine like embeddings each
    d = spark.createDataFrame([(int(a), v.tolist()) for a, v in zip(docs, x)], "doc_id long, embedding array<double>")
    got = found_neighbours(neighbours.most_alike(d, exact=True))
    assert got == exact_neighbours(docs, x) and all(len(v) == 5 for v in got.values())
    got = found_neighbours(neighbours.most_alike(d, probes=100))
    assert all(len(v) == 5 for v in got.values()) and sum(len(v & got[a]) for a, v in exact_neighbours(docs, x).items()) >= 0.97 * 5 * len(got)
