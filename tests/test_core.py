"""Hand-made cases of the engine's own operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import web
from textloom.functions.ids import safe_key, uuid5_url
from textloom.operators import crawl, index, lsi, search, spell, tfidf
from textloom.operators.preprocess import EXTRA_SPANISH, TextProcessor, dictionary_lemmatizer, stop_words
from textloom.plans.engine import Engine, OverlapRetriever, TfidfRetriever
from textloom.plans.runtime import lookup


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t, f"u{i}", {"title": f"T{i}"}) for i, t in enumerate(texts)], "doc_id string, text string, url string, metadata map<string,string>")


@pytest.mark.parametrize("raw, expected", [
    ("HOLA Mundo", "hola mundo"), ("a   b", "a b"), ("¿Qué es?", "qué es"), ("niño_1 x²", "niño_1 x²"), ("", ""), ("…", ""), ("Café", "café"), (None, None),
])
def test_normalize(spark, raw, expected):
    assert one(spark, raw, tx.normalize_text) == expected


def test_normalize_without_accents(spark):
    assert one(spark, "Ñandú más", lambda c: tx.normalize_text(c, accents=False)) == "nandu mas"


def test_tokens_of_nothing(spark):
    assert one(spark, None, tx.tokens) == [] and one(spark, "  ", tx.tokens) == []


def test_processor_order(spark):
    p = TextProcessor(stopwords=["la"], lemmatizer=dictionary_lemmatizer({"las": "la"}), least=2, most=5)
    assert one(spark, "La casa las x grandes", p.token_column) == ["casa", "la"]  # a lemma that is a stop word stays


def test_stop_words():
    s = stop_words("spanish", custom=["foo"])
    assert "foo" in s and "etcétera" in s and "de" in s and len(EXTRA_SPANISH) == len(set(EXTRA_SPANISH))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_build_counts_terms(spark):
    i = index.build(docs(spark, "alpha alpha alpha beta", "beta gamma"))
    assert rows(i.postings, "term", "doc_idx", "tf") == [("alpha", 0, 3), ("beta", 0, 1), ("beta", 1, 1), ("gamma", 1, 1)]
    assert rows(i.vocabulary, "term_idx", "term", "df", "cf") == [(0, "alpha", 1, 3), (1, "beta", 2, 2), (2, "gamma", 1, 1)]
    assert [p["doc_idx"] for p in i.inverted().where("term = 'beta'").first()["postings"]] == [0, 1]


def test_build_drops_short_and_rare(spark):
    i = index.build(docs(spark, "aa bb", "aa bb cc dd"), min_doc_length=3, min_term_frequency=1)
    assert rows(i.corpus, "doc_idx", "doc_id") == [(0, "d1")]
    i = index.build(docs(spark, "aa aa bb", "aa cc"), min_term_frequency=2)
    assert rows(i.vocabulary, "term") == [("aa",)]


def test_numbers_are_dense_either_way(spark, monkeypatch):
    texts = [f"w{i % 7} x{i}" for i in range(60)]
    want = index.build(docs(spark, *texts, *texts))  # ids that come twice
    monkeypatch.setattr(index, "SMALL_RANK", 3)
    monkeypatch.setattr(index, "SMALL_IDS", 3)
    got = index.build(docs(spark, *texts, *texts))
    assert rows(got.vocabulary, "term", "term_idx", "df", "cf") == rows(want.vocabulary, "term", "term_idx", "df", "cf")
    assert rows(got.corpus, "doc_idx", "doc_id") == rows(want.corpus, "doc_idx", "doc_id") and rows(got.postings, "term", "doc_idx", "tf") == rows(want.postings, "term", "doc_idx", "tf")
    less = index.remove(got, spark.createDataFrame([(f"d{i}",) for i in range(0, 120, 2)], "doc_id string"))
    assert [r[0] for r in rows(less.corpus, "doc_idx")] == list(range(60)) and less.vocabulary.agg(F.sum("cf")).first()[0] == 120
    more = index.update(less, docs(spark, *texts))
    assert [r[0] for r in rows(more.corpus, "doc_idx")] == list(range(more.corpus.count())) and index.stats(more).first()["n_terms"] == more.postings.select("term").distinct().count()


def test_empty_index(spark):
    i = index.build(docs(spark, "x").limit(0))
    assert tuple(index.stats(i).first()) == (0, 0, 0, 0.0, 0.0)


def test_stats(spark):
    assert tuple(index.stats(index.build(docs(spark, "aa bb cc", "aa bb dd"))).first()) == (2, 4, 6, 3.0, 1.5)


def test_update_skips_known_ids(spark):
    i = index.build(docs(spark, "aa bb"))
    u = index.update(i, spark.createDataFrame([("d0", "other text"), ("d9", "bb cc"), ("d9", "zz"), ("d8", "")], "doc_id string, text string"))
    assert rows(u.corpus, "doc_idx", "doc_id") == [(0, "d0"), (1, "d9")]
    assert rows(u.postings, "term", "doc_idx")[:2] == [("aa", 0), ("bb", 0)]
    assert i.corpus.count() == 1  # what was there doesn't change


def test_remove_renumbers(spark):
    i = index.remove(index.build(docs(spark, "aa", "bb", "cc aa")), spark.createDataFrame([("d1",), ("nope",)], "doc_id string"))
    assert rows(i.corpus, "doc_idx", "doc_id") == [(0, "d0"), (1, "d2")]
    assert rows(i.vocabulary, "term_idx", "term") == [(0, "aa"), (1, "cc")]


def test_idf_values(spark):
    m = tfidf.fit(index.build(docs(spark, "aa bb", "aa")))
    got = {r["term"]: r["idf"] for r in m.vocabulary.collect()}
    assert got["aa"] == pytest.approx(1.0) and got["bb"] == pytest.approx(math.log(3 / 2) + 1)


def test_lookup_with_hot_keys(spark, monkeypatch):
    from textloom.plans import runtime

    left = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("w")).where("k < 900")
    want = sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    monkeypatch.setattr(runtime, "SMALL_ROWS", 10)
    monkeypatch.setattr(runtime, "HOT_KEYS", 100)
    assert sorted(map(tuple, lookup(left, right, ["k"], "w").collect()), key=str) == want
    more = left.withColumn("m", F.create_map(F.lit("a"), F.col("id"))).withColumn("s", F.array("k"))
    got = lookup(more, right, ["k"], "w", "inner").collect()
    assert sorted(r["id"] for r in got) == sorted(r[1] for r in want if r[2] is not None) and all(r["m"]["a"] == r["id"] for r in got)
    big = lookup(left, right, ["k"], "w").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert big < 700  # the hot key's rows are in several tasks
    monkeypatch.setattr(runtime, "HOT_KEYS", 1)
    assert sorted(map(tuple, lookup(left, right, ["k"], "w").collect()), key=str) == want


def test_lsi_reproduces_documents(spark):
    texts = ["aa bb cc", "aa aa dd", "bb ee ff", "cc dd ff gg", "aa gg"]
    i = index.build(docs(spark, *texts))
    w = tfidf.weights(i.postings, tfidf.fit(i))
    m = lsi.fit(w, 5, i.vocabulary.count(), 4)
    dense = np.zeros((5, i.vocabulary.count()))
    for r in w.collect():
        dense[r["doc_idx"], r["term_idx"]] = r["weight"]
    assert np.allclose(m.singular, np.linalg.svd(dense)[1][:4], rtol=1e-6)
    got = {r["doc_idx"]: r["vec"] for r in lsi.project(w, m).collect()}
    assert np.allclose([np.linalg.norm(got[k]) for k in range(5)], np.linalg.norm(dense @ m.components, axis=1))


def test_lsi_far_below_full_rank(spark, monkeypatch):
    """Singular values and the space against NumPy, also with the terms' vectors sent a column at a time."""
    rng = np.random.default_rng(5)
    x = rng.poisson(0.06, (300, 500)) * rng.gamma(2.0, 1.0, 500)[None, :]
    x[:, :8] += rng.random((300, 8)) * np.arange(8, 0, -1)
    w = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "doc_idx long, term_idx long, weight double")
    _, s, v = np.linalg.svd(x, full_matrices=False)
    for limit, lots in ((lsi.LIMIT, 32), (4 * 500 * 7, 2)):
        monkeypatch.setattr(lsi, "LIMIT", limit)
        monkeypatch.setattr(lsi, "LOTS", lots)
        m = lsi.fit(w, 300, 500, 30)
        assert np.abs(m.singular / s[:30] - 1).max() < 1e-3
        assert np.allclose(m.components.T @ m.components, np.eye(30), atol=1e-5)
        assert np.linalg.norm(x @ m.components) > (1 - 1e-4) * np.linalg.norm(s[:30])
        assert np.abs(np.abs(m.components[:, :8].T @ v[:8].T) - np.eye(8)).max() < 1e-2
        row = {r["doc_idx"]: r["vec"] for r in lsi.project(w.where("doc_idx < 2"), m).collect()}
        assert np.allclose(row[0], x[0] @ m.components, rtol=1e-5, atol=1e-6)
    monkeypatch.setattr(lsi, "MOST", 1000)
    with pytest.raises(ValueError, match="don't fit"):
        lsi.fit(w, 300, 500, 30)


def test_lsi_rank_is_bounded():
    assert lsi.effective_k(10, 2, 3) == 1 and lsi.effective_k(2, 10, 10) == 2
    with pytest.raises(ValueError):
        lsi.effective_k(10, 1, 3)


def test_vector_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0]), ("n", None)], "doc_id string, vec array<double>")
    q = spark.createDataFrame([("q", [2.0, 0.0, 0.0])], "query_id string, vec array<double>")
    got = search.vector_top_k(q, v, 2).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in got] == [("a", 1.0), ("b", 0.0)]
    assert search.vector_top_k(q, v.limit(0), 2).count() == 0 and search.vector_top_k(q.limit(0), v, 2).count() == 0


def test_threshold_comes_after_top_k(spark):
    s = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.1), ("q", "c", 0.8)], "query_id string, doc_id string, score double")
    assert rows(search.ranked(s, 2, 0.85), "doc_id") == [("a",)]


def test_spelling(spark):
    words = spark.createDataFrame([("hipertensión", 0), ("hospital", 1), ("ab", 2), ("casa", 3), ("cara", 4)], "word string, pos int")
    got = {r["token"]: r["correction"] for r in spell.corrections(spark.createDataFrame([("hipertensoin",), ("hospital",), ("zzzzzzz",), ("a",), ("caxa",)], "token string"), words).collect()}
    assert got == {"hipertensoin": "hipertensión", "hospital": "hospital", "a": "ab", "caxa": "cara"}
    tie = spell.corrections(spark.createDataFrame([("caxa",)], "token string"), words, tie_break="insertion").first()
    assert tie["correction"] == "casa"  # seen first


def test_spelling_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(120)})
    tokens = sorted({"".join(rng.choice(list("abcd"), rng.integers(1, 7))) for _ in range(60)})
    v, t = (spark.createDataFrame([(w,) for w in x], f"{n} string") for x, n in ((words, "word"), (tokens, "token")))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = sorted((a, b, distance(a, b)) for a in tokens for b in words if distance(a, b) <= 2)
    assert rows(spell.candidates(t, v), "token", "word", "distance") == want


def test_overlap(spark):
    r = OverlapRetriever(docs(spark, "Fever and cough", "nothing here", None))
    q = spark.createDataFrame([("q", "Fever, cough!"), ("e", "")], "query_id string, text string")
    assert [(x["doc_id"], x["score"]) for x in r.retrieve(q).collect()] == [("d0", 1.0)]


def test_engine(spark):
    e = Engine(spark, TextProcessor()).build(docs(spark, "dolor de espalda fuerte", "fiebre alta nocturna", "dolor de cabeza", "tos seca y fiebre"))
    with pytest.raises(RuntimeError):
        e.search(spark.createDataFrame([("q", "x")], "query_id string, text string"))
    e.fit(k=3)
    got = e.search(spark.createDataFrame([("q", "fiebr nocturna"), ("none", "zzzzzzzz")], "query_id string, text string"), 2, 0.1).collect()
    assert got[0]["doc_id"] == "d1" and all(0 <= r["score"] <= 1 for r in got) and {r["query_id"] for r in got} == {"q"}
    assert e.stats().first()["n_documents"] == 4


def test_engine_is_opened_again_and_answers_from_memory(spark, tmp_path, monkeypatch):
    from textloom.plans import serve

    texts = ["dolor de espalda fuerte", "fiebre alta nocturna", "dolor de cabeza", "tos seca y fiebre", "la espalda y la cabeza", "fiebre alta nocturna"]
    e = Engine(spark, TextProcessor(), path=str(tmp_path / "store"))
    assert not Engine.exists(spark, e.path)
    e.build(docs(spark, *texts)).fit(k=3)
    again = Engine.open(spark, e.path, TextProcessor())
    assert Engine.exists(spark, e.path) and again.stats().first() == e.stats().first()
    session, other = serve.Session(e), serve.Session(again)
    monkeypatch.setattr(serve, "MOST_TEXT", 0)
    slim = serve.Session(again)
    for q in ("fiebr nocturna", "zzzzzzzz", "", "dolro ESPALDA", "cabeza, tos"):
        want = [(r["rank"], r["score"], r["doc_id"]) for r in e.search(spark.createDataFrame([("q", q)], "query_id string, text string"), 4, 0.1).collect()]
        for s in (session, other, slim):
            got = [(rank, score, d["doc_id"]) for rank, score, d in s.search(q, 4, 0.1)]
            assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want] and all(abs(x[1] - y[1]) < 1e-6 for x, y in zip(got, want))
    monkeypatch.setattr(serve, "MOST_BYTES", 8)
    with pytest.raises(serve.TooLarge):
        serve.Session(again)
    assert [d["text"] for _, _, d in session.search("fiebre nocturna", 1)] == [texts[1]]


def test_command_line(spark, tmp_path):
    from textloom.__main__ import main

    said = []
    store, data = str(tmp_path / "store"), tmp_path / "data"
    data.mkdir()
    (data / "x.txt").write_text("una rodilla hinchada y caliente")
    assert main(["--store", store, "--rank", "5", "--stats"], spark, write=said.append) == 0
    assert "n_documents              : 20" in said[-1] and "avg_tokens_per_doc       : " in said[-1] and "." in said[-1].split("avg_tokens_per_doc")[1].split("\n")[0]
    main(["--store", store, "-q", "dolro de espalda", "--top-k", "2", "--threshold", "0.1"], spark, write=said.append)
    assert "Results (2 found)" in said[-1] and "1. [" in said[-1] and "espalda" in said[-1]
    lines = iter(["", "help", "stats", "zzzzzzzzz", "fiebre", "quit"])
    assert main(["--store", store], spark, read=lambda _: next(lines), write=said.append) == 0
    assert "No results found for: 'zzzzzzzzz'" in said[-2]
    main(["--store", store, "--data", str(data), "--update", "--rank", "6", "-q", "rodilla", "--threshold", "0.0"], spark, write=said.append)
    assert "hinchada" in said[-1]


def test_tokens_of_a_text_in_python(spark):
    p = TextProcessor(stopwords=["la"])
    texts = ["La CASA, ñandú_1 x² ½ É", None, "", "…", "ΑΣ İstanbul l’été", "a" * 21 + " bb", "ﬁn Ⅷ 漢字 한글"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(p.token_column(F.col("t"))).collect()]
    assert [p.tokens_of(t) for t in texts] == got
    with pytest.raises(ValueError):
        TextProcessor(tokenizer=lambda c: F.split(c, "a")).tokens_of("x")
    assert one(spark, "xx-yyazz", TextProcessor(tokenizer=lambda c: F.split(c, "a")).token_column) == ["xx yy", "zz"]


def test_word_index_finds_what_the_join_finds(spark):
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(150)})
    tokens = sorted({"".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(80)})
    v, t = (spark.createDataFrame([(w,) for w in x], f"{n} string") for x, n in ((words, "word"), (tokens, "token")))
    want = {r["token"]: (r["correction"], r["distance"]) for r in spell.corrections(t, v).collect()}
    at_hand = spell.WordIndex(words)
    assert {x: got for x in tokens if (got := at_hand.nearest(x))} == want


def test_tfidf_retriever_ignores_unknown_terms(spark):
    r = TfidfRetriever(index.build(docs(spark, "aa bb", "bb cc")))
    q = spark.createDataFrame([("q", "aa zz"), ("e", "zz")], "query_id string, text string")
    assert [(x["query_id"], x["doc_id"]) for x in r.retrieve(q).collect()] == [("q", "d0")]


def test_ids(spark):
    import uuid

    u = "https://example.org/ñ?x=1"
    assert one(spark, u, uuid5_url) == str(uuid.uuid5(uuid.NAMESPACE_URL, u))
    assert one(spark, "ok-1.x", safe_key) == "ok-1.x" and len(one(spark, "../x", safe_key)) == 32 and len(one(spark, "a" * 500, safe_key)) == 32


def test_pages():
    html = '<html lang="es-MX"><meta property="article:modified_time" content=" 2024 "><div id="main-content"><h1> T </h1><p>' + "x" * 60 + "<p>second</div><p>out</p>"
    assert web.page_fields(html, "https://www.mayoclinic.org/symptoms/x", web.MAYO) == ("T", "x" * 60 + "\n\nsecond", "mayo_clinic", "es", "2024", "symptom")
    assert web.page_fields("<main><p>" + "x" * 60 + "</p></main>", "u", web.NHS) is None and web.page_fields(None, "u", web.NHS) is None


def test_registry(spark):
    r = web.Registry()
    with pytest.raises(TypeError):
        r.register("x")
    r.register(web.NHS)
    assert one(spark, "https://www.nhs.uk/conditions/x", r.for_url) == "nhs" and one(spark, "https://x.org/", r.for_url) is None


def test_crawl(spark):
    page = "<main><h1>A</h1><p>" + "word " * 20 + "</p></main>"
    base = "https://www.nhs.uk/conditions/"
    urls = spark.createDataFrame([("nhs", [i], f"{base}{x}/") for i, x in enumerate("abcc")], "source string, pos array<int>, loc string")
    pages = spark.createDataFrame([(f"{base}a/", page, None), (f"{base}b/", "<main/>", None), (f"{base}c/", None, "timeout")], "url string, html string, error string")
    got, report = crawl.Crawl([web.NHS]).run(urls, pages)
    r = report.first()
    assert (r["visited"], r["successful"], r["failed"], len(r["errors"])) == (3, 1, 2, 1) and r["success_rate"] == pytest.approx(1 / 3)
    assert got.first()["metadata"]["title"] == "A"
    assert crawl.Crawl([web.NHS]).run(urls, pages, max_pages=1)[1].first()["visited"] == 1
    with pytest.raises(ValueError):
        crawl.Crawl([])
    assert crawl.report(spark.createDataFrame([], "url string, status string, error string")).first()["success_rate"] == 0.0


def test_lsi_queries_use_all_terms_at_full_rank(spark, tmp_path, monkeypatch):
    from textloom.plans import queries

    docs = [(i, f"common words of text {'abcdefghij'[i % 10]}x{i}", f"u{i}") for i in range(120)] + [(500, "wqxyzz common words", "u500")]
    spark.createDataFrame(docs, "doc_id long, text string, url string").write.parquet(f"{tmp_path}/documents.parquet")
    ranks, fit = [], lsi.fit
    monkeypatch.setattr(lsi, "fit", lambda w, n_docs, n_terms, k=100: ranks.append((n_terms, k)) or fit(w, n_docs, n_terms, k))
    got = queries.lsi_topk(spark, str(tmp_path)).where("query_id = 'q5' and rank = 1").collect()  # its only word is in one document
    assert [(r["doc_id"]) for r in got] == [500] and got[0]["score"] > 0.5
    assert queries.lsi_self_projection(spark, str(tmp_path)).count() == 121
    n = queries.vocabulary(spark, str(tmp_path)).count()
    assert ranks == [(n, 100)] * 2


def test_spelling_queries_know_all_words(spark, tmp_path):
    from textloom.plans import queries

    words = ["hospitál", "hospicio", "pâcientes", "especialistas", "tratamiento", "laboratório", "laboratory2", "clínica"]
    spark.createDataFrame([(i, w, "u") for i, w in enumerate(words)], "doc_id long, text string, url string").write.parquet(f"{tmp_path}/documents.parquet")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    known = [r["term"] for r in queries.vocabulary(spark, str(tmp_path)).collect()]
    want = sorted((s, w, distance(s, w)) for s in queries.SLIPS for w in known if distance(s, w) <= 2)
    assert ("hospitl", "hospitál", 1) in want and sorted(tuple(r) for r in queries.spell_candidates(spark, str(tmp_path)).collect()) == want
    assert {r["given"]: r["token"] for r in queries.spell_correct(spark, str(tmp_path)).collect()}["pacintes"] == "pâcientes"
    assert ("hospitl", "hospitál", 1) in {tuple(r) for r in queries.spell_correct_insertion(spark, str(tmp_path)).collect()}


def test_crawl_from_sitemaps_to_store(spark, tmp_path):
    from textloom.sources.stores import RawStore

    page = "<main><h1>{}</h1><p>" + "word " * 20 + "</p></main>"
    base = "https://www.nhs.uk/conditions/"
    web_ = {
        "https://www.nhs.uk/sitemap.xml": "<sitemapindex><sitemap><loc>https://www.nhs.uk/s1.xml</loc></sitemap><sitemap><loc>https://www.nhs.uk/gone.xml</loc></sitemap></sitemapindex>",
        "https://www.nhs.uk/s1.xml": f"<urlset><url><loc>{base}a/</loc></url><url><loc>{base}a/</loc></url><url><loc>{base}b/</loc></url><url><loc>https://www.nhs.uk/live-well/c/</loc></url><url><loc>https://www.nhs.uk/no/</loc></url></urlset>",
        f"{base}a/": page.format("A"), "https://www.nhs.uk/live-well/c/": page.format("C"),
    }
    table = spark.createDataFrame(list(web_.items()), "url string, html string")
    get = lambda urls: urls.join(table, "url", "left").withColumn("error", F.when(F.col("html").isNull(), "404"))
    store = RawStore(spark, str(tmp_path / "raw"))
    roots = spark.createDataFrame([("nhs", "https://www.nhs.uk/sitemap.xml")], "source string, root string")
    robots = spark.createDataFrame([("www.nhs.uk", "User-agent: *\nDisallow: /live-well/")], "host string, txt string")
    got, report = crawl.Crawl([web.NHS]).crawl(roots, store=store, get=get)
    r = report.first()
    assert (r["visited"], r["successful"], r["failed"], r["n_errors"]) == (3, 2, 1, 1) and [tuple(e) for e in r["errors"]] == [(f"{base}b/", "404")]
    assert sorted(x["metadata"]["title"] for x in store.load("nhs").collect()) == ["A", "C"] == sorted(x["metadata"]["title"] for x in got.collect())
    assert crawl.Crawl([web.NHS]).crawl(roots, robots=robots, get=get)[1].first()["visited"] == 2
    assert crawl.Crawl([web.NHS]).crawl(roots, max_pages=1, get=get)[1].first()["visited"] == 1


def test_report_shows_some_errors_and_counts_all(spark):
    v = spark.range(500).select(F.format_string("u%03d", "id").alias("url"), F.lit("failed").alias("status"), F.when(F.col("id") > 9, "x").alias("error"))
    r = crawl.report(v, 3).first()
    assert r["n_errors"] == 490 and [e["url"] for e in r["errors"]] == ["u010", "u011", "u012"] and crawl.errors(v).count() == 490


def test_scratch_frees_tables(spark):
    from textloom.plans import runtime
    from textloom.sources.readers import exists

    keep = runtime.written(spark.range(3), "keep")
    with runtime.scratch():
        inner = runtime.written(spark.range(3), "inner")
        path = runtime._written[-1][1]
        assert inner.count() == 3 and exists(spark, path)
    assert not exists(spark, path) and keep.count() == 3


def test_fetch(spark):
    """From a server of this machine: a page, one that's missing, one that works at the second try, and a host that isn't there."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"]))
            code = 404 if self.path == "/none" else 503 if self.path == "/busy" and sum(p == "/busy" for p, _ in seen) < 2 else 200
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            if code == 200:
                self.wfile.write(f"página {self.path}".encode("latin-1"))

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        urls = spark.createDataFrame([(f"{base}/a",), (f"{base}/none",), (f"{base}/busy",), ("http://127.0.0.1:1/x",)], "url string")
        got = {r["url"].removeprefix(base): (r["html"], r["error"]) for r in crawl.fetch(urls, "me/1.0", timeout=5, delay=0.01).collect()}
    finally:
        server.shutdown()
    assert got["/a"] == ("página /a", None) and got["/busy"] == ("página /busy", None) and got["/none"][0] is None and "404" in got["/none"][1] and got["http://127.0.0.1:1/x"][1]
    assert {a for _, a in seen} == {"me/1.0"} and sum(p == "/busy" for p, _ in seen) == 2


def _matrix(spark, n_docs, n_terms):
    rng = np.random.default_rng(7)
    x = rng.poisson(0.08, (n_docs, n_terms)) * rng.gamma(2.0, 1.0, n_terms)[None, :]
    x[:, :6] += rng.random((n_docs, 6)) * np.arange(6, 0, -1)
    return x, spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "doc_idx long, term_idx long, weight double")


@pytest.mark.parametrize("n_docs, n_terms", [(200, 420), (420, 200)])
def test_lsi_driver_holds_a_few_columns_only(spark, monkeypatch, n_docs, n_terms):
    """Fitted and projected with memory for a few columns and small pieces on either side: the driver never has the components, and
    what is left on disk is the components' and the vectors' table."""
    from textloom.plans import runtime

    x, w = _matrix(spark, n_docs, n_terms)
    n = min(n_docs, n_terms)
    monkeypatch.setattr(lsi, "LIMIT", 4 * n * 5)
    monkeypatch.setattr(lsi, "SLICE", 4 * n_terms * 6)
    monkeypatch.setattr(lsi, "CUT", 100)
    monkeypatch.setattr(lsi, "CUT_ROWS", 7)
    monkeypatch.setattr(lsi, "SMALL_ROWS", 50)
    with monkeypatch.context() as patch:
        patch.setattr(lsi.LsiModel, "components", property(lambda m: pytest.fail("the components were collected")))
        before = runtime.mark()
        m = lsi.fit(w, n_docs, n_terms, 20)
        got = {r["doc_idx"]: r["vec"] for r in lsi.project(w, m).collect()}
        assert runtime.mark() - before <= 1 + -(-n * 8 * 20 // lsi.LIMIT)
    v = lsi._columns(m.table, n_terms, 0, 20).astype(float)
    assert np.allclose(v.T @ v, np.eye(20), atol=1e-5) and (v[np.abs(v).argmax(0), np.arange(20)] > 0).all()
    assert np.abs(m.singular / np.linalg.svd(x)[1][:20] - 1).max() < 1e-3
    assert np.allclose([got[i] for i in range(n_docs)], x @ v, rtol=1e-5, atol=1e-5)


def test_lsi_queries_need_their_terms_only(spark, monkeypatch):
    """Few weights against components that are too many to send: the rows of their terms are sent, all columns at once."""
    x, w = _matrix(spark, 120, 300)
    m = lsi.fit(w, 120, 300, 12)
    v = m.components
    asked, columns = [], lsi._columns
    monkeypatch.setattr(lsi, "SLICE", 4 * 300 * 3)
    monkeypatch.setattr(lsi, "_columns", lambda table, n, a, b, ids=None: asked.append((a, b, len(ids))) or columns(table, n, a, b, ids))
    q = spark.createDataFrame([("a", 3, 2.0), ("a", 7, 1.0), ("b", 299, 0.5), ("b", 3, 1.0)], "query_id string, term_idx long, weight double")
    got = {r["query_id"]: r["vec"] for r in lsi.project(q, m, "query_id").collect()}
    assert np.allclose(got["a"], 2 * v[3] + v[7], atol=1e-6) and np.allclose(got["b"], 0.5 * v[299] + v[3], atol=1e-6)
    assert asked == [(0, 12, 3)]
