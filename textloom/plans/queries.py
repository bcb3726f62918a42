"""The engine's queries by name, over whole tables; ``oracle`` has their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import web
from ..functions.ids import safe_key, uuid5_url
from ..operators import crawl, search, spell, tfidf
from ..operators import index as ix
from ..operators.preprocess import TextProcessor, stop_words
from ..sources import readers, stores
from ..streaming.ingest import append_new, event_counts, stream_documents
from .engine import LsiRetriever, OverlapRetriever, TfidfRetriever
from .runtime import shared_dir, shuffles_freed, spread

#: Query texts of the retrieval queries.
TEXTS = [("q1", "dolor de espalda y fiebre nocturna"), ("q2", "The blurred vision, a light sleep"), ("q3", "la piel irritada xqzzy"), ("q4", "der trockene Husten"), ("q5", "wqxyzz")]
#: Words with a slip for the spelling queries.
SLIPS = ["tratamineto", "pacintes", "hospitl", "especialista", "treatmnt", "laboratry", "zzzzzzzz"]
URLS = [
    "https://www.mayoclinic.org/diseases-conditions/flu/symptoms-causes/syc-1", "https://www.mayoclinic.org/es/symptoms/cough/basics", "https://www.mayoclinic.org/about/contact",
    "https://medlineplus.gov/asthma.html", "https://medlineplus.gov/spanish/asthma.html", "https://medlineplus.gov/ency/article/000305.htm", "https://medlineplus.gov/druginfo/a/b.html",
    "https://www.nhs.uk/conditions/asthma/", "https://www.nhs.uk/live-well/eat-well/", "https://www.nhs.uk/nhs-services/gps/", "not a url",
]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _place(spark, name: str) -> str:
    """A new folder for files that a query writes and reads again."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _docs(spark, d):
    return spread(_t(spark, d, "documents").select("doc_id", "text", "url"))


def _tokens(spark, d):
    return TextProcessor().process(_docs(spark, d)).select("doc_id", "tokens")


def _tf(spark, d):
    return _tokens(spark, d).select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def _index(spark, d, **more):
    return ix.build(_docs(spark, d), **more)


def _queries(spark):
    return spark.createDataFrame(TEXTS, "query_id string, text string")


def doc_normalize(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", tx.normalize_text(F.col("text")).alias("norm"))


def doc_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tx.tokens(tx.normalize_text(F.col("text")))).alias("pos", "token")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


def doc_token_filter(spark, d):
    return _tokens(spark, d).where(F.size("tokens") > 0).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))


def stopword_filter(spark, d):
    p = TextProcessor(stopwords=stop_words("spanish"))
    return p.process(_docs(spark, d)).where(F.size("tokens") > 0).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))


def strip_accents(spark, d):
    return _t(spark, d, "common_words").select("lang", "word", tx.strip_accents(F.col("word")).alias("bare"))


def lemma_counts(spark, d):
    """Tokens counted by a lemma dictionary that maps words of the common list to the first of their language."""
    lemmas = spark.createDataFrame([("los", "el"), ("las", "la"), ("una", "un"), ("die", "der"), ("das", "der"), ("les", "le"), ("os", "o")], "token string, lemma string")
    from ..operators.preprocess import lemmatize_by_join

    t = _tokens(spark, d).select("doc_id", F.explode("tokens").alias("token"))
    return lemmatize_by_join(t, lemmas).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(spark, d):
    return _tf(spark, d)


def document_frequency(spark, d):
    return ix.vocabulary_of(_tf(spark, d).withColumnRenamed("doc_id", "doc_idx")).select("term", "df")


def corpus_frequency(spark, d):
    return ix.vocabulary_of(_tf(spark, d)).select("term", "cf")


def vocabulary(spark, d):
    return _index(spark, d).vocabulary.select("term", "term_idx", "df", "cf")


def inverted_index_stats(spark, d):
    p = _index(spark, d).inverted()
    tf = F.aggregate("postings", F.lit(0).cast("long"), lambda a, x: a + x["tf"])
    at = lambda i: F.element_at("postings", i)["doc_idx"]
    return p.groupBy("term").agg(F.sum(F.size("postings").cast("bigint")).alias("df"), F.sum(tf).alias("cf"), F.min(at(1)).alias("first_doc"), F.max(at(-1)).alias("last_doc"))


def min_doc_length(spark, d):
    return _index(spark, d, min_doc_length=100).corpus.select("doc_idx", "doc_id")


def min_term_frequency(spark, d):
    return _index(spark, d, min_term_frequency=5).vocabulary.select("term", "term_idx", "cf")


def corpus_stats(spark, d):
    s = ix.stats(_index(spark, d))
    return s.select("n_documents", "n_terms", "total_tokens", F.round("avg_tokens_per_doc", 6).alias("avg_tokens_per_doc"), F.round("avg_postings_per_term", 6).alias("avg_postings_per_term"))


def _updated(spark, d):
    docs = _docs(spark, d)
    old = ix.build(docs.where(F.col("url").contains("/es/")))
    return ix.update(old, docs.where(F.col("url").isNotNull()))


def index_update(spark, d):
    return _updated(spark, d).corpus.select("doc_idx", "doc_id")


def index_update_stats(spark, d):
    return ix.stats(_updated(spark, d)).select("n_documents", "n_terms", "total_tokens")


def _removed(spark, d):
    docs = _docs(spark, d)
    return ix.remove(ix.build(docs), docs.where(F.col("url").contains("/en/")).select("doc_id"))


def index_remove(spark, d):
    return _removed(spark, d).corpus.select("doc_idx", "doc_id")


def index_remove_terms(spark, d):
    return _removed(spark, d).vocabulary.select("term", "term_idx", "df", "cf")


def idf(spark, d):
    return tfidf.fit(_index(spark, d)).vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark, d):
    i = _index(spark, d)
    return tfidf.weights(i.postings, tfidf.fit(i)).select("doc_idx", "term_idx", "tf", F.round("weight", 6).alias("weight"))


def tfidf_top_terms(spark, d):
    i = _index(spark, d)
    w = tfidf.weights(i.postings, tfidf.fit(i)).select(F.col("doc_idx").alias("query_id"), "term", F.col("weight").alias("score"))
    return search.ranked(w, 3, tie="term", digits=6).select(F.col("query_id").alias("doc_idx"), "rank", "term", F.col("score").alias("weight"))


def query_vector(spark, d):
    q = ix.query_terms(_queries(spark))
    return tfidf.query_weights(q, tfidf.fit(_index(spark, d))).select("query_id", "term", F.round("weight", 6).alias("weight"))


def oov_filter(spark, d):
    q = ix.query_terms(_queries(spark))
    return q.join(_index(spark, d).vocabulary.select("term"), "term", "left_anti").select("query_id", "term")


def _ranked(spark, d, k, threshold=None):
    return TfidfRetriever(_index(spark, d)).retrieve(_queries(spark), k, threshold).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def tfidf_cosine_topk(spark, d):
    return _ranked(spark, d, 10).where("query_id = 'q1'")


def multi_query_topk(spark, d):
    return _ranked(spark, d, 10)


def threshold_after_topk(spark, d):
    return _ranked(spark, d, 10, 0.2)


def overlap_topk(spark, d):
    return OverlapRetriever(_docs(spark, d)).retrieve(_queries(spark), 5).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def late_fetch(spark, d):
    found = TfidfRetriever(_index(spark, d)).retrieve(_queries(spark), 3)
    return search.fetch(found, _docs(spark, d)).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.coalesce("url", F.lit("")).alias("url"), F.length("text").cast("bigint").alias("chars"))


def console_results(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", "url", F.create_map(F.lit("title"), F.col("title")).alias("metadata"))
    found = TfidfRetriever(_index(spark, d)).retrieve(_queries(spark), 3)
    return search.console_lines(search.fetch(found, docs))


def _words(spark, d):
    t = _tokens(spark, d).select("doc_id", F.posexplode("tokens").alias("i", "token"))
    return spell.learn(t.select("token", F.struct("doc_id", "i").alias("pos")))


def _slips(spark):
    return spark.createDataFrame([(s,) for s in SLIPS], "token string")


def spell_candidates(spark, d):
    return spell.candidates(_slips(spark), _words(spark, d)).select("token", "word", F.col("distance").cast("bigint").alias("distance"))


def spell_correct(spark, d):
    t = _slips(spark).withColumn("given", F.col("token"))
    return spell.correct(t, _words(spark, d)).select("given", "token")


def spell_correct_insertion(spark, d):
    return spell.corrections(_slips(spark), _words(spark, d), tie_break="insertion").select("token", "correction", F.col("distance").cast("bigint").alias("distance"))


def embedding_cosine_topk(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")  # the stated query set, against all rows
    top = search.vector_top_k(q, e, 6, "vec_id")
    return search.ranked(top.where("vec_id <> query_id").drop("rank"), 5, tie="vec_id", digits=6).select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "score")


def embedding_score_clamp(spark, d):
    """Cosine of each vector with the next by id, clamped to [0, 1]."""
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(search.clamp(search.cosine(F.col("vec"), F.col("next"))), 6).alias("score"))


def fetch_by_ids(spark, d):
    ids = spark.createDataFrame([(0, 7), (1, -1), (2, 2), (3, 12), (4, 2)], "pos long, doc_id long")
    return search.fetch_by_ids(ids, _docs(spark, d)).select("pos", "doc_id", "url")


def url_parts(spark, d):
    u = F.col("url")
    return _docs(spark, d).where("url like 'http%'").select("doc_id", web.url_host(u).alias("host"), web.url_path(u).alias("path"))


def _urls(spark, d):
    """All urls of the tables, and fixed ones of sites that the rules know."""
    u = _t(spark, d, "documents").select("url").unionByName(_t(spark, d, "crawled_docs").select("url"))
    return u.unionByName(spark.createDataFrame([(u,) for u in URLS], "url string")).where("url is not null").distinct()


def url_predicates(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", *[web.accepts(u, r).alias(r.source) for r in web.SITES], web.in_domain(u, "nhs.uk").alias("in_nhs"))


def url_route(spark, d):
    return _urls(spark, d).select("url", web.route(F.col("url")).alias("source"))


def url_category(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("url", *[web.category(u, r).alias(r.source) for r in web.SITES])


def page_doc_id(spark, d):
    return _t(spark, d, "crawled_docs").where("url is not null").select("url", uuid5_url(F.col("url")).alias("id")).distinct()


PAGES = [
    ("https://www.mayoclinic.org/diseases-conditions/flu/x", '<html lang="es-MX"><head><meta property="article:modified_time" content="2024-01-02"></head><body><h1>Menu</h1><div id="main-content"><h1>Flu</h1><p>The flu attacks the nose, the throat and the lungs of many people.<p>Rest helps.</div></body></html>'),
    ("https://medlineplus.gov/asthma.html", '<html><head><meta name="DC.Date.Modified" content="2023-05-06"></head><body><article><h1>Asthma</h1><section id="topsum_section"><p>Asthma makes the airways narrow and swollen, so breathing is hard.</p></section><p>Links</p></article></body></html>'),
    ("https://www.nhs.uk/conditions/asthma/", '<html lang="en"><body><main><h1>Asthma</h1><p>Too short.</p></main></body></html>'),
    ("https://www.nhs.uk/live-well/sleep/", '<html lang="en-GB"><body><main><h1>Sleep</h1><script>var p="<p>no</p>";</script><p>Most adults need about seven to nine hours of sleep a night.</p></main></body></html>'),
    ("https://www.nhs.uk/conditions/none/", "<html><body><main><p>There is no title here, though there is a long enough paragraph of text.</p></main></body></html>"),
]


def _pages(spark, d):
    """(url, source, html): a page made of each document, with entities for what html reserves, and the fixed pages."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    doc = _t(spark, d, "documents").where("text is not null")
    paragraphs = F.array_join(F.transform(F.split("text", "\n\n"), lambda p: F.concat(F.lit("<p>"), safe(p), F.lit("</p>"))), "\n")
    html = F.concat(F.lit('<html lang="'), F.regexp_replace(F.coalesce("lang", F.lit("")), '[<>"&]', ""), F.lit('"><head><meta name="article:modified_time" content="'), F.regexp_replace(F.coalesce("published", F.lit("")), '[<>"&]', ""),
                    F.lit('"></head><body><p>Menu</p><main><h1>'), safe(F.col("title")), F.lit("</h1>"), paragraphs, F.lit("</main><p>Foot</p></body></html>"))
    return doc.select(F.concat(F.lit("https://www.nhs.uk/conditions/"), F.col("doc_id").cast("string"), F.lit("/")).alias("url"), F.lit("nhs").alias("source"), html.alias("html"))


def _scraped(spark, d):
    return crawl.pages_to_documents(_pages(spark, d), [web.NHS])


def page_scrape(spark, d):
    return _scraped(spark, d).select("doc_id", "url", "status", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("source", "language", "date", "category")])


def page_title(spark, d):
    return _scraped(spark, d).where("status = 'ok'").select("url", F.col("metadata")["title"].alias("title"))


def page_paragraphs(spark, d):
    return _scraped(spark, d).where("status = 'ok'").select("url", "text")


def page_rules(spark, d):
    """The fixed pages by the rules of their sites."""
    p = spark.createDataFrame(PAGES, "url string, html string").withColumn("source", web.route(F.col("url")))
    docs = crawl.pages_to_documents(p, list(web.SITES))
    return docs.select("doc_id", "url", "status", "text", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("title", "language", "date", "category")])


def page_language(spark, d):
    pages = _pages(spark, d).select("url", "html").unionByName(spark.createDataFrame(PAGES, "url string, html string"))
    return pages.select("url", web.page_language(F.col("html")).alias("lang"))


def _sitemaps(spark, d):
    """(url, xml): a sitemap index for each host, and a sitemap for each of its categories."""
    host = web.url_host(F.col("url"))
    u = _t(spark, d, "documents").where("url like 'http%'").select(host.alias("host"), F.coalesce("category", F.lit("none")).alias("part"), F.regexp_replace("url", "&", "&amp;").alias("url"), "doc_id")
    entry = F.concat(F.lit("<url><loc> "), F.col("url"), F.lit("</loc></url>"))
    maps = u.groupBy("host", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "").alias("x"))
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    child = F.concat("host", F.lit("/"), "part")
    low = maps.select(child.alias("url"), F.concat(F.lit(f"<urlset {ns}>"), "x", F.lit("</urlset>")).alias("xml"))
    listed = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<sitemap><loc>"), child, F.lit("</loc></sitemap>")))), "")
    high = maps.groupBy(F.col("host").alias("url")).agg(F.concat(F.lit(f"<sitemapindex {ns}>"), listed, F.lit("<sitemap><loc>gone</loc></sitemap></sitemapindex>")).alias("xml"))
    return low.unionByName(high), high.select(F.col("url").alias("root"))


def sitemap_scan(spark, d):
    return crawl.sitemap_urls(*_sitemaps(spark, d)).select("root", "loc")


#: Two rules that both take some urls.
RULES = (web.SiteRule("drugs", "", accept=(r"/drug/", r"/symptom/")), web.SiteRule("all", "example"))


def crawl_dedupe(spark, d):
    """Each url once, with the first rule that lists and accepts it."""
    u = crawl.sitemap_urls(*_sitemaps(spark, d)).select("pos", "loc")
    both = u.withColumn("source", F.lit("all")).unionByName(u.withColumn("source", F.lit("drugs")))
    return crawl.queue(both, list(RULES)).select("url", "source")


def crawl_cap(spark, d):
    """The first hundred urls of the queue, as a crawl's cap takes them."""
    u = _t(spark, d, "documents").where("url is not null").select(F.lit("all").alias("source"), F.array("doc_id").alias("pos"), F.col("url").alias("loc"))
    return crawl.Crawl(list(RULES)).queued(u, max_pages=100).select("url")


def robots_filter(spark, d):
    """Robots' rules of every host but one keep crawlers from its Spanish pages and a query."""
    hosts = _t(spark, d, "sites").select("host").unionByName(spark.createDataFrame([("www.nhs.uk",)], "host string"))
    txt = F.when(F.col("host") != "www.salud-norte.example", F.lit("User-agent: *\nDisallow: /es/\nDisallow: /live-well/\n\nUser-agent: other\nDisallow: /"))
    return crawl.allowed(_urls(spark, d), hosts.select("host", txt.alias("txt"))).select("url")


def crawl_report(spark, d):
    """Each stored page is a visit, failed if it has no text."""
    v = _t(spark, d, "crawled_docs").select("url", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "failed").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return crawl.report(v).select("visited", "successful", "failed", "saved", "n_errors", F.round("success_rate", 6).alias("success_rate"))


def crawl_queue(spark, d):
    p = _t(spark, d, "crawled_docs").select(web.url_host(F.col("url")).alias("source"))
    return crawl.queued_by_source(p)


def request_gaps(spark, d):
    p = _t(spark, d, "crawled_docs").where("url is not null").select("url", F.col("crawled_at").alias("ts")).distinct()
    return crawl.gaps(p).groupBy("host").agg(F.count("gap").alias("n"), F.max("gap").cast("double").alias("longest"))


def doc_key(spark, d):
    c = _t(spark, d, "crawled_docs").where("url is not null")
    return c.select(F.col("doc_id").alias("id"), safe_key(F.col("doc_id")).alias("id_key"), safe_key(F.col("url")).alias("url_key")).distinct()


def dedupe_docs(spark, d):
    """The first incoming item of each doc_id."""
    x = _t(spark, d, "incoming_docs").where("doc_id is not null").select("doc_id", "item_id")
    return ix.dedupe(x, "item_id")


def snippet(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


def source_partition(spark, d):
    return _t(spark, d, "documents").where("source is not null").groupBy(tx.source_key(F.col("source")).alias("part")).agg(F.count(F.lit(1)).alias("n"))


def metadata_fields(spark, d):
    m = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")).alias(k)
    return _t(spark, d, "crawled_docs").select("doc_id", *[m(k) for k in ("title", "source", "language", "date", "category")]).distinct()


def _external(spark, d):
    """Crawled pages as another loader would have them: (text, metadata) with source and url in the metadata."""
    m = F.map_concat(F.map_filter("metadata", lambda k, v: ~k.isin("source", "url", "page")), F.create_map(F.lit("url"), F.col("url"), F.lit("source"), F.concat(F.lit("/in/"), F.col("doc_id"), F.lit(".v1.html")), F.lit("page"), F.length("text").cast("string")))
    c = _t(spark, d, "crawled_docs").where("text is not null and metadata is not null and url is not null")
    return readers.from_external(c.select("text", m.alias("metadata")))


def external_documents(spark, d):
    return _external(spark, d).select("doc_id", "url", F.md5("text").alias("h"))


def metadata_rest(spark, d):
    return _external(spark, d).select("doc_id", F.explode("metadata").alias("k", "v")).distinct()


def new_minus_indexed(spark, d):
    a = _t(spark, d, "accepted_docs").where("doc_id is not null").select("doc_id")
    return _t(spark, d, "incoming_docs").where("doc_id is not null").select("doc_id").distinct().join(a, "doc_id", "left_anti")


def bag_union(spark, d):
    """Documents of two sources together, ids not made unique: JSON lines of both in one folder."""
    at = _place(spark, "bag")
    for name in ("accepted_docs", "incoming_docs"):
        _t(spark, d, name).where("doc_id is not null and text is not null").select("doc_id", "text").write.mode("append").option("lineSep", "\n").json(at)
    return readers.read_jsonl(spark, at, glob="*.json").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _table_text(spark, d, sep: str, suffix: str):
    """Some columns of the documents written as files with a header, and read again."""
    at = _place(spark, suffix)
    cols = ["doc_id", "lang", "source", "title", "url", "category"]
    clean = [F.regexp_replace(F.col(c).cast("string"), r"[\x00-\x1F]", " ").alias(c) for c in cols]
    _t(spark, d, "documents").select(*clean).write.option("header", "true").option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("emptyValue", "").csv(at)
    return readers.READERS[suffix](spark, at, glob="*.csv").select("text", F.col("doc_id").rlike(r"_r\d+$").alias("named"))


def csv_scan(spark, d):
    return _table_text(spark, d, ",", "csv")


def tsv_scan(spark, d):
    return _table_text(spark, d, "\t", "tsv")


def json_scan(spark, d):
    """Incoming items as files of one array each, by batch and language; read as a directory of JSON."""
    at = _place(spark, "json")
    x = _t(spark, d, "incoming_docs").select(F.col("item_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "batch_no")
    lang = F.coalesce(F.try_element_at("metadata", F.lit("language")), F.lit("none"))
    files = x.groupBy("batch_no", lang.alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "text", "url", "metadata"))).alias("value"))
    files.repartition("batch_no", "part").write.partitionBy("batch_no", "part").option("maxRecordsPerFile", 1).text(at)
    got = readers.read_json(spark, at, strict=True, recursive=True, glob="*.txt")
    return got.select("doc_id", F.md5("text").alias("h"), "url", F.size("metadata").cast("bigint").alias("n"))


def text_scan(spark, d):
    """The titles of each language as one file, read as one text."""
    at = _place(spark, "text")
    x = _t(spark, d, "documents").where("title is not null").select(F.coalesce("lang", F.lit("none")).alias("part"), F.regexp_replace("title", r"[\r\n]", " ").alias("value"), "doc_id")
    x.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(at)
    return readers.read_text(spark, at, recursive=True).select(F.md5("text").alias("h"), F.length("text").cast("bigint").alias("chars"))


def _site_files(spark, d) -> str:
    """A folder of files about the sites, a fixed table: .txt, .md and .html files, some in folders of their language."""
    at = _place(spark, "files")
    for r in _t(spark, d, "sites").orderBy("source").toLocalIterator():
        stores.write_text(spark, f"{at}/{r['source']}.txt", f"{r['host']}\n{r['main_lang']}")
        stores.write_text(spark, f"{at}/{r['main_lang']}/{r['source']}-md.md", f"# {r['host']}")
        stores.write_text(spark, f"{at}/{r['main_lang']}/{r['source']}-page.html", f"<html><title>{r['source']}</title><script>no</script><p>{r['host']}</p></html>")
    return at


def _listed(docs):
    return docs.select("doc_id", "text", F.regexp_extract("url", r"([^/]*)$", 1).alias("file"))


def directory_scan(spark, d):
    return _listed(readers.load_directory(spark, _site_files(spark, d), ordered=True)).withColumn("pos", F.monotonically_increasing_id()).withColumn("pos", F.row_number().over(Window.orderBy("pos")))  # a few files


def directory_format(spark, d):
    return _listed(readers.load_directory(spark, _site_files(spark, d), "*.html", "html"))


def directory_pattern(spark, d):
    return _listed(readers.load_directory(spark, _site_files(spark, d), "es/*.md", recursive=False))


def rows_to_documents(spark, d):
    rows = [{"doc_id": r["source"], "text": r["main_lang"], "url": r["host"], "metadata": {"second": r["second_lang"]}} for r in _t(spark, d, "sites").toLocalIterator()]
    return readers.from_rows(spark, rows).select("doc_id", "text", "url", F.col("metadata")["second"].alias("second"))


def fallback_corpus(spark, d):
    """The folder isn't there, so the fallback's rows come."""
    return readers.load_or(spark, _place(spark, "none"), _t(spark, d, "accepted_docs").select("doc_id", "text", "url", "metadata")).select("doc_id", F.md5("text").alias("h"))


def _store(spark, d):
    """Accepted documents, then incoming ones over them, the last item of a doc_id staying."""
    s = stores.DocumentStore(spark, _place(spark, "documents"))
    for name in ("accepted_docs", "incoming_docs"):
        s.add(_t(spark, d, name).select("doc_id", "text", "url", "metadata", "item_id"), "item_id")
    return s


def document_upsert(spark, d):
    return _store(spark, d)._all().select("doc_id", F.md5("text").alias("h"), "url")


def document_get_many(spark, d):
    """Documents in the order of the ids asked for, missing ones left out."""
    ids = _t(spark, d, "crawled_docs").select("doc_id").unionByName(_t(spark, d, "accepted_docs").select("doc_id")).distinct().select(F.xxhash64("doc_id").alias("pos"), "doc_id")
    return _store(spark, d).get_many(ids).select("doc_id", F.md5("text").alias("h"))


def document_delete(spark, d):
    s = stores.DocumentStore(spark, _place(spark, "documents"))
    s.add(_t(spark, d, "sites").select(F.col("source").alias("doc_id"), F.col("host").alias("text"), F.lit("").alias("url"), F.create_map().cast("map<string,string>").alias("metadata")))
    done = [s.delete("salud_norte"), s.delete("salud_norte"), s.has("salud_norte"), s.has("clinica_abierta")]
    return s._all().select("doc_id", "text", F.lit(str(done)).alias("done"))


def point_lookup(spark, d):
    """One document by its id, for the ids of a few sites' first documents."""
    s = _store(spark, d)
    first = _t(spark, d, "accepted_docs").agg(F.min("doc_id"), F.max("doc_id")).first()
    return s.get(first[0]).unionByName(s.get(first[1])).select("doc_id", F.md5("text").alias("h"))


def raw_partition(spark, d):
    """Documents written by source; the partitions of three sources read again, one cleared before."""
    s = stores.RawStore(spark, _place(spark, "raw"))
    s.save(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "url", "source"), max_records_per_file=50)
    s.clear("Care Compass")
    out = s.load("salud norte")
    for name in (" Clinica Abierta", "care_compass", "unknown"):
        out = out.unionByName(s.load(name))
    return out.select("doc_id", F.md5("text").alias("h"))


def vector_store(spark, d):
    s = stores.VectorStore(spark, _place(spark, "vectors"))
    v = _t(spark, d, "vectors").where("size(embedding) = 64").select("doc_id", F.coalesce("url", F.lit("")).alias("url"), F.col("embedding").alias("vec"), F.element_at("embedding", 1).alias("at"))
    s.add(v, "at")
    return s.load().select("doc_id", F.round(F.element_at("vec", 1), 9).alias("first"), F.size("vec").cast("bigint").alias("n"))


def model_roundtrip(spark, d):
    s = stores.ModelStore(spark, _place(spark, "model"))
    s.save(tfidf.fit(_index(spark, d)))
    m, _ = s.load()
    return m.vocabulary.select("term", F.round("idf", 6).alias("idf"), F.lit(m.n_docs).cast("bigint").alias("n_docs"))


def manifest(spark, d):
    s = stores.IndexStore(spark, _place(spark, "index"))
    s.save(_index(spark, d))
    m = s.manifest()
    return spark.createDataFrame([(m["schema_version"], m["n_documents"], m["n_terms"])], "schema_version string, n_documents long, n_terms long")


def indexed_ids(spark, d):
    s = stores.IndexStore(spark, _place(spark, "index"))
    s.save(_index(spark, d))
    return s.doc_ids()


def words_roundtrip(spark, d):
    """The spelling vocabulary saved, and read again after live words of another collection."""
    s = stores.IndexStore(spark, _place(spark, "index"))
    s.save_words(_words(spark, d))
    live = spell.learn(_t(spark, d, "common_words").select(F.col("word").alias("token"), F.col("rank_no").cast("bigint").alias("pos")))
    return s.load_words(live).select("word", F.col("pos.saved").cast("bigint").alias("saved"))


def spell_known(spark, d):
    """Common words that the documents have."""
    return spell.known(_t(spark, d, "common_words").select("lang", F.col("word").alias("token")), _words(spark, d))


def spell_words(spark, d):
    return _words(spark, d).select("word")


def console_stats(spark, d):
    return search.stats_lines(ix.stats(_index(spark, d)))


def stream_ingest(spark, d):
    """Accepted documents as JSON lines, taken in as a stream twice over."""
    at, out, mark = (_place(spark, n) for n in ("stream", "taken", "checkpoint"))
    for _ in range(2):
        _t(spark, d, "accepted_docs").where("text is not null").select("doc_id", "text", "url", "metadata").write.mode("append").json(at)
        append_new(stream_documents(spark, at), out, mark).awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.md5("text").alias("h"))


def jsonl_roundtrip(spark, d):
    """Crawled documents written as JSON lines by source and read again."""
    c = _t(spark, d, "crawled_docs").where("text is not null").select("doc_id", "text", "url", "metadata", F.try_element_at("metadata", F.lit("source")).alias("source"))
    s = stores.RawStore(spark, _place(spark, "raw"))
    s.save(c)
    return s.load().select("doc_id", F.md5("text").alias("h"), F.coalesce("url", F.lit("")).alias("url"), F.size(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).cast("bigint").alias("n"))


def index_snapshot_roundtrip(spark, d):
    s = stores.IndexStore(spark, _place(spark, "index"))
    s.save(_index(spark, d))
    i = s.load()
    return i.postings.join(i.corpus.select("doc_idx", "doc_id"), "doc_idx").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))


def stored_postings(spark, d):
    """The stored snapshot's postings by term; a row repeated exactly is one."""
    return ix.vocabulary_of(_t(spark, d, "postings").distinct())


def event_windows(spark, d):
    return event_counts(_t(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def lsi_topk(spark, d):
    with shuffles_freed(spark):
        i = _index(spark, d)
    r = LsiRetriever(k=100).fit(i)
    return r.retrieve(_queries(spark), 10, 0.0).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def lsi_self_projection(spark, d):
    """Cosine of each document's fitted vector with its own text projected as a query."""
    docs = _docs(spark, d)
    with shuffles_freed(spark):
        i = ix.build(docs)
    r = LsiRetriever(k=100).fit(i)
    q = r.query_vectors(docs.select(F.col("doc_id").alias("query_id"), "text")).select(F.col("query_id").alias("doc_id"), F.col("vec").alias("q"))
    return r.vectors.join(q, "doc_id").select("doc_id", F.round(search.cosine(F.col("vec"), F.col("q")), 6).alias("self"))


QUERIES = {f.__name__: f for f in (
    doc_normalize, doc_tokens, doc_token_filter, stopword_filter, strip_accents, lemma_counts, term_frequency, document_frequency, corpus_frequency, vocabulary,
    inverted_index_stats, min_doc_length, min_term_frequency, corpus_stats, index_update, index_update_stats, index_remove, index_remove_terms, idf, tfidf_weights,
    tfidf_top_terms, query_vector, oov_filter, tfidf_cosine_topk, multi_query_topk, threshold_after_topk, overlap_topk, late_fetch, console_results,
    spell_candidates, spell_correct, spell_correct_insertion, embedding_cosine_topk, embedding_score_clamp, fetch_by_ids, url_parts, url_predicates, url_route,
    url_category, page_doc_id, page_scrape, page_title, page_paragraphs, page_rules, page_language, sitemap_scan, crawl_dedupe, crawl_cap, robots_filter, crawl_report, crawl_queue, request_gaps, doc_key, dedupe_docs, snippet,
    source_partition, metadata_fields, external_documents, metadata_rest, new_minus_indexed, bag_union, jsonl_roundtrip, index_snapshot_roundtrip, stored_postings, event_windows,
    csv_scan, tsv_scan, json_scan, text_scan, directory_scan, directory_format, directory_pattern, rows_to_documents, fallback_corpus, document_upsert, document_get_many,
    document_delete, point_lookup, raw_partition, vector_store, model_roundtrip, manifest, indexed_ids, words_roundtrip, spell_known, spell_words, console_stats, stream_ingest,
    lsi_topk, lsi_self_projection,
)}
