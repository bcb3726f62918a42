"""A crawl as tables: sitemaps to a queue of urls, robots' rules, pages to documents, and a report."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import uuid5_url
from ..functions.web import SiteRule, accepts, scrape, url_host
from ..plans.runtime import written

MAX_DEPTH = 3


def sitemap_locs(tag: str) -> Column:
    """The locations of a sitemap's (xml) entries of a tag, in order."""
    xml = F.regexp_replace(F.col("xml"), r"xmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}>.*?<loc>\s*([^<]*?)\s*</loc>.*?</{tag}>"), 1)
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, "&amp;", "&"))


def sitemap_urls(sitemaps: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, pos, loc): page urls of the roots (root) and the sitemaps they point to, at most ``max_depth`` levels down.
    sitemaps: (url, xml). A sitemap that is missing or can't be read gives none."""
    table = sitemaps.select("url", sitemap_locs("url").alias("pages"), sitemap_locs("sitemap").alias("maps")).dropDuplicates(["url"])
    level = roots.select("root", F.col("root").alias("url"), F.array(F.lit(0)).alias("path"))
    out = None
    for _ in range(max_depth + 1):
        here = level.join(table, "url")
        found = here.select("root", "path", F.posexplode("pages").alias("i", "loc")).select("root", F.concat("path", F.array("i")).alias("pos"), "loc")
        out = found if out is None else out.unionByName(found)
        level = here.select("root", "path", F.posexplode("maps").alias("i", "url")).select("root", "url", F.concat("path", F.array("i")).alias("path"))
    return out


def queue(urls: DataFrame, rules: list[SiteRule]) -> DataFrame:
    """(url, source): each url once, with the first rule in order that lists and accepts it. urls: (source, pos, loc)."""
    order = {r.source: i for i, r in enumerate(rules)}
    ok = F.lit(False)
    for r in rules:
        ok = F.when(F.col("source") == r.source, accepts(F.col("loc"), r)).otherwise(ok)
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("source")]
    w = Window.partitionBy("loc").orderBy("_rule", "pos")
    q = urls.where(ok).withColumn("_rule", rank).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return q.select(F.col("loc").alias("url"), "source", "_rule", "pos")


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*", fail_open: bool = True) -> DataFrame:
    """``urls`` that robots.txt allows. robots: (host, txt), one row a host; hosts without a row or with a null txt are open, or closed
    if ``fail_open`` is false. Rules are parsed once a host and batch."""

    @F.pandas_udf("boolean")
    def may(url: pd.Series, txt: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for u, t in zip(url, txt):
            if t is None:
                out.append(fail_open)
                continue
            if t not in parsed:
                parsed[t] = RobotFileParser()
                parsed[t].parse(t.splitlines())
            out.append(parsed[t].can_fetch(agent, u))
        return pd.Series(out, dtype=bool)

    u = urls.withColumn("_host", url_host(F.col("url")))
    j = u.join(robots.select(F.col("host").alias("_host"), F.col("txt").alias("_txt")), "_host", "left")
    return j.where(may("url", "_txt")).drop("_host", "_txt")


def fetch(urls: DataFrame, user_agent: str = "Mozilla/5.0", timeout: float = 15.0, retries: int = 3, delay: float = 2.0) -> DataFrame:
    """(url, html, error): pages fetched by tasks that each have whole hosts, at most one request a host every ``delay``
    seconds. Any error gives a null page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        import urllib.error
        import urllib.request

        last: dict[str, float] = {}
        for b in batches:
            rows = []
            for url, host in zip(b["url"], b["_host"]):
                html = error = None
                for attempt in range(retries + 1):
                    time.sleep(max(0.0, last.get(host, 0.0) + delay - time.time()))
                    last[host] = time.time()
                    try:
                        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as r:
                            html, error = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None
                        break
                    except urllib.error.HTTPError as e:
                        error = str(e)
                        if e.code not in (429, 500, 502, 503, 504):
                            break
                        time.sleep(0.5 * 2**attempt)
                    except Exception as e:
                        error = str(e)
                        break
                rows.append((url, html, error))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.withColumn("_host", F.coalesce(url_host(F.col("url")), F.lit(""))).repartition("_host").sortWithinPartitions("_host").mapInPandas(run, "url string, html string, error string")


def pages_to_documents(pages: DataFrame, rules: list[SiteRule]) -> DataFrame:
    """(url, source, html) pages as documents with doc_id from the url, and status ``ok`` or ``failed``."""
    out = None
    for r in rules:
        p = pages.where(F.col("source") == r.source).withColumn("_s", scrape(r)("html", "url"))
        out = p if out is None else out.unionByName(p)
    meta = F.map_from_arrays(F.array(*[F.lit(k) for k in ("title", "source", "language", "date", "category")]), F.array(*[F.col(f"_s.{k}") for k in ("title", "source", "language", "date", "category")]))
    ok = F.col("_s.title").isNotNull()
    return out.select(uuid5_url(F.col("url")).alias("doc_id"), F.col("_s.text").alias("text"), "url", F.when(ok, meta).alias("metadata"), "source", F.when(ok, "ok").otherwise("failed").alias("status"))


#: Errors that a report's row shows.
SHOWN_ERRORS = 100


def errors(visits: DataFrame) -> DataFrame:
    """(url, message) of every visit that ended in an error."""
    return visits.where("error is not null").select("url", F.col("error").alias("message"))


def report(visits: DataFrame, shown: int = SHOWN_ERRORS) -> DataFrame:
    """One row of (visited, successful, failed, saved, n_errors, errors, success_rate) from (url, status, error). ``errors`` shows the first
    ``shown`` by url, ``n_errors`` counts all; the table of all is ``errors()``. Pages without content failed but have no
    error."""
    ok = F.col("status") == "ok"
    a = visits.agg(F.count(F.lit(1)).alias("visited"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(ok).alias("saved"), F.count("error").alias("n_errors"))
    first = errors(visits).orderBy("url", "message").limit(shown).agg(F.sort_array(F.collect_list(F.struct("url", "message"))).alias("errors"))
    rate = F.coalesce(F.try_divide(F.col("successful").cast("double"), F.col("visited").cast("double")), F.lit(0.0))
    return a.crossJoin(F.broadcast(first)).select("visited", "successful", "failed", "saved", "n_errors", "errors", rate.alias("success_rate"))  # a row each


def queued_by_source(q: DataFrame) -> DataFrame:
    return q.groupBy("source").agg(F.count(F.lit(1)).alias("queued"))


def gaps(log: DataFrame) -> DataFrame:
    """(host, url, ts, gap): seconds since the host's last request."""
    w = Window.partitionBy("host").orderBy("ts", "url")
    h = log.withColumn("host", url_host(F.col("url")))
    return h.withColumn("gap", F.col("ts").cast("double") - F.lag("ts").over(w).cast("double"))


class Crawl:
    """Rules in order; pages, sitemaps and robots come as tables."""

    def __init__(self, rules: list[SiteRule]):
        if not rules:
            raise ValueError("a crawl needs at least one rule")
        self.rules = rules

    def crawl(self, roots: DataFrame, sitemaps: DataFrame | None = None, robots: DataFrame | None = None, max_pages: int | None = None, store=None, get=fetch) -> tuple[DataFrame, DataFrame]:
        """(documents, report) of the sites whose sitemaps are given as roots (source, root), from sitemap to stored document: sitemaps are
        read from a table (url, xml) or else fetched level by level, urls are queued, robots' rules applied, pages fetched with
        ``get``, scraped, and appended to ``store`` (a RawStore) if there's one. What was fetched is written once."""
        at = roots.select("root").distinct()
        if sitemaps is None:
            level, sitemaps = at.select(F.col("root").alias("url")), None
            for _ in range(MAX_DEPTH + 1):
                got = written(get(level).select("url", F.col("html").alias("xml")), "sitemaps")
                sitemaps = got if sitemaps is None else sitemaps.unionByName(got)
                level = got.select(F.explode(sitemap_locs("sitemap")).alias("url")).distinct().join(sitemaps.select("url"), "url", "left_anti")
        urls = sitemap_urls(sitemaps, at).join(roots.select("root", "source").distinct(), "root").select("source", "pos", "loc")
        queue_ = self.queued(urls, robots, max_pages)
        pages = written(get(queue_.select("url")), "fetched")
        docs, result = self._documents(queue_, pages)
        if store is not None:
            store.save(docs, max_records_per_file=50)
        return docs, result

    def queued(self, urls: DataFrame, robots: DataFrame | None = None, max_pages: int | None = None) -> DataFrame:
        """(url, source) to be visited. The cap counts attempts after robots."""
        q = queue(urls, self.rules)
        q = allowed(q, robots) if robots is not None else q
        q = q.orderBy("_rule", "pos", "url").limit(max_pages) if max_pages is not None else q
        return written(q.select("url", "source"), "queue")

    def run(self, urls: DataFrame, pages: DataFrame, robots: DataFrame | None = None, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(documents, report). urls: (source, pos, loc); pages: (url, html[, error]). The cap counts attempts after robots."""
        return self._documents(self.queued(urls, robots, max_pages), pages)

    def _documents(self, queue_: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        got = queue_.join(pages if "error" in pages.columns else pages.withColumn("error", F.lit(None).cast("string")), "url", "left")
        docs = written(pages_to_documents(got.where("error is null"), self.rules), "scraped")
        bad = got.where("error is not null").select("url", F.lit("failed").alias("status"), "error")
        visits = docs.select("url", "status", F.lit(None).cast("string").alias("error")).unionByName(bad)
        return docs.where("status = 'ok'").drop("status"), report(visits)


def category_column(url: Column, rules: list[SiteRule]) -> Column:
    from ..functions.web import category

    out = F.lit("")
    for r in reversed(rules):
        out = F.when(accepts(url, r), category(url, r)).otherwise(out)
    return out
