"""Urls and pages: which urls are content, what category they have, and what a page says. Rules are data."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SCRAPED
from .ids import uuid5_url  # noqa: F401


def url_host(url: Column) -> Column:
    """Host and port as they stand in the url."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


@dataclass(frozen=True)
class SiteRule:
    """How one site's urls and pages are read. Patterns are regular expressions on the path."""

    source: str
    domain: str
    accept: tuple[str, ...] = ()
    #: (tag, id or None) of the part of a page that holds title and paragraphs, first that is there.
    title_in: tuple[tuple[str, str | None], ...] = ()
    body_in: tuple[tuple[str, str | None], ...] = ()
    date_meta: tuple[tuple[str, str], ...] = ()
    #: (pattern on the path, category), first match.
    categories: tuple[tuple[str, str], ...] = ()
    least_chars: int = 50


# The content paths, date tags and categories of three public health sites.
MAYO = SiteRule(
    "mayo_clinic", "mayoclinic.org",
    accept=(r"^(/es)?/(diseases-conditions|symptoms|tests-procedures|drugs-supplements|healthy-lifestyle)/",),
    title_in=(("*", "main-content"),), body_in=(("*", "main-content"),),
    date_meta=(("name", "article:modified_time"), ("property", "article:modified_time"), ("name", "article:published_time"), ("property", "article:published_time"), ("property", "og:updated_time")),
    categories=((r"diseases-conditions", "disease"), (r"symptoms", "symptom"), (r"tests-procedures", "procedure"), (r"drugs-supplements", "drug"), (r"healthy-lifestyle", "wellness")),
)
MEDLINE = SiteRule(
    "medlineplus", "medlineplus.gov",
    accept=(r"^/[^/]*\.html$", r"^/spanish/.*\.html$", r"^/ency/article/"),
    title_in=(("article", None),), body_in=(("section", "topsum_section"), ("article", None)),
    date_meta=(("name", "DC.Date.Modified"),),
    categories=((r"^/ency/article/", "reference"), (r"\.html$", "health-topic")),
)
NHS = SiteRule(
    "nhs", "nhs.uk",
    accept=(r"^/(conditions|medicines|live-well|mental-health)/",),
    title_in=(("main", None),), body_in=(("main", None),),
    date_meta=(("name", "article:modified_time"), ("property", "article:modified_time"), ("name", "article:published_time"), ("property", "article:published_time")),
    categories=((r"/conditions/", "disease"), (r"/medicines/", "drug"), (r"/live-well/", "wellness"), (r"/mental-health/", "mental-health")),
)
SITES = (MAYO, MEDLINE, NHS)


def in_domain(url: Column, domain: str) -> Column:
    """The default predicate: the domain occurs in the url."""
    return F.contains(url, F.lit(domain))


def accepts(url: Column, rule: SiteRule) -> Column:
    """Whether a url is content of the site; without patterns its domain decides."""
    if not rule.accept:
        return in_domain(url, rule.domain)
    path = url_path(url)
    out = F.lit(False)
    for p in rule.accept:
        out = out | path.rlike(p)
    return out


def category(url: Column, rule: SiteRule) -> Column:
    out, path = None, url_path(url)
    for p, name in rule.categories:
        out = F.when(path.rlike(p), name) if out is None else out.when(path.rlike(p), name)
    return F.lit("") if out is None else out.otherwise("")


def route(url: Column, rules: list[SiteRule] | tuple[SiteRule, ...] = SITES) -> Column:
    """Source of the first rule, in order of registration, that accepts the url; null if none does."""
    out = None
    for r in rules:
        out = F.when(accepts(url, r), r.source) if out is None else out.when(accepts(url, r), r.source)
    return F.lit(None).cast("string") if out is None else out


class _Page(HTMLParser):
    """Titles and paragraphs by the part they're in; tolerant of tags that aren't closed."""

    VOID = {"meta", "link", "br", "img", "hr", "input", "source", "wbr", "area", "base", "col", "embed", "param", "track"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []
        self.lang, self.meta = "", []
        self.titles: list[tuple[frozenset, str]] = []
        self.paragraphs: list[tuple[frozenset, str]] = []
        self.open: list[tuple[str, list[str], frozenset]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang") or ""
        if tag == "meta":
            self.meta.append(a)
        if tag in self.VOID:
            return
        if tag in ("p", "h1") and self.open and self.open[-1][0] == "p":
            self._close("p")
        self.stack.append((tag, a.get("id")))
        if tag in ("p", "h1"):
            parts = frozenset(x for t, i in self.stack[:-1] for x in ((t, None), ("*", i), (t, i)))
            self.open.append((tag, [], parts))

    def _close(self, tag):
        while self.open:
            t, text, parts = self.open.pop()
            value = "".join(text).strip()
            if value:
                (self.titles if t == "h1" else self.paragraphs).append((parts, value))
            if t == tag:
                break

    def handle_endtag(self, tag):
        if tag in ("p", "h1") and any(t == tag for t, _, _ in self.open):
            self._close(tag)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag not in ("p", "h1"):
                    while self.open and self.open[-1][0] in [t for t, _ in self.stack[i:]]:
                        self._close(self.open[-1][0])
                del self.stack[i:]
                break

    def handle_data(self, data):
        if self.open and not any(t in ("script", "style") for t, _ in self.stack[-2:]):
            for _, text, _ in self.open:
                text.append(data)

    def finish(self):
        self.close()
        while self.open:
            self._close(self.open[-1][0])
        return self


def page_fields(html: str | None, url: str | None, rule: SiteRule) -> tuple | None:
    """(title, text, source, language, date, category), or None for a page without a title or with too little text."""
    import re
    from urllib.parse import urlsplit

    if not html:
        return None
    p = _Page()
    p.feed(html)
    p.finish()
    within = lambda items, parts: next((got for part in parts if (got := [v for s, v in items if part in s])), [])
    titles = within(p.titles, rule.title_in) or [v for _, v in p.titles]
    text = "\n\n".join(within(p.paragraphs, rule.body_in))
    if not titles or len(text) < rule.least_chars:
        return None
    date = next((v for k, name in rule.date_meta for m in p.meta if m.get(k) == name and (v := (m.get("content") or "").strip())), "")
    path = urlsplit(url or "").path
    cat = next((c for pattern, c in rule.categories if re.search(pattern, path)), "")
    return titles[0], text, rule.source, (p.lang.split("-")[0].lower() or "en"), date, cat


def scrape(rule: SiteRule):
    """A column function (html, url) -> struct of a page's fields, null where there's no content."""

    @F.pandas_udf(SCRAPED)
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [page_fields(h, u, rule) or (None,) * len(SCRAPED) for h, u in zip(html, url)]
        return pd.DataFrame(rows, columns=SCRAPED.names)

    return run


def page_language(html: Column) -> Column:
    """The language that the page's html tag states, up to the hyphen; ``en`` if it states none."""
    lang = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r'(?i)<html[^>]*\blang="([^"\-]*)', 1))
    return F.when(lang == "", "en").otherwise(lang)


@dataclass
class Registry:
    """Rules in order of registration."""

    rules: list[SiteRule] = field(default_factory=list)

    def register(self, rule: SiteRule) -> None:
        if not isinstance(rule, SiteRule):
            raise TypeError("a SiteRule is expected")
        self.rules.append(rule)

    def for_url(self, url: Column) -> Column:
        return route(url, self.rules)
