"""Problem 3: a page's article without what surrounds it.

The pages of a host and language section are merged into a style tree of two levels: blocks (runs of non-blank lines) and
lines. A line's style is its words in lower case with numbers as 0 and with every word masked that is rare in the section,
so that teasers of different pages have one style. Each style node has

- a content importance, 1 minus the entropy of its lines over pages, normalised to ``PAGES`` pages: with c_i lines on page i of r
  in all the entropy is log r - sum(c_i log c_i) / r, that of n = exp(entropy) pages of equal shares. The share of pages, n of
  all, is that of the host, drawn to that of the section where the host has few pages, or that of the section over all hosts if
  that is larger.
- a presentation importance for styles of low content importance: 0 if the style mostly stands in blocks of such styles of
  which one names another page (has a masked word); else the entropy of where it stands, at the page's edges or within, if
  it stands mostly at the edges; else 1. Menus and footers always stand at the edges; headings and lists of the article don't.

A block's importance is the mean of its lines'; blocks under ``LEAST`` are removed with all of their lines, and from other
blocks the lines whose own importance is lower because they stand at edges.

Defined results: null and blank texts have no lines; pages delivered several times with the same text count once and come out
once; different texts of one doc_id are pages of their own, of which ``boilerplate_lines`` gives the line numbers together and
``article_text`` a row each; null or malformed urls are one host of their own; the metadata isn't needed; ties can't occur;
extra columns are ignored; empty tables give no rows. Hot hosts and styles: all counts are combined in each task first; styles
are joined by ``lookup``. Texts aren't shuffled, but for those that are delivered again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flat import LETTER, NUMBER, SPACE, Flat, flatten
from ..plans.runtime import at_most, lookup, written
from .lines import cut_lines, is_in

#: Words on fewer than this share of a section's pages are masked.
RARE_WORD = 0.02
#: Styles of a content importance under this are frequent; 0.70 is that of a style on 0.7 % of 1,000 pages.
FREQUENT = 0.70
PAGES = 1000.0
#: How many pages the section counts for in a host's shares.
PRIOR = 50.0
LEAST = 0.5
#: At most so many pairs of numbers are sent to all tasks.
MOST_KEYS = 2_000_000
_MASK, _NUMBER = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Sections are path segments of two letters, so there are at most 676 and one for all others.
_SECTION = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)"
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:]*)"


def _pages(docs: DataFrame) -> DataFrame:
    """(doc_id, text, host, section, h): each page once. ``h`` hashes id and text; only rows whose hash occurs again are compared by their
    texts."""
    d = docs.select("doc_id", "text", "url").where(F.col("text").rlike(r"\S") & F.col("doc_id").isNotNull())
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    section = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _SECTION, 1))
    d = d.select("doc_id", "text", host.alias("host"), section.alias("section"), F.xxhash64("doc_id", "text").alias("h"))
    again = written(d.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "again")
    if again.isEmpty():
        return d
    d = d.join(F.broadcast(again), "h", "left") if at_most(again, MOST_KEYS) else lookup(d, again, ["h"], "rows")
    # Of equal pages under different urls the first by url's host stays.
    first = d.where("rows is not null").groupBy("doc_id", "text").agg(F.min(F.struct("host", "section")).alias("u"), F.first("h").alias("h"))
    return d.where("rows is null").drop("rows").select("doc_id", "text", "host", "section", "h").unionByName(first.select("doc_id", "text", "u.host", "u.section", "h"))


def _words(f: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ws, we = f.runs((f.cls == LETTER) | (f.cls == NUMBER))
    s = np.concatenate([[0], np.cumsum(f.cls == LETTER)])
    return ws, we, f.hashes(ws, we), s[we] == s[ws]


def _word_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        code, names = pd.factorize(pd.Series(b.column("section").to_pylist(), dtype=object))
        for lo, to, f in flatten(b.column("text"), nfc=True, lower=True):
            ws, _, h, number = _words(f)
            w = pd.DataFrame({"r": f.rows_of(ws[~number]), "h": h[~number]}).drop_duplicates()
            w["s"] = code[lo:to][w["r"]]
            n = w.groupby(["s", "h"]).size()
            pages = np.bincount(code[lo:to], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.nulls(len(names), pa.int64()), pa.array(pages.astype(np.int64))], ["section", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(names[n.index.get_level_values(0)], pa.string()), pa.array(n.index.get_level_values(1).to_numpy(np.uint64).view(np.int64)), pa.array(n.to_numpy(np.int64))], ["section", "word", "n"])


def _style_lines(usual: dict[str, np.ndarray]):
    """usual: the sorted hashes of each section's words that aren't rare."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sections = b.column("section").to_pylist()
            code, names = pd.factorize(pd.Series(sections, dtype=object))
            for lo, to, f in flatten(b.column("text"), nfc=True, lower=True):
                row, no, start, end = cut_lines(f)
                solid = np.concatenate([[0], np.cumsum(f.cls != SPACE)])
                full = solid[end] > solid[start]
                begins = full.copy()
                begins[1:] &= ~full[:-1] | (row[1:] != row[:-1])
                block = np.cumsum(begins) - 1
                ws, _, h, number = _words(f)
                owner = np.searchsorted(start, ws, "right") - 1
                sec = code[lo:to][row[owner]]
                known = number.copy()
                for k, name in enumerate(names):
                    m = sec == k
                    known[m] |= is_in(h[m], usual.get(name, none))
                v = np.where(number, _NUMBER, np.where(known, h, _MASK))
                n = len(start)
                place = np.arange(len(ws)) - np.searchsorted(owner, owner)
                with np.errstate(over="ignore"):
                    mixed = (v ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    mixed ^= mixed >> np.uint64(32)
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
                    first, last = np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), "right")
                    style = (total[last] - total[first]) * np.uint64(2) + (last > first)
                masked = np.bincount(owner[~known], minlength=n)
                names_other = (masked > 0) & (masked < last - first)
                title = (masked > 0) & (masked == last - first)
                keep = np.flatnonzero(full)
                r, bl = row[keep], block[keep]
                blocks_before = np.searchsorted(r, r)
                edge = (bl == bl[blocks_before]) | (bl == bl[np.searchsorted(r, r, "right") - 1])
                with np.errstate(over="ignore"):
                    mine, _ = pd.factorize(style[keep] + r.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                seen = np.ones(len(mine), bool)  # codes are given in order of first sight
                seen[np.flatnonzero(np.append(True, mine[1:] > np.maximum.accumulate(mine)[:-1])[: len(mine)])] = False
                logs = np.log(np.bincount(mine)[mine]) if len(mine) else np.zeros(0)  # summed over a page's lines of a style: c log c
                flags = names_other[keep] | title[keep] * 2 | edge * 4 | (~seen) * 8
                off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=to - lo))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (no[keep].astype(np.int32), (bl - bl[blocks_before]).astype(np.int32), style[keep].view(np.int64), flags.astype(np.int32), logs.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(b.column(x).slice(lo, to - lo) for x in ("doc_id", "h", "host", "section")), *lists], ["doc_id", "h", "host", "section", "line_no", "block", "style", "flags", "logs"])

    return run


def line_importance(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line_no, importance): each non-blank line with the lower of its block's importance and its own; ``h`` hashes the page's
    doc_id and text."""
    pages = _pages(docs)
    words = written(pages.select("section", "text").mapInArrow(_word_pages, "section string, word long, n long").groupBy("section", "word").agg(F.sum("n").alias("n")), "words")
    sizes = {r[0]: r[1] for r in words.where("word is null").select("section", "n").collect()}  # at most 677 rows
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map(F.lit(""), F.lit(0))
    # Each word stands on at least a fixed share of its section's pages: there are at most 1 / RARE_WORD times a page's mean number
    # of words, whatever the number of pages.
    usual: dict[str, list[int]] = {}
    for section, word in words.where(F.col("word").isNotNull() & (F.col("n") >= F.greatest(F.lit(2.0), RARE_WORD * size[F.col("section")]))).select("section", "word").toLocalIterator():
        usual.setdefault(section, []).append(word)
    vocabulary = {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in usual.items()}
    key = docs.schema["doc_id"].dataType.simpleString()
    table = pages.mapInArrow(_style_lines(vocabulary), f"doc_id {key}, h long, host string, section string, line_no array<int>, block array<int>, style array<long>, flags array<int>, logs array<float>")
    table = written(table.withColumn("page", F.monotonically_increasing_id()), "styles")
    lines = table.select("page", "host", "section", F.explode(F.arrays_zip("line_no", "block", "style", "flags", "logs")).alias("l")).select("page", "host", "section", "l.*")
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    # Content importance.
    # How many pages of equal shares a style is spread over.
    spread_over = lambda rows, logs: F.exp(F.log(F.col(rows)) - F.col(logs) / F.col(rows))
    by_host = written(lines.groupBy("host", "section", "style").agg(F.count(F.lit(1)).alias("rows"), F.sum("logs").alias("logs")), "by-host")
    by_section = by_host.groupBy("section", "style").agg(F.sum("rows").alias("rows_all"), F.sum("logs").alias("logs_all"))
    by_section = by_section.select("section", "style", spread_over("rows_all", "logs_all").alias("n_all"))
    m_host = table.groupBy("host", "section").agg(F.count(F.lit(1)).alias("m"))
    node = by_host.join(by_section, ["section", "style"]).join(m_host, ["host", "section"])
    all_pages = F.col("n_all") / size[F.col("section")]
    share = F.greatest(all_pages, (spread_over("rows", "logs") + PRIOR * all_pages) / (F.col("m") + PRIOR))
    content = 1 - F.log1p(PAGES * share) / float(np.log1p(PAGES))
    node = written(node.where((content < FREQUENT) & (F.col("n_all") > 2.001)).select("host", "section", "style", "rows", F.lit(True).alias("frequent")), "nodes")
    lines = lookup(lines, node, ["host", "section", "style"], "rows").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    lines = lines.select("page", "section", "block", "line_no", "style", "flags", "frequent")
    # Presentation importance: which company the frequent styles keep. A page's blocks are bounded by the page.
    # Windows instead of aggregates that are joined back: the lines are moved once.
    block = Window.partitionBy("page", "block")
    lines = lines.repartition("page").withColumn("other", F.max(F.col("frequent") & flag(1)).over(block)).withColumn("share", F.avg(F.col("frequent").cast("int")).over(block))
    lines = written(lines, "lines")
    shown = lines.where("frequent").groupBy("section", "style").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(flag(4).cast("int")).alias("edge"), F.avg((F.col("other") & (F.col("share") > 0.5)).cast("int")).alias("mates"))
    e = F.greatest(F.least(F.col("edge"), F.lit(1 - 1e-9)), F.lit(1e-9))
    entropy = -(e * F.log2(e) + (1 - e) * F.log2(1 - e))
    shown = written(shown.select("section", "style", "rows", F.when(F.col("mates") >= 0.5, 0.0).when(F.col("edge") > 0.5, entropy).otherwise(1.0).alias("shown")), "shown")
    lines = lookup(lines, shown, ["section", "style"], "rows")
    worth = F.when(~F.col("frequent") | flag(2), 1.0).otherwise(F.col("shown"))
    own = F.when(F.col("frequent") & ~flag(1) & ~flag(2), F.col("shown")).otherwise(1.0)
    lines = lines.select("page", "block", "line_no", worth.alias("worth"), own.alias("own")).repartition("page").withColumn("importance", F.avg("worth").over(block))
    out = lines.join(table.select("page", "doc_id", "h"), "page")
    return out.select("doc_id", "h", F.col("line_no").cast("long").alias("line_no"), F.least("importance", "own").alias("importance"))


def boilerplate_lines(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, line_no) of the non-blank lines that aren't part of the article."""
    return line_importance(docs).where(F.col("importance") < least).select("doc_id", "line_no").distinct()


def article_text(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, text): each page's article lines in order; pages without an article come out with an empty text. Pages and the
    numbers of their lines meet by the hash of the page, so the texts are shuffled once, as they are the result."""
    kept = line_importance(docs).where(F.col("importance") >= least).select("doc_id", "h", "line_no").distinct()
    kept = kept.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_set("line_no")).alias("_keep"))
    pages = _pages(docs)
    rows = pages.join(kept, (pages["doc_id"] == kept["_d"]) & (pages["h"] == kept["_h"]), "left").select("doc_id", F.split("text", "\n").alias("_l"), F.coalesce("_keep", F.array().cast("array<bigint>")).alias("_k"))
    return rows.select("doc_id", F.array_join(F.transform("_k", lambda i: F.element_at("_l", (i + 1).cast("int"))), "\n").alias("text"))
