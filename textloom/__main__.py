"""Command line: builds or opens an index and answers queries. ``python -m textloom --help``."""

from __future__ import annotations

import argparse
import sys

HELP = """
  <words>   search
  stats     figures of the collection
  help      this text
  quit      leave
"""


def show_stats(row: dict) -> str:
    """A line a figure; floats with two places."""
    return "\n".join(f"  {k:<25}: {v:.2f}" if isinstance(v, float) else f"  {k:<25}: {v}" for k, v in row.items())


def show_results(found: list, query: str) -> str:
    if not found:
        return f"\n  No results found for: '{query}'"
    out = [f"\n  Results ({len(found)} found):"]
    for rank, score, d in found:
        short = (d["text"] or "")[:120].replace("\n", " ") + "..."
        out.append(f"\n  {rank}. [{score:.3f}] {dict(d['metadata'] or {}).get('title') or d['doc_id']}\n       {d['url'] or '(no url)'}\n       {short}")
    return "\n".join(out)


def main(argv: list[str] | None = None, spark=None, read=input, write=print) -> int:
    p = argparse.ArgumentParser(prog="textloom", description="Search in a folder of documents.")
    p.add_argument("--data", help="folder of .jsonl, .json, .txt, .md, .csv, .tsv, .html and .pdf files; a few made-up documents without it")
    p.add_argument("--store", help="folder in which the index is kept; it's opened if it has one")
    p.add_argument("--query", "-q", help="answer one query and leave")
    p.add_argument("--stats", action="store_true", help="show figures of the collection and leave")
    p.add_argument("--top-k", type=int, default=5, help="number of results (5)")
    p.add_argument("--threshold", type=float, default=None, help="least score of a result (0.4)")
    p.add_argument("--rank", type=int, default=100, help="rank of the projection (100)")
    p.add_argument("--language", default="spanish", help="language of the stop words")
    p.add_argument("--update", action="store_true", help="add documents of --data that the opened index doesn't have")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from .operators.preprocess import TextProcessor, stop_words
    from .plans.engine import Engine
    from .plans.serve import Session, TooLarge
    from .sources.demo import demo_documents
    from .sources.readers import load_or

    spark = spark or SparkSession.builder.appName("textloom").getOrCreate()
    processor = TextProcessor(stopwords=stop_words(a.language))
    docs = lambda: load_or(spark, a.data, demo_documents(spark)) if a.data else demo_documents(spark)
    if a.store and Engine.exists(spark, a.store):
        e = Engine.open(spark, a.store, processor)
        if a.update:
            e = e.update(docs()).fit(a.rank)
    else:
        e = Engine(spark, processor, path=a.store).build(docs()).fit(a.rank)
    stats = lambda: show_stats(e.stats().first().asDict())
    if a.stats:
        write(stats())
        return 0
    try:
        session = Session(e)
        ask = lambda q: session.search(q, a.top_k, a.threshold)
    except TooLarge:
        def ask(q):
            rows = e.search(spark.createDataFrame([("q", q)], "query_id string, text string"), a.top_k, a.threshold).collect()
            return [(r["rank"], r["score"], r.asDict()) for r in rows]
    if a.query is not None:
        write(show_results(ask(a.query), a.query))
        return 0
    while True:
        try:
            line = read("Query> ").strip()
        except (EOFError, KeyboardInterrupt):
            return 0
        if line.lower() in ("quit", "exit", "q"):
            return 0
        if line.lower() in ("help", "?"):
            write(HELP)
        elif line.lower() == "stats":
            write(stats())
        elif line:
            write(show_results(ask(line), line))


if __name__ == "__main__":
    sys.exit(main())
