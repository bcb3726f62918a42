"""The pN_ queries: each takes (spark, folder) and runs over the whole of its tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import shared_dir
from . import bpe, distinctive, history, language, neighbours, packing, quality, repeated, styletree, termstats


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return repeated.repeated_lines(_t(spark, d, "documents").select("doc_id", "text", "source")).select("doc_id", "line_no")


def p1_clean(spark, d):
    out = repeated.without_repeated_lines(_t(spark, d, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "text")


def p2_found(spark, d):
    s = distinctive.term_scores(_t(spark, d, "postings"), _t(spark, d, "indexed_corpus"))
    return distinctive.top_terms(s).select("doc_idx", "term")


def p2_scores(spark, d):
    s = distinctive.term_scores(_t(spark, d, "postings"), _t(spark, d, "indexed_corpus"))
    return s.select("doc_idx", "term", "tf", "df", "weight", F.round("elite", 6).alias("elite"))


def p2_weights(spark, d):
    """What p2_scores has besides the posterior."""
    return p2_scores(spark, d).drop("elite")


def p3_found(spark, d):
    return styletree.boilerplate_lines(_t(spark, d, "crawled_docs"))


def p3_articles(spark, d):
    return styletree.article_text(_t(spark, d, "crawled_docs"))


def p4_found(spark, d):
    return neighbours.alike_pairs(_t(spark, d, "vectors"))


def p4_neighbours(spark, d):
    out = neighbours.most_alike(_t(spark, d, "vectors"))
    return out.select("doc_id", "other", F.round("cosine", 6).alias("cosine"))


def p5_found(spark, d):
    return history.repeats(_t(spark, d, "accepted_docs"), _t(spark, d, "incoming_docs"))


def p5_new(spark, d):
    return history.new_items(_t(spark, d, "accepted_docs"), _t(spark, d, "incoming_docs")).select("item_id", "batch_no")


def p5_batches(spark, d):
    """The same rows as p5_found, one batch after the other against a history that each is appended to."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    return history.repeats_by_batch(_t(spark, d, "accepted_docs"), _t(spark, d, "incoming_docs"), path)


def p6_found(spark, d):
    m = termstats.marked_vocabulary(_t(spark, d, "vocabulary"), _t(spark, d, "postings"), _t(spark, d, "indexed_corpus"))
    return m.where(F.col("mark").isNotNull()).select("term", "mark")


def p6_counts(spark, d):
    return termstats.marked_vocabulary(_t(spark, d, "vocabulary"), _t(spark, d, "postings"), _t(spark, d, "indexed_corpus"))


def p8_ids(spark, d):
    return bpe.encode_texts(_t(spark, d, "documents"))


def p9_bins(spark, d):
    return packing.pack_items(bpe.count_tokens(_t(spark, d, "documents")))


def _common(spark, d) -> list[str]:
    """The fixed table of common words; its size is checked where it is used."""
    return sorted({r[0] for r in _t(spark, d, "common_words").select("word").where("word is not null").distinct().limit(quality.MOST_COMMON_WORDS + 1).collect()})


def p7_found(spark, d):
    docs = _t(spark, d, "documents")
    model = language.train(_t(spark, d, "lang_samples"))
    kinds = quality.text_kinds(docs, _common(spark, d))
    return language.wrong_labels(docs, model, kinds).select("doc_id", "block_no", "lang")


def p7_segments(spark, d):
    """The stretches of one language in each block."""
    s = language.segment_languages(_t(spark, d, "documents"), language.train(_t(spark, d, "lang_samples")))
    return s.withColumn("confidence", F.round("confidence", 6))


def p7_documents(spark, d):
    return language.document_languages(_t(spark, d, "documents"), language.train(_t(spark, d, "lang_samples")))


def p10_kinds(spark, d):
    return quality.text_kinds(_t(spark, d, "documents"), _common(spark, d))


def p10_found(spark, d):
    return p10_kinds(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_scores, p2_weights, p3_found, p3_articles, p4_found, p4_neighbours, p5_found, p5_new, p5_batches, p6_found, p6_counts, p7_found, p7_segments, p7_documents, p8_ids, p9_bins, p10_found, p10_kinds)}

_CLEAN = """live AS (SELECT DISTINCT doc_idx FROM indexed_corpus WHERE regexp_matches(processed_text, '[^\\s\\p{Z}]') AND doc_idx IS NOT NULL),
po AS (SELECT DISTINCT lower(nfc_normalize(regexp_replace(term, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))) AS term, doc_idx, tf FROM postings WHERE tf IS NOT NULL),
p AS (SELECT term, doc_idx, CAST(sum(tf) AS BIGINT) AS tf FROM po WHERE term <> '' AND doc_idx IN (SELECT doc_idx FROM live) GROUP BY term, doc_idx),
n AS (SELECT count(*) AS n FROM live),
f AS (SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM p GROUP BY term)"""
_MARK = f"""WITH {_CLEAN}, v AS (SELECT DISTINCT lower(nfc_normalize(regexp_replace(term, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))) AS term FROM vocabulary),
m AS (SELECT v.term, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records,
CASE WHEN coalesce(records, 0) < 3 THEN 'rare' WHEN records > n * 0.5 THEN 'common' END AS mark FROM v LEFT JOIN f ON v.term = f.term CROSS JOIN n WHERE v.term <> '')"""

_LINES = """l AS (SELECT doc_id, lower(regexp_replace(regexp_replace(source, '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g')) AS s, unnest(range(len(string_split(text, chr(10))))) AS line_no,
unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, s, line_no, raw, trim(regexp_replace(regexp_replace(lower(nfc_normalize(raw)), '[0-9]+', '0', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS x FROM l),
c AS (SELECT s, x FROM k WHERE x <> '' AND s IS NOT NULL GROUP BY s, x HAVING count(DISTINCT doc_id) >= 6)"""

_UNITS = """e AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT DISTINCT doc_id, embedding AS v FROM vectors WHERE doc_id IS NOT NULL AND len(embedding) = 64 AND list_count(embedding) = 64)),
u AS (SELECT doc_id, list_transform(v, lambda x: x / n) AS v FROM e WHERE n > 0),
c AS (SELECT a.doc_id, b.doc_id AS other, max(least(list_dot_product(a.v, b.v), 1.0)) AS cosine FROM u a JOIN u b ON a.doc_id <> b.doc_id GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, other) AS r FROM c)"""

# What page a url names, step by step.
_PAGE = r"""u0 AS (SELECT item_id, regexp_replace(url, '^\s+|\s+$', '', 'g') AS u FROM (SELECT item_id, url FROM accepted_docs UNION ALL SELECT item_id, url FROM incoming_docs)),
u1 AS (SELECT item_id, u, regexp_matches(u, '^(?i)https?://') AS web, lower(regexp_extract(u, '^(\w+):', 1)) AS scheme, regexp_extract(u, '^\w+://([^/?#]*)', 1) AS place,
 regexp_replace(regexp_extract(u, '^\w+://[^/?#]*([^?#]*)', 1), '/$', '') AS path,
 array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid)(=.*)?$')), '&') AS query FROM u0 WHERE u <> ''),
page AS (SELECT item_id, CASE WHEN NOT web THEN u ELSE regexp_replace(lower(regexp_replace(place, CASE scheme WHEN 'http' THEN ':80$' ELSE ':443$' END, '')), '^www\.', '') || path || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS page FROM u1)"""
#: Pairs that may repeat, and then the incoming items one after the other: one is new if it meets no accepted item and none that's new.
_REPEATS = rf"""WITH RECURSIVE {_PAGE},
it AS (SELECT item_id, doc_id, text, 0 AS place FROM accepted_docs UNION ALL SELECT item_id, doc_id, text, row_number() OVER (ORDER BY batch_no NULLS LAST, item_id) FROM incoming_docs),
w AS (SELECT item_id, place, regexp_extract_all(lower(nfc_normalize(text)), '[\p{{L}}\p{{N}}]+') AS w FROM it WHERE text IS NOT NULL),
g AS (SELECT item_id, place, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
x AS (SELECT item_id, place, len(g) AS n, unnest(g) AS s FROM g),
j AS (SELECT a.item_id AS a, b.item_id AS b FROM x a JOIN x b ON a.s = b.s AND a.place < b.place GROUP BY a.item_id, b.item_id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9),
m AS (SELECT a, b FROM j UNION SELECT a.item_id, b.item_id FROM it a JOIN it b ON a.doc_id = b.doc_id AND a.doc_id <> '' AND a.place < b.place
 UNION SELECT p.item_id, q.item_id FROM page p JOIN it a ON a.item_id = p.item_id JOIN page q ON p.page = q.page JOIN it b ON b.item_id = q.item_id WHERE a.place < b.place),
pl AS (SELECT m.a, m.b, ia.place AS pa, ib.place AS pb FROM m JOIN it ia ON ia.item_id = m.a JOIN it ib ON ib.item_id = m.b),
mb AS (SELECT pb, list(pa) AS before FROM pl GROUP BY pb),
st AS (SELECT 0::BIGINT AS n, [0]::BIGINT[] AS held UNION ALL
 SELECT n + 1, CASE WHEN (SELECT list_has_any(before, held) FROM mb WHERE pb = n + 1) THEN held ELSE list_append(held, n + 1) END FROM st WHERE n < (SELECT count(*) FROM incoming_docs)),
fin AS (SELECT held FROM st ORDER BY n DESC LIMIT 1)"""

SQL = {
    "p1_found": f"WITH {_LINES} SELECT doc_id, line_no FROM k JOIN c ON k.s = c.s AND k.x = c.x",
    "p1_clean": f"""WITH {_LINES}, kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM k LEFT JOIN c ON k.s = c.s AND k.x = c.x WHERE c.x IS NULL GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "p2_found": f"""WITH {_CLEAN}, w AS (SELECT doc_idx, p.term, round(tf * (ln((1.0 + n) / (1 + records)) + 1), 6) AS weight FROM p JOIN f ON p.term = f.term CROSS JOIN n)
SELECT doc_idx, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_idx ORDER BY weight DESC, term) AS r FROM w) WHERE r = 1""",
    "p2_weights": f"""WITH {_CLEAN} SELECT doc_idx, p.term, tf, records AS df, round(tf * (ln((1.0 + n) / (1 + records)) + 1), 6) AS weight FROM p JOIN f ON p.term = f.term CROSS JOIN n""",
    "p4_found": f"WITH {_UNITS} SELECT DISTINCT least(doc_id, other) AS doc_a, greatest(doc_id, other) AS doc_b FROM k WHERE r <= 5 AND cosine >= 0.9",
    "p5_found": f"{_REPEATS} SELECT DISTINCT a AS item_a, b AS item_b FROM pl CROSS JOIN fin WHERE list_contains(held, pa)",
    "p5_batches": f"{_REPEATS} SELECT DISTINCT a AS item_a, b AS item_b FROM pl CROSS JOIN fin WHERE list_contains(held, pa)",
    "p5_new": f"{_REPEATS} SELECT item_id, batch_no FROM incoming_docs WHERE item_id NOT IN (SELECT b FROM pl CROSS JOIN fin WHERE list_contains(held, pa))",
    "p6_found": f"{_MARK} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p6_counts": f"{_MARK} SELECT term, occurrences, records, mark FROM m",
}
