"""SQL that gives the same rows as ``queries`` on the same tables. Where SQL can't express a query there's none."""

from __future__ import annotations

from ..operators.preprocess import stop_words
from .queries import PAGES, SLIPS, TEXTS, URLS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(_q(x) if isinstance(x, str) else str(x) for x in r) + ')' for r in rows)}) AS v({names})"


_N = r"trim(regexp_replace(nfc_normalize(lower(text)), '[^\p{L}\p{N}_]+', ' ', 'g'))"
NORM = f"nm AS (SELECT doc_id, url, {_N} AS norm FROM documents WHERE text IS NOT NULL)"
TOK = f"{NORM}, tok AS (SELECT doc_id, url, unnest(range(len(string_split(norm, ' ')))) AS pos, unnest(string_split(norm, ' ')) AS term FROM nm WHERE norm <> ''), t AS (SELECT * FROM tok WHERE length(term) BETWEEN 2 AND 20)"
TF = f"{TOK}, tf AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term)"
IDX = f"{TF}, cor AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM (SELECT DISTINCT doc_id FROM tf))"
W = f"{IDX}, idf AS (SELECT term, term_idx, df, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM voc CROSS JOIN n), w AS (SELECT doc_id, tf.term, term_idx, tf, tf * idf AS weight FROM tf JOIN idf ON tf.term = idf.term)"
_QT = _values(TEXTS, "query_id, text")
QUERY = f"qn AS (SELECT query_id, {_N} AS norm FROM {_QT}), qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(string_split(norm, ' ')) AS term FROM qn WHERE norm <> '') WHERE length(term) BETWEEN 2 AND 20 GROUP BY query_id, term)"
RANK = f"""{W}, {QUERY}, qw AS (SELECT query_id, qt.term, qt.tf * idf AS weight FROM qt JOIN idf ON qt.term = idf.term),
nd AS (SELECT doc_id, sqrt(sum(weight * weight)) AS nd FROM w GROUP BY doc_id), nq AS (SELECT query_id, sqrt(sum(weight * weight)) AS nq FROM qw GROUP BY query_id),
s AS (SELECT qw.query_id, w.doc_id, round(sum(qw.weight * w.weight) / (any_value(nd) * any_value(nq)), 6) AS score FROM qw JOIN w ON qw.term = w.term JOIN nd ON nd.doc_id = w.doc_id JOIN nq ON nq.query_id = qw.query_id GROUP BY qw.query_id, w.doc_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)"""
WORDS = f"{TOK}, words AS (SELECT term AS word, min((doc_id, pos)) AS pos, any_value(regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g')) AS w FROM t GROUP BY term), cand AS (SELECT token, word, levenshtein(token, w) AS distance FROM {_values([(s,) for s in SLIPS], 'token')} CROSS JOIN words WHERE abs(length(token) - length(w)) <= 2 AND levenshtein(token, w) <= 2)"
#: levenshtein counts bytes; the slips are ASCII, so any other letter may stand as one byte that they don't have.
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_H = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_P = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_MAYO = rf"regexp_matches({_P}, '^(/es)?/(diseases-conditions|symptoms|tests-procedures|drugs-supplements|healthy-lifestyle)/')"
_MED = rf"(regexp_matches({_P}, '^/[^/]*\.html$') OR regexp_matches({_P}, '^/spanish/.*\.html$') OR regexp_matches({_P}, '^/ency/article/'))"
_NHS = rf"regexp_matches({_P}, '^/(conditions|medicines|live-well|mental-health)/')"
_V_URLS = f"(SELECT DISTINCT url FROM (SELECT url FROM documents UNION ALL SELECT url FROM crawled_docs UNION ALL SELECT url FROM {_values([(u,) for u in URLS], 'url')}) WHERE url IS NOT NULL)"
_OLD = "url LIKE '%/es/%'"
_M = lambda k: f"coalesce(metadata['{k}'], '') AS {k}"
_KEY = r"lower(regexp_replace(regexp_replace(source, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'))"
_STRIP = lambda c: rf"regexp_replace({c}, '^[\s\x0b\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\x0b\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g')"
#: The pages that are made of documents, as they're scraped.
_PAGE = rf"""pg AS (SELECT 'https://www.nhs.uk/conditions/' || doc_id || '/' AS url, {_STRIP("coalesce(title, '')")} AS title, {_STRIP("regexp_replace(coalesce(published, ''), '[<>\"&]', '', 'g')")} AS date,
lower(regexp_extract(regexp_replace(coalesce(lang, ''), '[<>\"&]', '', 'g'), '^[^-]*')) AS lang,
array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {_STRIP('p')}), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL),
ok AS (SELECT *, title <> '' AND length(text) >= 50 AS ok FROM pg)"""
_UUID = lambda h: f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || substr('89ab', CAST(('0x' || {h}[17:17]) AS INTEGER) % 4 + 1, 1) || {h}[18:20] || '-' || {h}[21:32]"
_UPSERT = "up AS (SELECT doc_id, text, url FROM (SELECT 0 AS s, item_id, doc_id, text, url FROM accepted_docs UNION ALL SELECT 1, item_id, doc_id, text, url FROM incoming_docs) WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id DESC) = 1)"
_FILES = """fs AS (SELECT source AS doc_id, host || chr(10) || main_lang AS text, source || '.txt' AS file, source || '.txt' AS path, main_lang FROM sites
UNION ALL SELECT source || '-md', '# ' || host, source || '-md.md', main_lang || '/' || source || '-md.md', main_lang FROM sites
UNION ALL SELECT source || '-page', source || chr(10) || host, source || '-page.html', main_lang || '/' || source || '-page.html', main_lang FROM sites)"""
_EXT = "ex AS (SELECT doc_id || '.v1_p' || length(text) AS id, * FROM crawled_docs WHERE text IS NOT NULL AND metadata IS NOT NULL AND url IS NOT NULL)"
_CELL = lambda c: rf"'{c}: ' || coalesce(regexp_replace(CAST({c} AS VARCHAR), '[\x00-\x1F]', ' ', 'g'), '')"
_ROWS = f"SELECT {' || chr(10) || '.join(_CELL(c) for c in ('doc_id', 'lang', 'source', 'title', 'url', 'category'))} AS text, true AS named FROM documents"
_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url))"


def sql() -> dict[str, str]:
    stop = ", ".join(_q(w) for w in stop_words("spanish"))
    upd = f"""{TF}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM (SELECT DISTINCT doc_id FROM t WHERE {_OLD})),
f AS (SELECT doc_id, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM (SELECT DISTINCT doc_id FROM t WHERE url IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM o))),
u AS (SELECT * FROM o UNION ALL SELECT * FROM f)"""
    rem = f"{TOK}, l AS (SELECT * FROM t WHERE url IS NULL OR url NOT LIKE '%/en/%')"
    return {
        "doc_normalize": f"WITH {NORM} SELECT doc_id, norm FROM nm",
        "doc_tokens": f"WITH {TOK} SELECT doc_id, pos, term AS token FROM tok",
        "doc_token_filter": f"WITH {TOK} SELECT doc_id, count(*) AS n_tokens FROM t GROUP BY doc_id",
        "stopword_filter": f"WITH {TOK} SELECT doc_id, count(*) AS n_tokens FROM t WHERE term NOT IN ({stop}) GROUP BY doc_id",
        "strip_accents": "SELECT lang, word, strip_accents(word) AS bare FROM common_words",
        "lemma_counts": f"WITH {TOK}, l AS (SELECT * FROM (VALUES ('los', 'el'), ('las', 'la'), ('una', 'un'), ('die', 'der'), ('das', 'der'), ('les', 'le'), ('os', 'o')) AS v(a, b)) SELECT coalesce(b, term) AS token, count(*) AS n FROM t LEFT JOIN l ON term = a GROUP BY 1",
        "term_frequency": f"WITH {TF} SELECT term, doc_id, tf FROM tf",
        "document_frequency": f"WITH {TF} SELECT term, df FROM voc",
        "corpus_frequency": f"WITH {TF} SELECT term, cf FROM voc",
        "vocabulary": f"WITH {TF} SELECT term, term_idx, df, cf FROM voc",
        "inverted_index_stats": f"WITH {IDX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, min(doc_idx) AS first_doc, max(doc_idx) AS last_doc FROM tf JOIN cor ON tf.doc_id = cor.doc_id GROUP BY term",
        "min_doc_length": f"WITH {TOK} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM (SELECT doc_id FROM t GROUP BY doc_id HAVING count(*) >= 100)",
        "min_term_frequency": f"WITH {TF} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx, cf FROM voc WHERE cf >= 5",
        "corpus_stats": f"WITH {TF} SELECT n AS n_documents, (SELECT count(*) FROM voc) AS n_terms, (SELECT CAST(sum(tf) AS BIGINT) FROM tf) AS total_tokens, round((SELECT sum(tf) FROM tf) / n, 6) AS avg_tokens_per_doc, round((SELECT count(*) FROM tf) / (SELECT count(*) FROM voc), 6) AS avg_postings_per_term FROM n",
        "index_update": f"WITH {upd} SELECT doc_idx, doc_id FROM u",
        "index_update_stats": f"WITH {upd}, x AS (SELECT tf.* FROM tf JOIN u ON tf.doc_id = u.doc_id) SELECT count(DISTINCT doc_id) AS n_documents, count(DISTINCT term) AS n_terms, CAST(sum(tf) AS BIGINT) AS total_tokens FROM x",
        "index_remove": f"WITH {rem} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM (SELECT DISTINCT doc_id FROM l)",
        "index_remove_terms": f"WITH {rem} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx, count(DISTINCT doc_id) AS df, count(*) AS cf FROM l GROUP BY term",
        "idf": f"WITH {W} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "tfidf_weights": f"WITH {W} SELECT doc_idx, term_idx, tf, round(weight, 6) AS weight FROM w JOIN cor ON w.doc_id = cor.doc_id",
        "tfidf_top_terms": f"WITH {W}, x AS (SELECT doc_idx, term, round(weight, 6) AS weight FROM w JOIN cor ON w.doc_id = cor.doc_id) SELECT * FROM (SELECT doc_idx, CAST(row_number() OVER (PARTITION BY doc_idx ORDER BY weight DESC, term) AS INTEGER) AS rank, term, weight FROM x) WHERE rank <= 3",
        "query_vector": f"WITH {W}, {QUERY} SELECT query_id, qt.term, round(qt.tf * idf, 6) AS weight FROM qt JOIN idf ON qt.term = idf.term",
        "oov_filter": f"WITH {TF}, {QUERY} SELECT query_id, term FROM qt WHERE term NOT IN (SELECT term FROM voc)",
        "tfidf_cosine_topk": f"WITH {RANK} SELECT * FROM r WHERE rank <= 10 AND query_id = 'q1'",
        "multi_query_topk": f"WITH {RANK} SELECT * FROM r WHERE rank <= 10",
        "threshold_after_topk": f"WITH {RANK} SELECT * FROM r WHERE rank <= 10 AND score >= 0.2",
        "late_fetch": f"WITH {RANK} SELECT query_id, rank, d.doc_id, coalesce(d.url, '') AS url, length(text) AS chars FROM r JOIN documents d ON r.doc_id = d.doc_id WHERE rank <= 3",
        "console_results": f"""WITH {RANK} SELECT query_id, CAST(rank AS INTEGER) AS rank, printf('%d. [%.3f] %s | %s | %s', rank, score, coalesce(d.title, CAST(d.doc_id AS VARCHAR)), CASE WHEN coalesce(d.url, '') = '' THEN '(no url)' ELSE d.url END, replace(left(text, 120), chr(10), ' ') || '...') AS line FROM r JOIN documents d ON r.doc_id = d.doc_id WHERE rank <= 3""",
        "overlap_topk": rf"""WITH q AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '^[.,;:!?"''()\[\]{{}}]+|[.,;:!?"''()\[\]{{}}]+$', '', 'g')), lambda w: length(w) >= 3)) AS t FROM {_QT}),
qx AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM q), dx AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '\s+'))) AS token FROM documents WHERE text IS NOT NULL),
s AS (SELECT query_id, doc_id, round(count(*) / any_value(n), 3) AS score FROM qx JOIN dx ON qx.token = dx.token GROUP BY query_id, doc_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) WHERE rank <= 5 AND score > 0""",
        "spell_candidates": f"WITH {WORDS} SELECT token, word, distance FROM cand",
        "spell_correct": f"WITH {WORDS}, b AS (SELECT token, min((distance, word)) AS b FROM cand GROUP BY token) SELECT v.token AS given, coalesce(b.b[2], v.token) AS token FROM {_values([(s,) for s in SLIPS], 'token')} LEFT JOIN b ON v.token = b.token",
        "embedding_cosine_topk": f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s) WHERE rank <= 5",
        "embedding_score_clamp": f"SELECT a.vec_id, round(greatest(0.0, least(1.0, {_COS})), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "fetch_by_ids": "SELECT pos, d.doc_id, url FROM (VALUES (0, 7), (1, -1), (2, 2), (3, 12), (4, 2)) AS v(pos, id) JOIN documents d ON d.doc_id = v.id",
        "url_parts": f"SELECT doc_id, {_H} AS host, {_P} AS path FROM documents WHERE url LIKE 'http%'",
        "url_predicates": f"SELECT url, {_MAYO} AS mayo_clinic, {_MED} AS medlineplus, {_NHS} AS nhs, contains(url, 'nhs.uk') AS in_nhs FROM {_V_URLS}",
        "url_route": f"SELECT url, CASE WHEN {_MAYO} THEN 'mayo_clinic' WHEN {_MED} THEN 'medlineplus' WHEN {_NHS} THEN 'nhs' END AS source FROM {_V_URLS}",
        "url_category": rf"""SELECT url, CASE WHEN {_P} LIKE '%diseases-conditions%' THEN 'disease' WHEN {_P} LIKE '%symptoms%' THEN 'symptom' WHEN {_P} LIKE '%tests-procedures%' THEN 'procedure' WHEN {_P} LIKE '%drugs-supplements%' THEN 'drug' WHEN {_P} LIKE '%healthy-lifestyle%' THEN 'wellness' ELSE '' END AS mayo_clinic,
CASE WHEN {_P} LIKE '/ency/article/%' THEN 'reference' WHEN {_P} LIKE '%.html' THEN 'health-topic' ELSE '' END AS medlineplus,
CASE WHEN {_P} LIKE '%/conditions/%' THEN 'disease' WHEN {_P} LIKE '%/medicines/%' THEN 'drug' WHEN {_P} LIKE '%/live-well/%' THEN 'wellness' WHEN {_P} LIKE '%/mental-health/%' THEN 'mental-health' ELSE '' END AS nhs FROM {_V_URLS}""",
        "page_doc_id": f"""WITH h AS (SELECT DISTINCT url, {_SHA} AS h FROM crawled_docs WHERE url IS NOT NULL),
s AS (SELECT url, h[1:12] || '5' || h[14:16] || substr('89ab', CAST(('0x' || h[17:17]) AS INTEGER) % 4 + 1, 1) || h[18:32] AS s FROM h) SELECT url, s[1:8] || '-' || s[9:12] || '-' || s[13:16] || '-' || s[17:20] || '-' || s[21:32] AS id FROM s""",
        "page_language": f"WITH {_PAGE} SELECT url, CASE WHEN lang = '' THEN 'en' ELSE lang END AS lang FROM pg UNION ALL " + rf"""SELECT url, CASE WHEN l = '' THEN 'en' ELSE lower(l) END AS lang FROM (SELECT url, regexp_extract(html, '<html[^>]*\blang="([^"\-]*)', 1) AS l FROM {_values(PAGES, 'url, html')})""",
        "robots_filter": f"SELECT url FROM {_V_URLS} WHERE NOT (({_H} IN (SELECT host FROM sites WHERE host <> 'www.salud-norte.example') OR {_H} = 'www.nhs.uk') AND ({_P} LIKE '/es/%' OR {_P} LIKE '/live-well/%'))",
        "sitemap_scan": f"SELECT {_H} AS root, url AS loc FROM documents WHERE url LIKE 'http%'",
        "crawl_report": "SELECT count(*) AS visited, count(*) FILTER (trim(coalesce(text, '')) <> '') AS successful, count(*) FILTER (trim(coalesce(text, '')) = '') AS failed, count(*) FILTER (trim(coalesce(text, '')) <> '') AS saved, CAST(0 AS BIGINT) AS n_errors, round(count(*) FILTER (trim(coalesce(text, '')) <> '') / count(*), 6) AS success_rate FROM crawled_docs",
        "crawl_queue": f"SELECT {_H} AS source, count(*) AS queued FROM crawled_docs GROUP BY 1",
        "request_gaps": f"""WITH p AS (SELECT DISTINCT url, crawled_at AS ts FROM crawled_docs WHERE url IS NOT NULL), g AS (SELECT {_H} AS host, epoch_us(ts) / 1000000 - lag(epoch_us(ts) / 1000000) OVER (PARTITION BY {_H} ORDER BY ts, url) AS gap FROM p) SELECT host, count(gap) AS n, max(gap) AS longest FROM g GROUP BY host""",
        "doc_key": r"SELECT DISTINCT doc_id AS id, doc_id AS id_key, left(sha256(url), 32) AS url_key FROM crawled_docs WHERE url IS NOT NULL",
        "dedupe_docs": "SELECT doc_id, min(item_id) AS item_id FROM incoming_docs WHERE doc_id IS NOT NULL GROUP BY doc_id",
        "snippet": "SELECT doc_id, replace(left(text, 120), chr(10), ' ') || '...' AS snippet FROM documents WHERE text IS NOT NULL",
        "source_partition": r"SELECT lower(regexp_replace(regexp_replace(source, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g')) AS part, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1",
        "metadata_fields": f"SELECT DISTINCT doc_id, {', '.join(_M(k) for k in ('title', 'source', 'language', 'date', 'category'))} FROM crawled_docs",
        "metadata_rest": f"WITH {_EXT}, x AS (SELECT id, unnest(map_entries(metadata)) AS e FROM ex) SELECT DISTINCT id AS doc_id, e.key AS k, e.value AS v FROM x WHERE e.key NOT IN ('source', 'url', 'page') UNION SELECT id, 'page', CAST(length(text) AS VARCHAR) FROM ex",
        "new_minus_indexed": "SELECT DISTINCT doc_id FROM incoming_docs WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM accepted_docs WHERE doc_id IS NOT NULL)",
        "bag_union": "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, text FROM accepted_docs UNION ALL SELECT doc_id, text FROM incoming_docs) WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id",
        "jsonl_roundtrip": "SELECT doc_id, md5(text) AS h, coalesce(url, '') AS url, CAST(coalesce(cardinality(metadata), 0) AS BIGINT) AS n FROM crawled_docs WHERE text IS NOT NULL AND doc_id IS NOT NULL",
        "index_snapshot_roundtrip": f"WITH {TF} SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens FROM tf GROUP BY doc_id",
        "stored_postings": "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT DISTINCT * FROM postings) GROUP BY term",
        "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
        "page_scrape": f"WITH {_PAGE}, hs AS (SELECT *, {_SHA} AS h FROM ok) SELECT {_UUID('h')} AS doc_id, url, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, CASE WHEN ok THEN 'nhs' END AS source, CASE WHEN ok THEN CASE WHEN lang = '' THEN 'en' ELSE lang END END AS language, CASE WHEN ok THEN date END AS date, CASE WHEN ok THEN 'disease' END AS category FROM hs",
        "page_title": f"WITH {_PAGE} SELECT url, title FROM ok WHERE ok",
        "page_paragraphs": f"WITH {_PAGE} SELECT url, text FROM ok WHERE ok",
        "crawl_dedupe": f"SELECT DISTINCT url, CASE WHEN regexp_matches({_P}, '/drug/|/symptom/') THEN 'drugs' ELSE 'all' END AS source FROM documents WHERE url LIKE 'http%' AND (regexp_matches({_P}, '/drug/|/symptom/') OR contains(url, 'example'))",
        "crawl_cap": "SELECT url FROM (SELECT url, min(doc_id) AS p FROM documents WHERE contains(url, 'example') GROUP BY url) ORDER BY p, url LIMIT 100",
        "external_documents": f"WITH {_EXT} SELECT id AS doc_id, url, md5(text) AS h FROM ex",
        "csv_scan": _ROWS,
        "tsv_scan": _ROWS,
        "json_scan": "SELECT CAST(item_id AS VARCHAR) AS doc_id, md5(coalesce(text, '')) AS h, coalesce(url, '') AS url, CAST(coalesce(cardinality(metadata), 0) AS BIGINT) AS n FROM incoming_docs",
        "text_scan": r"SELECT md5(x) AS h, length(x) AS chars FROM (SELECT string_agg(regexp_replace(title, '[\r\n]', ' ', 'g') || chr(10), '' ORDER BY doc_id) AS x FROM documents WHERE title IS NOT NULL GROUP BY coalesce(lang, 'none'))",
        "directory_scan": f"WITH {_FILES} SELECT doc_id, text, file, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS pos FROM fs",
        "directory_format": f"WITH {_FILES} SELECT doc_id, text, file FROM fs WHERE file LIKE '%.html'",
        "directory_pattern": f"WITH {_FILES} SELECT doc_id, text, file FROM fs WHERE file LIKE '%.md' AND main_lang = 'es'",
        "rows_to_documents": "SELECT source AS doc_id, main_lang AS text, host AS url, coalesce(second_lang, 'None') AS second FROM sites",
        "fallback_corpus": "SELECT doc_id, md5(text) AS h FROM accepted_docs",
        "document_upsert": f"WITH {_UPSERT} SELECT doc_id, md5(text) AS h, url FROM up",
        "document_get_many": f"WITH {_UPSERT} SELECT doc_id, md5(text) AS h FROM up WHERE doc_id IN (SELECT doc_id FROM crawled_docs UNION SELECT doc_id FROM accepted_docs)",
        "document_delete": "SELECT source AS doc_id, host AS text, '[True, False, False, True]' AS done FROM sites WHERE source <> 'salud_norte'",
        "point_lookup": f"WITH {_UPSERT} SELECT doc_id, md5(text) AS h FROM up WHERE doc_id IN (SELECT min(doc_id) FROM accepted_docs UNION ALL SELECT max(doc_id) FROM accepted_docs)",
        "raw_partition": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL AND (source IS NULL OR {_KEY} IN ('salud_norte', 'clinica_abierta', 'unknown'))",
        "vector_store": "SELECT doc_id, round(embedding[1], 9) AS first, CAST(64 AS BIGINT) AS n FROM vectors WHERE len(embedding) = 64 AND doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY embedding[1] DESC) = 1",
        "model_roundtrip": f"WITH {W} SELECT term, round(idf, 6) AS idf, n AS n_docs FROM idf CROSS JOIN n",
        "manifest": f"WITH {TF} SELECT '1.0' AS schema_version, n AS n_documents, (SELECT count(*) FROM voc) AS n_terms FROM n",
        "indexed_ids": f"WITH {TF} SELECT DISTINCT doc_id FROM tf",
        "words_roundtrip": f"WITH {TOK} SELECT word, CAST(min(saved) AS BIGINT) AS saved FROM (SELECT word, 0 AS saved FROM common_words UNION ALL SELECT DISTINCT term, 1 FROM t) GROUP BY word",
        "spell_known": f"WITH {TOK} SELECT lang, word AS token FROM common_words WHERE word IN (SELECT term FROM t)",
        "spell_words": f"WITH {TOK} SELECT DISTINCT term AS word FROM t",
        "spell_correct_insertion": f"""WITH {WORDS}, pre AS (SELECT left(word, n) AS prefix, min(pos) AS first FROM (SELECT word, pos, unnest(range(1, length(word) + 1)) AS n FROM words) GROUP BY 1),
cp AS (SELECT token, word, distance, unnest(range(1, length(word) + 1)) AS n FROM cand), pa AS (SELECT token, word, distance, list(first ORDER BY n) AS path FROM cp JOIN pre ON prefix = left(word, n) GROUP BY token, word, distance)
SELECT token, word AS correction, distance FROM pa QUALIFY row_number() OVER (PARTITION BY token ORDER BY distance, path, word) = 1""",
        "console_stats": f"""WITH {TF}, s AS (SELECT n AS d, (SELECT count(*) FROM voc) AS v, (SELECT CAST(sum(tf) AS BIGINT) FROM tf) AS k, (SELECT count(*) FROM tf) AS p FROM n)
SELECT unnest(['n_documents', 'n_terms', 'total_tokens', 'avg_tokens_per_doc', 'avg_postings_per_term']) AS name, unnest([printf('  %-25s: %d', 'n_documents', d), printf('  %-25s: %d', 'n_terms', v), printf('  %-25s: %d', 'total_tokens', k), printf('  %-25s: %.2f', 'avg_tokens_per_doc', k / d), printf('  %-25s: %.2f', 'avg_postings_per_term', p / v)]) AS line FROM s""",
        "stream_ingest": "SELECT doc_id, md5(text) AS h FROM accepted_docs WHERE text IS NOT NULL",
        "lsi_self_projection": f"WITH {TOK} SELECT DISTINCT doc_id, CAST(1.0 AS DOUBLE) AS self FROM t",
    }
