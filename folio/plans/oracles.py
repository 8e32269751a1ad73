"""SQL for DuckDB that gives the rows of the registered queries, from the same tables."""

from __future__ import annotations

PATH = "'/kb/' || source || '/' || lang || '/' || doc_id || '.md'"
NL = "chr(10)"
WORDS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]"
ASKED = "s[1] || ' ' || s[2] || '-' || s[3]"
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F\x{80}-\x{9F}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _preview(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


#: Where keyword queries come from: all benchmark passages; for hybrid search the documents divisible by 20.
PASSAGES = f"asked AS (SELECT item_id AS query_id, {ASKED} AS q FROM (SELECT item_id, string_split(text, ' ') AS s FROM benchmark))"
TWENTIETH = f"asked AS (SELECT doc_id AS query_id, {ASKED} AS q FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents WHERE doc_id % 20 = 0))"
#: Named parts of WITH: tokens, query phrases, hits and BM25 scores; ranks of all queries.
BM25 = f"""
tok AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p, len(w) AS dl FROM tok),
term AS (SELECT query_id, unnest(regexp_split_to_array(q, '\\s+')) AS t, generate_subscripts(regexp_split_to_array(q, '\\s+'), 1) AS phrase FROM asked),
ph AS (SELECT query_id, phrase, {WORDS.format("t")} AS ws FROM term),
np AS (SELECT query_id, count(*) AS n_phrases FROM ph WHERE len(ws) > 0 GROUP BY query_id),
hit AS (
  SELECT query_id, phrase, pos.doc_id, dl, count(*) AS f FROM ph JOIN pos ON ws[1] = pos.term JOIN tok ON tok.doc_id = pos.doc_id
  WHERE len(ws) > 0 AND w[p:p + len(ws) - 1] = ws GROUP BY ALL
),
df AS (SELECT query_id, phrase, count(*) AS n FROM hit GROUP BY ALL),
size AS (SELECT count(*)::DOUBLE AS n_all, sum(len(w))::DOUBLE / count(*) AS avgdl FROM tok),
score AS (
  SELECT query_id, doc_id AS chunk_id,
    round(sum(greatest(ln((n_all - n + 0.5) / (n + 0.5)), 1e-6) * f::DOUBLE * 2.2 / (f::DOUBLE + 1.2 * (0.25 + 0.75 * dl::DOUBLE / avgdl))), 9) AS score
  FROM hit JOIN df USING (query_id, phrase) JOIN np USING (query_id), size GROUP BY query_id, doc_id, n_phrases HAVING count(*) = n_phrases
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM score),
cited AS (
  SELECT query_id, rank, chunk_id, {PATH} AS path, doc_id::VARCHAR AS title, text, score, {PATH} || ' §0' AS citation FROM ranked JOIN documents ON doc_id = chunk_id
)"""
KEYWORD = f"{PASSAGES}, {BM25}"

VECTOR = """
vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT query_id, vec_id AS chunk_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, vq)"""

HYBRID = f"""
{VECTOR},
{TWENTIETH}, {BM25},
v AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM near WHERE score >= 0 AND chunk_id IN (SELECT doc_id FROM documents) AND query_id IN (SELECT query_id FROM asked)
),
legs AS (
  SELECT query_id, chunk_id, rank FROM v WHERE rank <= 10
  UNION ALL SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= 10
),
fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM legs GROUP BY ALL)"""

_USER = f"'Question:' || {NL} || {NL} || q || {NL} || {NL} || 'Context:' || {NL} || {NL}"
_EACH = f"{NL} || 'Source: ' || citation || {NL} || {NL} || text || {NL} || {NL}"
_SOURCES = f"{NL} || 'Sources:' || {NL} || string_agg('  [' || rank || '] ' || citation || {NL}, '' ORDER BY rank)"
_MARKER = r"^\s*(?:[-*+•‣▪]|\d+[.)])\s+"
_LINES = f"list_filter(list_transform(string_split(text, {NL}), lambda x: rtrim(regexp_replace(x, '{_MARKER}', ''), ' ' || chr(9))), lambda x: trim(x) != '')"
_METADATA = f"""
SELECT doc_id AS document_id, 'filename' AS key, doc_id || '.md' AS value FROM documents
UNION ALL SELECT doc_id, 'extension', 'md' FROM documents UNION ALL SELECT doc_id, 'mime', 'text/markdown' FROM documents
UNION ALL SELECT doc_id, 'dir', '/kb/' || source || '/' || lang FROM documents
UNION ALL SELECT doc_id, 'lang', lang FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents
UNION ALL SELECT doc_id, 'quality', quality::VARCHAR FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels"""

# The chunker's rule on a text of as many ASCII characters as the original has bytes, where '~' stands for all but the first byte of a character.
_SNAP = "{0} - CASE WHEN substr(m, {0} + 1, 1) != '~' THEN 0 WHEN substr(m, {0}, 1) != '~' THEN 1 WHEN substr(m, {0} - 1, 1) != '~' THEN 2 ELSE 3 END"
_LAST = "CASE WHEN contains({w}, {s}) THEN length({w}) - strpos(reverse({w}), reverse({s})) + 1 ELSE 0 END"
_ENDS = ", ".join(_LAST.format(w="w", s=s) for s in ("'. '", f"{NL} || {NL}", "'! '", "'? '"))
CHUNKS = f"""
masked AS (
  SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(replace(text, '~', 'x'), '[\\x{{80}}-\\x{{7FF}}]', 'x~', 'g'), '[\\x{{800}}-\\x{{FFFF}}]', 'x~~', 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', 'x~~~', 'g') AS m
  FROM documents WHERE NOT regexp_full_match(text, '{BLANK}*')
),
cut AS (
  SELECT doc_id, 0 AS i, 0::BIGINT AS a, NULL::BIGINT AS b, m FROM masked
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN again > a THEN again ELSE e END, e, m FROM (
    SELECT *, {_SNAP.format("(e - 200)")} AS again FROM (
      SELECT doc_id, i, a, m, {_SNAP.format("(CASE WHEN top > 0 THEN a + top ELSE a + 1600 END)")} AS e FROM (
        SELECT doc_id, i, a, m, greatest({_ENDS}) AS top FROM (SELECT doc_id, i, a, m, substr(m, a + 1, 1600) AS w FROM cut WHERE a + 1600 < length(m))
      )
    )
  )
),
spans AS (SELECT doc_id, i, a, coalesce(lead(b) OVER (PARTITION BY doc_id ORDER BY i), length(m)) AS b, m FROM cut),
chunk AS (
  SELECT s.doc_id, i, a, s.b, substr(text, length(replace(substr(s.m, 1, a), '~', '')) + 1, length(replace(substr(s.m, a + 1, s.b - a), '~', ''))) AS text FROM spans s JOIN masked USING (doc_id)
)"""
_JSON_ROW = """'{"ChunkID":' || chunk_id || ',"DocumentID":' || chunk_id || ',"Path":' || to_json(path) || ',"Title":' || to_json(title) || ',"ChunkIndex":0,"Text":' || to_json(text) || ',"Score":' || round(score, 6) || ',"Source":"keyword"}'"""
_LINES_OF = f"SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, {NL})) AS line FROM conversations) WHERE line != '' GROUP BY line"

#: The documents after every third was changed and every tenth removed; blank ones have no chunk.
LEFT = """left_docs AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN text || ' and more' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1),
live AS (SELECT * FROM left_docs WHERE regexp_matches(text, '\\S'))"""

ORACLES: dict[str, str] = {
    "chunked": f"WITH RECURSIVE {CHUNKS} SELECT doc_id AS document_id, i::INT AS chunk_index, text, ((b - a) // 4)::INT AS token_count, a::INT AS start_byte, b::INT AS end_byte FROM chunk",
    "chunk_search": f"""WITH RECURSIVE {CHUNKS}, {PASSAGES}, {BM25.replace("FROM documents)", "FROM (SELECT doc_id * 1000000 + i AS doc_id, text FROM chunk))", 1).split("cited AS")[0].rstrip().rstrip(",")}
        SELECT query_id, rank::INT AS rank, (SELECT {PATH} FROM documents d WHERE d.doc_id = chunk_id // 1000000) || ' §' || (chunk_id % 1000000) AS citation, sha256(chunk.text) AS sha256, round(score, 6) AS score
        FROM ranked JOIN chunk ON chunk.doc_id * 1000000 + i = chunk_id WHERE rank <= 5""",
    "search_json": f"WITH {KEYWORD} SELECT query_id, rank::INT AS rank, {_JSON_ROW} AS json FROM cited WHERE rank <= 3",
    "retrieved_context": f"""WITH {HYBRID.replace("rank <= 10", "rank <= 20")}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)
        SELECT query_id, rank::INT AS rank, {PATH} || ' §0' AS citation, round(score, 6) AS score FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 10""",
    "prompt_variables": f"""WITH {KEYWORD}, g AS (SELECT query_id, count(*) AS n, string_agg(citation || ': ' || text || {NL}, '' ORDER BY rank) AS body FROM cited WHERE rank <= 2 GROUP BY query_id)
        SELECT query_id, CASE WHEN n IS NULL THEN 'empty' ELSE 'ready' END AS status, coalesce(n, 0)::INT AS n_chunks, 'In few words.' || {NL} AS system,
          sha256(q || ' (few)' || {NL} || coalesce(body, '') || 'End.' || {NL}) AS user_sha256 FROM asked LEFT JOIN g USING (query_id)""",
    "metadata_layers": """SELECT doc_id AS document_id, 'filename' AS key, doc_id || '.md' AS value FROM documents UNION ALL SELECT doc_id, 'extension', 'md' FROM documents
        UNION ALL SELECT doc_id, 'mime', 'text/markdown' FROM documents UNION ALL SELECT doc_id, 'dir', '/new/kb/' || source || '/' || lang FROM documents UNION ALL SELECT doc_id, 'topic', source FROM documents""",
    "metadata_entries": f"""WITH m AS ({_METADATA}), x AS (SELECT max(doc_id) AS last FROM documents)
        SELECT 'entry' AS what, key, value FROM m, x WHERE document_id = last AND key != 'mime' UNION ALL SELECT 'value', key, value FROM m, x WHERE document_id = last AND key = 'lang'""",
    "document_lookup": f"""WITH RECURSIVE {CHUNKS}, l AS (SELECT doc_id, text FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 1)
        SELECT 'by path' AS what, doc_id AS document_id, 0 AS place FROM l UNION ALL SELECT 'by hash', min(doc_id), 0 FROM documents WHERE text = (SELECT text FROM l)
        UNION ALL SELECT 'chunk', doc_id, i::INT FROM chunk WHERE doc_id = (SELECT doc_id FROM l)""",
    "size_guard": "SELECT '/web/' || page_id || '.txt' AS path, CASE WHEN strlen(html) * 30720 <= 104857600 THEN strlen(html)::INT END AS bytes, strlen(html) * 30720 > 104857600 AS refused FROM pages",
    "plugged_extractor": """WITH f AS (SELECT page_id, url, page_id % 2 = 0 AS marked, CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.bin' ELSE '.txt' END AS ending FROM pages)
        SELECT '/web/' || page_id || ending AS path, CASE ending WHEN '.pdf' THEN 'application/pdf' WHEN '.bin' THEN 'application/octet-stream' ELSE 'text/plain' END AS mime_type,
          CASE WHEN ending = '.txt' THEN CASE WHEN marked THEN '%PDF' ELSE '' END || url WHEN ending = '.pdf' AND marked THEN 'pdf ' || url END AS text,
          CASE WHEN ending = '.bin' THEN 'no extractor for application/octet-stream' WHEN ending = '.pdf' AND NOT marked THEN 'ValueError: no PDF' END AS error FROM f""",
    "folder_files": _LINES_OF,
    "streamed_ingest": _LINES_OF,
    "question_cards": r"""WITH a AS (SELECT conv_id, turn, regexp_split_to_array(text, '\s+') AS w, regexp_replace(text, '\s+', ' ', 'g') AS line FROM conversations WHERE role = 'assistant')
        SELECT conv_id, turn, 0 AS card, 'What is ' || w[1] || '?' AS lead, '(' || w[2] || ')' AS note, line || '.|and more' AS body FROM a
        UNION ALL SELECT conv_id, turn, 1, 'How?', '', 'by ' || w[1] || '.' FROM a""",

    "document_table": f"SELECT doc_id AS document_id, {PATH} AS path, sha256(text) AS sha256, doc_id::VARCHAR AS title, 'text/markdown' AS mime_type, {PATH} || ' §0' AS citation FROM documents",
    "path_parts": """SELECT doc_id, '/kb/' || source || '/' || lang || '/' || doc_id || '.tar.MD' AS path, doc_id || '.tar.MD' AS base, '.MD' AS ext,
        doc_id || '.tar' AS title, '/kb/' || source || '/' || lang AS dir, 'text/markdown' AS mime FROM documents""",
    "text_measures": f"""SELECT doc_id, (strlen(text) // 4)::INT AS tokens, {_preview("text", 120)} AS preview,
        CASE WHEN strlen(text) * 1000 >= 1048576 THEN printf('%.1f MB', strlen(text) * 1000 / 1048576.0)
             WHEN strlen(text) * 1000 >= 1024 THEN printf('%.1f KB', strlen(text) * 1000 / 1024.0) ELSE strlen(text) * 1000 || ' B' END AS size,
        (2 + length(regexp_replace(text, '{CONTROL}', '', 'g')))::INT AS printable, {_strip("(" + _preview("text", 20) + ")")} AS trimmed,
        CASE WHEN strlen(text) = 0 THEN '0%' ELSE ((strlen(text) - length(text)) * 100 // strlen(text)) || '%' END AS multibyte FROM documents""",
    "split_pairs": """SELECT page_id, CASE WHEN contains(pair, '=') THEN split_part(pair, '=', 1) END AS key, CASE WHEN contains(pair, '=') THEN substr(pair, instr(pair, '=') + 1) END AS value
        FROM (SELECT page_id, list_last(string_split(url, '?')) AS pair FROM pages)""",
    "markdown_extraction": f"""WITH a AS (SELECT doc_id, '---' || {NL} || 'lang: ' || lang || {NL} || '---' || {NL} || {NL} || '## Head' || {NL} || '```py' || {NL} || text || {NL} || '```' || {NL} || '**bold** and _it_ `code` a_b_c' || {NL} AS t FROM documents),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?s)^---\\n.*?\\n---\\n?', ''), '(?m)^```[^\\n]*\\n?', '', 'g') AS t FROM a),
        c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '_(.+?)_', '\\1', 'g'), '`(.+?)`', '\\1', 'g') AS t FROM b)
        SELECT doc_id, {_strip("regexp_replace(t, '(?m)^#{1,6}[\\t\\n\\f\\r ]+', '', 'g')")} AS text FROM c""",
    "html_extraction": f"""WITH a AS (SELECT page_id, replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '"</p>"', '"' || chr(1) || '/p>"') AS t FROM pages),
        b AS (SELECT page_id, replace(regexp_replace(t, '<[^>]*>', '', 'g'), chr(1), '<') AS t FROM a)
        SELECT page_id, {_strip("replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")} AS text FROM b""",
    "chunk_coverage": f"""SELECT doc_id AS document_id, 0 AS first, strlen(text)::INT AS last, true AS numbered, true AS gapless, true AS sized FROM documents WHERE NOT regexp_full_match(text, '{BLANK}*')""",
    "term_statistics": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY term",
    "corpus_statistics": f"SELECT count(*) AS chunks, coalesce(sum(len({WORDS.format('text')})), 0)::BIGINT AS words FROM documents",
    "keyword_search": f"WITH {KEYWORD} SELECT query_id, rank::INT AS rank, chunk_id, path, round(score, 6) AS score, 'keyword' AS source FROM cited WHERE rank <= 10",
    "keyword_search_filtered": f"""WITH {KEYWORD}, f AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM score WHERE chunk_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM f WHERE rank <= 5""",
    "vector_search": f"""WITH {VECTOR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score >= 0)
        SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "vector_search_filtered": f"""WITH {VECTOR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near WHERE score >= 0.1 AND label = 1)
        SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "vector_codec": "SELECT vec_id, (4 * len(embedding))::INT AS bytes, true AS same, true AS refused, 1.0::DOUBLE AS cosine FROM embeddings",
    "embedding_dimensions": "SELECT len(embedding)::INT AS dimension, count(*) AS chunks FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1",
    "embedded_texts": f"SELECT doc_id AS chunk_id, 64 AS dimension, CASE WHEN len({WORDS.format('text')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, true AS ok FROM documents",
    "metadata_table": _METADATA,
    "metadata_find": f"SELECT doc_id AS chunk_id, {PATH} AS path, 0 AS chunk_index, length(text)::INT AS chars, 0.0::DOUBLE AS score, 'metadata' AS source FROM documents WHERE lang = 'de' AND source = 'src3'",
    "hybrid_search": f"""WITH {HYBRID}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)
        SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score, 'hybrid' AS source FROM r WHERE rank <= 5""",
    "hybrid_search_least_score": f"""WITH {HYBRID}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused WHERE score >= 0.016)
        SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "token_budget": f"""WITH {KEYWORD}, b AS (SELECT *, sum(strlen(text) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM cited WHERE rank <= 10)
        SELECT query_id, rank::INT AS rank, chunk_id, citation FROM b WHERE rank = 1 OR spent <= 600""",
    "rendered_prompts": f"""WITH {KEYWORD}, g AS (SELECT query_id, count(*) AS n, string_agg({_EACH}, '' ORDER BY rank) AS body, {_SOURCES} AS sources FROM cited WHERE rank <= 3 GROUP BY query_id)
        SELECT query_id, CASE WHEN n IS NULL THEN 'empty' ELSE 'ready' END AS status, coalesce(n, 0)::INT AS n_chunks, sha256({_USER} || coalesce(body, '')) AS user_sha256, coalesce(sources, '') AS sources
        FROM asked LEFT JOIN g USING (query_id)""",
    "answered_prompts": f"""WITH {KEYWORD}, g AS (SELECT query_id, string_agg({NL} || 'Source: ' || citation || {NL} || text || {NL}, '' ORDER BY rank) AS body, {_SOURCES} AS sources FROM cited WHERE rank <= 3 GROUP BY query_id)
        SELECT query_id, CASE WHEN body IS NULL THEN 'error' ELSE 'ready' END AS status,
          length('Question: ' || q || {NL} || {NL} || 'Context:' || {NL} || body || {NL} || {NL} || 'Your reply, 280 characters at most and in note form:' || {NL}) || ' characters' || {NL} || sources AS output, NULL::VARCHAR AS error
        FROM asked LEFT JOIN g USING (query_id)""",
    "repaired_answers": f"SELECT conv_id, turn, CASE WHEN len({_LINES}) > 0 THEN array_to_string({_LINES}, {NL} || {NL}) || {NL} ELSE '' END AS text FROM conversations WHERE role = 'assistant'",
    "first_documents_by_hash": f"""SELECT sha256, document_id, path FROM (SELECT sha256(text) AS sha256, doc_id AS document_id, {PATH} AS path, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1""",
    "chunk_counts": "SELECT doc_id AS document_id, (doc_id IN (SELECT vec_id FROM embeddings))::BIGINT AS chunks FROM documents",
    "kb_stats": """SELECT count(*) AS total_documents, count(*) AS total_chunks, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS embedded_chunks, coalesce(sum(length(text)), 0)::BIGINT AS total_size_bytes,
        (count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) * 100 // count(*)) || '%' AS embedded_percent FROM documents""",
    "document_list": f"SELECT doc_id AS document_id, {PATH} AS path, doc_id::VARCHAR AS title, (doc_id IN (SELECT vec_id FROM embeddings))::BIGINT AS chunks FROM documents",
    "list_json": f"""SELECT doc_id AS document_id, '{{"path":"' || {PATH} || '","title":"' || doc_id || '","chunks":' || (doc_id IN (SELECT vec_id FROM embeddings))::BIGINT || ',"updated_at":"2026-01-01T00:00:00Z"}}' AS json FROM documents""",
    "search_lines": f"""WITH {KEYWORD}, c AS (SELECT *, regexp_replace(text, '{CONTROL}', '', 'g') AS t FROM cited WHERE rank <= 3)
        SELECT query_id, rank::INT AS rank, '[' || rank || '] score=' || printf('%.4f', score) || '  ' || citation || {NL} || '    ' || ({_preview("t", 120)}) AS line FROM c""",
    "health_report": """SELECT 'documents' AS "check", count(*) AS value, true AS ok FROM documents UNION ALL SELECT 'chunks', count(*), true FROM documents
        UNION ALL SELECT 'embedding_dimensions', count(DISTINCT len(embedding)), bool_and(len(embedding) = 64) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'orphan_chunks', 0, true
        UNION ALL SELECT 'orphan_metadata', 2 * count(*), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'orphan_postings', 0, true UNION ALL SELECT 'chunks_not_indexed', 0, true""",
    "repeated_content": f"SELECT sha256(text) AS sha256, count(*) AS n, min({PATH}) AS first_path, max({PATH}) AS last_path FROM documents GROUP BY 1 HAVING count(*) > 1",
    "change_detection": "SELECT lang, CASE lang WHEN 'de' THEN 'changed' WHEN 'fr' THEN 'new' ELSE 'unchanged' END AS change, count(*) AS n FROM documents GROUP BY ALL",
    "replaced_chunks": "SELECT doc_id AS chunk_id, CASE WHEN lang = 'de' AND source != 'src3' THEN sha256('NEW ' || text) ELSE sha256(text) END AS sha256 FROM documents",
    "cascade_delete": f"""WITH m AS ({_METADATA}), fr AS (SELECT doc_id, text FROM documents WHERE lang = 'fr'), rest AS (SELECT text FROM documents WHERE lang != 'fr')
        SELECT 'deleted' AS what, count(*) AS n, count(*) AS chunks FROM fr UNION ALL SELECT 'not found', 1, 0
        UNION ALL SELECT 'left in documents', count(*), NULL FROM rest UNION ALL SELECT 'left in chunks', count(*), NULL FROM rest
        UNION ALL SELECT 'left in metadata', count(*), NULL FROM m WHERE document_id NOT IN (SELECT doc_id FROM fr)
        UNION ALL SELECT 'left in extracted', count(DISTINCT text), NULL FROM rest""",
    "snapshot_round_trip": f"""WITH m AS ({_METADATA}), s AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'written' ELSE 'skipped' END AS status FROM documents)
        SELECT 'documents' AS name, status, count(*) AS n FROM s GROUP BY status UNION ALL SELECT 'chunks', status, count(*) FROM s GROUP BY status
        UNION ALL SELECT 'metadata', coalesce(status, 'skipped'), count(*) FROM m LEFT JOIN s ON document_id = doc_id GROUP BY ALL
        UNION ALL SELECT 'extracted', 'written', count(DISTINCT text) FROM documents""",
    "ingested_pages": """SELECT 1 AS run, 'ingested' AS status, count(*) AS n FROM pages
        UNION ALL SELECT 2, CASE WHEN starts_with(url, 'https') THEN 'ingested' ELSE 'skipped' END, count(*) FROM pages GROUP BY 2""",
    "flashcards": f"""WITH l AS (SELECT conv_id, turn, {_LINES} AS l FROM conversations WHERE role = 'assistant'),
        c AS (SELECT conv_id, turn, unnest(range(len(l) // 2)) AS card, l FROM l)
        SELECT conv_id, turn, card::INT AS card, l[2 * card + 1] AS lead, '' AS note, 1 AS lines FROM c""",
    "live_index": f"""WITH {LEFT}, {PASSAGES}, {BM25.replace("documents", "live")}
        SELECT query_id, '/kb/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, round(score, 6) AS score FROM score JOIN live ON doc_id = chunk_id""",
    "stored_statistics": f"""WITH {LEFT} SELECT (SELECT count(*) FROM left_docs) AS total_documents, count(*) AS total_chunks, count(*) AS embedded_chunks,
        sum(length(text))::BIGINT AS total_size_bytes, sum(len({WORDS.format("text")}))::BIGINT AS total_words FROM live""",
}
ORACLES["vector_search_pruned"] = ORACLES["vector_search"]
