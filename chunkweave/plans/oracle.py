"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from chunkweave.functions.text import NAMESPACE
from chunkweave.operators import prompt
from chunkweave.plans.queries import NEAR

CORPUS = """corpus AS (SELECT doc_id, 'doc_' || lpad(doc_id::VARCHAR, 8, '0') || '__' || source || '.txt' AS source,
 regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text, lang, source AS origin FROM documents)"""
#: The white space that the test tables hold.
WS = "' ' || chr(10) || chr(9) || chr(13)"


def sql_text(s: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


def steps(name: str, size: int, overlap: int) -> str:
    """Recursive windows and the chunks in them."""
    limit = f"least(a + {size}, length(text))"
    window = f"reverse(substring(text, a + {size // 2} + 1, {limit} - a - {size // 2}))"
    cases = " ".join(f"WHEN instr({window}, {s}) > 0 THEN {limit} - instr({window}, {s}) + 1" for s in ("chr(10) || chr(10)", "chr(10)", "' .'", "' '"))
    end = f"CASE WHEN {limit} = length(text) THEN length(text) {cases} ELSE {limit} END"
    return f"""{name}_steps AS (
 SELECT source, text, lang, a, {end} AS e FROM (SELECT source, text, lang, 0 AS a FROM corpus WHERE trim(text, {WS}) <> '')
 UNION ALL
 SELECT source, text, lang, a, {end} AS e FROM (SELECT source, text, lang, greatest(e - {overlap}, a + 1) AS a FROM {name}_steps WHERE e < length(text))),
{name}_pieces AS (SELECT source, text AS whole, lang, a, trim(substring(text, a + 1, e - a), {WS}) AS text,
  a + (e - a) - length(ltrim(substring(text, a + 1, e - a), {WS})) AS o FROM {name}_steps),
{name} AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY a) - 1)::INT AS index, text, lang,
  (o - length(replace(substring(whole, 1, o), chr(10), '')) + 1)::INT AS line_start,
  (greatest(o, o + length(text) - 1) - length(replace(substring(whole, 1, greatest(o, o + length(text) - 1)), chr(10), '')) + 1)::INT AS line_end
  FROM {name}_pieces WHERE text <> '')"""


WITH = "WITH RECURSIVE " + CORPUS
CHUNKS = WITH + ",\n" + steps("chunks", 1000, 150)
REFERENCE = "CASE WHEN {s} = 0 THEN source WHEN line_end <> 0 AND line_end <> {s} THEN source || ' (l. ' || {s} || '-' || line_end || ')' ELSE source || ' (l. ' || {s} || ')' END"
HASH = f"sha1(unhex('{NAMESPACE}') || encode(source || ':' || index))"
POINT = f"""substr({HASH}, 1, 8) || '-' || substr({HASH}, 9, 4) || '-5' || substr({HASH}, 14, 3) || '-' ||
 translate(substr({HASH}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({HASH}, 18, 3) || '-' || substr({HASH}, 21, 12)"""
TOKENS = "unnest(list_filter(regexp_split_to_array(lower({t}), '[ \\n\\t\\r]+'), lambda w: w <> ''))"
BUCKET = "('0x' || substr(md5(w), 1, 2))::INT % 64"
COUNTS = f"(SELECT source, index, {BUCKET} AS bucket, count(*) AS n FROM (SELECT source, index, {TOKENS.format(t='text')} AS w FROM chunks) GROUP BY ALL)"
#: Cosines of hashed counts, from sparse rows.
HITS = f""",
counts AS {COUNTS},
norms AS (SELECT source, index, sqrt(sum(n * n)) AS norm FROM counts GROUP BY ALL),
asked AS (SELECT question_id, {BUCKET} AS bucket, count(*) AS n FROM (SELECT item_id AS question_id, {TOKENS.format(t='text')} AS w FROM benchmark) GROUP BY ALL),
asked_norms AS (SELECT question_id, sqrt(sum(n * n)) AS norm FROM asked GROUP BY ALL),
dots AS (SELECT question_id, source, index, sum(a.n * c.n) AS dot FROM asked a JOIN counts c USING (bucket) GROUP BY ALL),
scored AS (SELECT q.question_id, k.source, k.index, round(coalesce(d.dot, 0) / (q.norm * k.norm), 6) AS score
 FROM asked_norms q CROSS JOIN norms k LEFT JOIN dots d ON d.question_id = q.question_id AND d.source = k.source AND d.index = k.index),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source, index) AS rank FROM scored),
hits AS (SELECT question_id, rank::INT AS rank, source, index, score FROM ranked WHERE rank <= 20)"""
CANDIDATES = """,
best AS (SELECT question_id, split_part(source, '__', 1) AS doc, min(rank) AS rank FROM hits GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM best),
candidates AS (SELECT item_id AS question_id, coalesce(list(doc ORDER BY rank) FILTER (WHERE doc IS NOT NULL), []) AS document_ids
 FROM benchmark b LEFT JOIN placed p ON p.question_id = b.item_id AND p.place <= 10 GROUP BY ALL)"""
GOLD = """,
links AS (SELECT item_id AS question_id, split_part(c.source, '__', 1) AS doc FROM benchmark b JOIN corpus c ON contains(c.text, b.text) WHERE b.text <> ''),
gold AS (SELECT item_id AS question_id, coalesce(list(DISTINCT doc ORDER BY doc) FILTER (WHERE doc IS NOT NULL), []) AS gold
 FROM benchmark b LEFT JOIN links l ON l.question_id = b.item_id GROUP BY ALL)"""
SCORES = """,
scores AS (SELECT question_id, len(gold)::INT AS n_gold, len(list_intersect(gold, document_ids))::INT AS n_found,
 (len(document_ids) - len(list_intersect(document_ids, gold)))::INT AS n_extra FROM gold JOIN candidates USING (question_id))"""
CONTEXTS = f""",
kept AS (SELECT * FROM hits WHERE score >= {{threshold}}),
four AS (SELECT h.question_id, h.rank, '[' || h.rank || '] Source : ' || {REFERENCE.format(s="line_start").replace("source", "c.source")} || chr(10) || c.text AS block
 FROM kept h JOIN chunks c ON c.source = h.source AND c.index = h.index WHERE h.rank <= 4),
contexts AS (SELECT item_id AS question_id, b.text AS question, count(f.block)::INT AS n_hits,
 coalesce(string_agg(f.block, chr(10) || chr(10) ORDER BY f.rank), '') AS context FROM benchmark b LEFT JOIN four f ON f.question_id = b.item_id GROUP BY ALL)"""
VECTORS = """WITH v AS (SELECT vec_id, 'vec_' || lpad(vec_id::VARCHAR, 8, '0') AS source, label, embedding::DOUBLE[] AS vector FROM embeddings),
scored AS (SELECT q.vec_id AS question_id, v.source, round(list_cosine_similarity(q.vector, v.vector), 6) AS score FROM v q, v WHERE {which}),
ranked AS (SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source))::INT AS rank, source, score FROM scored)
SELECT * FROM ranked WHERE rank <= {k}"""


def hole(name: str, k: int) -> str:
    return f"CASE WHEN (length(text) + {k}) % 5 <> 0 THEN {name} END"


def oracle_sql() -> dict[str, str]:
    twenty = "q.vec_id % 20 = 0"
    shown = "source, index, text, line_start, line_end"
    return {
        "load_stats": f"WITH {CORPUS} SELECT source, length(text)::INT AS n_chars, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS n_lines FROM corpus WHERE trim(text, {WS}) <> ''",
        "suffix_filter": f"WITH {CORPUS}, names AS (SELECT CASE lang WHEN 'en' THEN upper(source) WHEN 'de' THEN source || '.bak' ELSE source END AS source FROM corpus) SELECT source FROM names WHERE lower(source) LIKE '%.txt'",
        "doc_id_from_source": f"WITH {CORPUS} SELECT source, split_part(source, '__', 1) AS document_id FROM corpus",
        "chunk_1000_150": f"{CHUNKS} SELECT {shown} FROM chunks",
        "chunk_lateral": f"{CHUNKS} SELECT {shown} FROM chunks",
        "chunk_300_50": f"{WITH}, {steps('chunks', 300, 50)} SELECT {shown} FROM chunks",
        "chunk_reference": f"{CHUNKS} SELECT source, index, {REFERENCE.format(s='s')} AS reference FROM (SELECT *, CASE WHEN index % 5 = 4 THEN 0 ELSE line_start END AS s FROM chunks)",
        "point_id": f"{CHUNKS} SELECT {POINT} AS id, source, index FROM chunks",
        "payload_projection": f"{CHUNKS} SELECT text, source, index, line_start, line_end FROM chunks",
        "payload_defaults": f"{CHUNKS} SELECT coalesce({hole('source', 0)}, 'inconnu') AS source, coalesce({hole('index', 1)}, 0) AS index, coalesce({hole('text', 2)}, '') AS text, coalesce({hole('line_start', 3)}, 0) AS line_start, coalesce({hole('line_end', 4)}, 0) AS line_end FROM chunks",
        "ingest_report": f"{CHUNKS} SELECT c.source, count(k.index) AS n_chunks FROM (SELECT DISTINCT source FROM corpus) c LEFT JOIN chunks k ON k.source = c.source GROUP BY ALL",
        "list_sources": f"{CHUNKS} SELECT DISTINCT source FROM chunks WHERE source <> ''",
        "collection_count": f"{CHUNKS} SELECT count(*) AS n_points FROM chunks",
        "hashed_embedding": f"{CHUNKS} SELECT source, index, bucket, n FROM {COUNTS}",
        "embedding_vectors": f"{CHUNKS} SELECT source, index, bucket, n FROM {COUNTS}",
        "search_top_k": VECTORS.format(which="q.vec_id = (SELECT min(vec_id) FROM v)", k=4),
        "search_batch_top_k": VECTORS.format(which=twenty, k=10),
        "search_threshold": VECTORS.format(which=twenty, k=10) + " AND score >= 0.5",
        "search_threshold_indexed": VECTORS.format(which=twenty, k=10) + " AND score >= 0.5",
        "search_filtered": VECTORS.format(which=twenty + " AND v.label = 3", k=10),
        "rag_retrieve": f"{CHUNKS}{HITS} SELECT * FROM hits",
        "upsert_merge": f"{CHUNKS} SELECT {POINT} AS id, source, index, CASE WHEN lang = 'en' THEN '2 ' || text ELSE text END AS text FROM chunks",
        "delete_source": f"{CHUNKS} SELECT source, index FROM chunks WHERE source <> (SELECT min(source) FROM corpus)",
        "reset_store": f"{CHUNKS} SELECT 'before' AS state, count(*) AS n_points FROM chunks UNION ALL SELECT 'after', 0",
        "resume_anti_join": f"WITH {CORPUS} SELECT source FROM corpus WHERE lang = 'fr' OR lang IS NULL OR trim(text, {WS}) = ''",
        "bench_resume_limit": "WITH q AS (SELECT lpad(conv_id::VARCHAR, 10, '0') || ':' || lpad(turn::VARCHAR, 6, '0') AS question_id, text AS question FROM conversations WHERE role = 'user') SELECT * FROM q WHERE question_id NOT IN (SELECT question_id FROM q WHERE length(question) % 3 = 0) ORDER BY question_id LIMIT 50",
        "doc_candidates": f"{CHUNKS}{HITS}{CANDIDATES} SELECT question_id, array_to_string(document_ids, ',') AS document_ids FROM candidates",
        "gold_documents": f"WITH {CORPUS}{GOLD} SELECT question_id, array_to_string(gold, ',') AS gold FROM gold",
        "doc_recall": f"{CHUNKS}{HITS}{CANDIDATES}{GOLD}{SCORES} SELECT question_id, n_gold, n_found, round(n_found / n_gold, 6) AS recall FROM scores WHERE n_gold > 0",
        "extra_docs": f"{CHUNKS}{HITS}{CANDIDATES}{GOLD}{SCORES} SELECT question_id, n_extra FROM scores",
        "category_report": f"""{CHUNKS}{HITS}{CANDIDATES}{GOLD}{SCORES}, named AS (SELECT s.*, CASE WHEN length(b.text) > 200 THEN 'long' ELSE 'short' END AS category FROM scores s JOIN benchmark b ON b.item_id = s.question_id WHERE n_gold > 0)
 SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(n_found / n_gold), 6) AS recall, round(avg((n_found = n_gold)::INT), 6) AS complete, round(avg((n_found = 0)::INT), 6) AS missed FROM named GROUP BY ROLLUP (category)""",
        "context_block": f"{CHUNKS}{HITS}{CONTEXTS.format(threshold=-1)} SELECT question_id, n_hits, context FROM contexts",
        "user_prompt": f"{CHUNKS}{HITS}{CONTEXTS.format(threshold=-1)} SELECT question_id, {sql_text(prompt.BEFORE_CONTEXT)} || context || {sql_text(prompt.BEFORE_QUESTION)} || trim(question, {WS}) || {sql_text(prompt.AFTER_QUESTION)} AS prompt FROM contexts",
        "fake_answer": f"{CHUNKS}{HITS}{CONTEXTS.format(threshold=-1)} SELECT question_id, CASE WHEN n_hits = 0 THEN {sql_text(prompt.NO_CONTEXT)} ELSE trim({sql_text(prompt.ECHO_HEADER)} || substring(context, 1, 600), {WS}) END AS text, n_hits AS n_sources FROM contexts",
        "no_context_answer": f"{CHUNKS}{HITS}{CONTEXTS.format(threshold=NEAR)} SELECT question_id, {sql_text(prompt.NO_CONTEXT)} AS text FROM contexts WHERE n_hits = 0",
        "excerpt_200": f"WITH {CORPUS} SELECT source, substring(array_to_string(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda w: w <> ''), ' '), 1, 200) AS excerpt FROM corpus",
        "normalize_ws": f"WITH {CORPUS} SELECT source, trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g')) AS text FROM corpus",
        "source_distribution": f"WITH {CORPUS} SELECT origin, count(*) AS n_documents FROM corpus GROUP BY ALL",
        "corpus_sample": f"""WITH {CORPUS}{GOLD}, rest AS (SELECT source FROM corpus WHERE split_part(source, '__', 1) NOT IN (SELECT doc FROM links) ORDER BY md5(source || ':0'), source LIMIT 100)
 SELECT source, true AS wanted FROM corpus WHERE split_part(source, '__', 1) IN (SELECT doc FROM links) UNION ALL SELECT source, false FROM rest""",
        "batch_totals": f"{CHUNKS}, done AS (SELECT c.source, count(k.index) AS n FROM (SELECT DISTINCT source FROM corpus) c LEFT JOIN chunks k ON k.source = c.source GROUP BY ALL) SELECT count(*) AS n_documents, sum(n)::BIGINT AS n_chunks, count(*) FILTER (WHERE n = 0) AS n_failed FROM done",
    }
