"""Table expressions in DuckDB SQL that mirror ``sources.views`` for the comparison queries."""

from corpusflow import constants as K
from corpusflow.operators.topk import hyperplanes


def literal(text: str) -> str:
    """A text as SQL; control characters by code."""
    parts, run = [], ""
    for c in text:
        if ord(c) < 32:
            if run:
                parts.append("'" + run.replace("'", "''") + "'")
            parts.append(f"chr({ord(c)})")
            run = ""
        else:
            run += c
    if run or not parts:
        parts.append("'" + run.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


TRIM = literal(K.TRIM_CHARS[1:])  # U+0000 does not occur in the tables
BLANK = literal(K.BLANK_CHARS)
TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"



def cleaned(text: str) -> str:
    """The text as it is given to an encoder."""
    folded = f"regexp_replace(replace({text}, chr(12), ''), '[ \\t\\n\\x0B\\r]+', ' ', 'g')"
    return f"CASE WHEN trim({text}, {BLANK}) = '' THEN {text} ELSE trim({folded}, {TRIM}) END"


VIEWS = f"""
kb AS (SELECT DISTINCT source AS id, source AS name, 'collection ' || source AS description,
       TIMESTAMP '2024-01-01' + to_days(CAST(substr(source, 4) AS INT)) AS created_at FROM documents),
doc AS (SELECT d.doc_id AS document_id, d.source AS knowledge_base_id,
        'doc_' || d.doc_id || '.txt' AS file_name, 'txt' AS file_type, d.text,
        CASE WHEN l.quality = 0 THEN 'FAILED' WHEN l.quality IS NULL AND d.doc_id % 10 = 0 THEN 'EMBEDDING'
             ELSE 'COMPLETED' END AS status
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
chunk_text AS (SELECT document_id, knowledge_base_id, CAST(i AS INT) AS chunk_index,
               substr(text, CAST(i * 450 + 1 AS BIGINT), 500) AS content
               FROM (SELECT doc_id AS document_id, source AS knowledge_base_id, text,
                     unnest(range(0, CAST(ceil(length(text) / 450.0) AS BIGINT))) AS i
                     FROM documents WHERE length(text) > 0)),
n_doc AS (SELECT count(*) AS n FROM documents),
vec AS (SELECT vec_id, vec_id % n AS document_id, CAST(vec_id // n AS INT) AS chunk_index, label,
        embedding, CAST(embedding AS DOUBLE[]) AS v FROM embeddings, n_doc),
vector_text AS (SELECT v.document_id, v.chunk_index,
                substr(d.text, CAST((v.chunk_index % nullif(CAST(ceil(length(d.text) / 450.0) AS BIGINT), 0)) * 450 + 1 AS BIGINT), 500) AS content
                FROM vec v JOIN documents d ON d.doc_id = v.document_id),
question AS (SELECT vec_id AS query_id, 'src' || ((vec_id % n) % 20) AS knowledge_base_id,
             CAST(vec_id AS VARCHAR) AS session_id, 'question ' || vec_id || ' about ' || label AS message,
             CAST(embedding AS DOUBLE[]) AS v FROM embeddings, n_doc),
asked_text AS (SELECT item_id AS query_id, 'src' || (item_id % 25) AS knowledge_base_id, text AS message FROM benchmark),
chat_history AS (SELECT conv_id || '_' || turn AS id, CAST(conv_id AS VARCHAR) AS session_id,
                 'src' || (conv_id % 20) AS knowledge_base_id, role, text AS content,
                 TIMESTAMP '2024-01-01' + to_minutes(conv_id) + to_seconds(turn) AS created_at FROM conversations),
status_event AS (SELECT event_id, ts, user_id AS document_id,
                 CASE event_type WHEN 'signup' THEN 'UPLOADING' WHEN 'view' THEN 'PARSING' WHEN 'click' THEN 'CHUNKING'
                 WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS status FROM events),
latest AS (SELECT document_id, status, ts FROM (SELECT *, row_number() OVER (PARTITION BY document_id
           ORDER BY ts DESC, event_id DESC) AS r FROM status_event) WHERE r = 1),
upload AS (SELECT page_id AS upload_id, 'src' || (page_id % 25) AS knowledge_base_id,
           CASE page_id % 10 WHEN 0 THEN 'page_' || page_id || '.pdf' WHEN 1 THEN 'Page ' || page_id || '.DOCX'
           WHEN 2 THEN 'setup' || page_id || '.exe' WHEN 3 THEN NULL WHEN 4 THEN 'doc_' || (page_id % 25) || '.txt'
           WHEN 5 THEN 'shared.txt' WHEN 6 THEN 'notes' || page_id WHEN 7 THEN 'talk.' || page_id || '.pptx'
           WHEN 8 THEN 'sheet.tar.' || page_id || '.xls' ELSE 'Shared.TXT' END AS file_name FROM pages),
typed_upload AS (SELECT *, coalesce(nullif(regexp_extract(lower(file_name), '\\.(pdf|doc|docx|xls|xlsx|ppt|pptx|txt)$', 1), ''), '')
                 AS file_type FROM upload),
kb_request AS (SELECT page_id AS request_id, CASE page_id % 5 WHEN 0 THEN ' ' || chr(9) || chr(10) WHEN 2 THEN NULL
               WHEN 1 THEN 'src' || (page_id % 30) WHEN 3 THEN 'new ' || (page_id % 7) ELSE 'kb ' || page_id END AS name
               FROM pages),
model_outcome AS (SELECT event_id AS query_id,
                  CASE event_type WHEN 'view' THEN 'answer ' || event_id WHEN 'signup' THEN '' END AS answer,
                  CASE WHEN event_type = 'error' THEN 'timeout after ' || user_id
                       WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'code 1008'
                       WHEN event_type = 'click' AND user_id % 3 = 1 THEN '402 insufficient_balance'
                       WHEN event_type = 'click' THEN 'insufficient balance!' END AS error FROM events),
kb_pair AS (SELECT q.query_id, c.document_id, c.chunk_index, round(list_cosine_similarity(q.v, c.v), 9) AS score
            FROM question q JOIN doc d ON d.knowledge_base_id = q.knowledge_base_id AND d.status = 'COMPLETED'
            JOIN vec c ON c.document_id = d.document_id),
kb_hit AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
           ORDER BY score DESC, document_id, chunk_index) AS INT) AS rank FROM kb_pair) WHERE rank <= 3),
global_hit AS (SELECT * FROM (SELECT query_id, document_id, chunk_index, score, CAST(row_number() OVER (PARTITION BY query_id
               ORDER BY score DESC, document_id, chunk_index) AS INT) AS rank FROM
               (SELECT q.query_id, c.document_id, c.chunk_index, round(list_cosine_similarity(q.v, c.v), 9) AS score
                FROM question q CROSS JOIN vec c)) WHERE rank <= 3),
l2_hit AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
           ORDER BY score DESC, document_id, chunk_index) AS INT) AS rank FROM
           (SELECT q.query_id, c.document_id, c.chunk_index,
            round(1 / (1 + pow(list_distance(q.v, c.v), 2)), 9) AS score FROM question q CROSS JOIN vec c)) WHERE rank <= 3),
context AS (SELECT h.query_id, {literal(K.CONTEXT_HEAD)} || string_agg({literal(K.CONTEXT_ITEM_OPEN)} || h.rank
            || {literal(K.CONTEXT_ITEM_CLOSE)} || t.content || {literal(K.CONTEXT_ITEM_END)}, '' ORDER BY h.rank) AS context
            FROM kb_hit h JOIN vector_text t USING (document_id, chunk_index) GROUP BY h.query_id),
words AS (SELECT * FROM (SELECT document_id, chunk_index, knowledge_base_id, content, list_filter(string_split(lower({cleaned('content')}), ' '),
          lambda w: w <> '') AS words FROM chunk_text)),
hashed AS (SELECT document_id, chunk_index, knowledge_base_id, content, counts,
           CASE WHEN len(words) = 0 THEN [] ELSE list_transform(counts, lambda c: CAST(CAST(c / sqrt(list_sum(
             list_transform(counts, lambda x: x * x))) AS FLOAT) AS DOUBLE)) END AS v
           FROM (SELECT *, list_transform(range(0, 64), lambda b: CAST(len(list_filter(buckets, lambda x: x = b)) AS DOUBLE)) AS counts
                 FROM (SELECT *, list_transform(words, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64) AS buckets FROM words))),
hashed_question AS (SELECT query_id, knowledge_base_id, message, list_transform(counts, lambda c: CAST(CAST(c / sqrt(list_sum(
             list_transform(counts, lambda x: x * x))) AS FLOAT) AS DOUBLE)) AS v
           FROM (SELECT *, list_transform(range(0, 64), lambda b: CAST(len(list_filter(buckets, lambda x: x = b)) AS DOUBLE)) AS counts
                 FROM (SELECT *, list_transform(list_filter(string_split(lower({cleaned('message')}), ' '), lambda w: w <> ''),
                   lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64) AS buckets FROM asked_text))),
hashed_hit AS (SELECT * FROM (SELECT query_id, document_id, chunk_index, content, score, CAST(row_number() OVER (
               PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS INT) AS rank FROM
               (SELECT q.query_id, c.document_id, c.chunk_index, c.content,
                round(coalesce(list_cosine_similarity(q.v, c.v), 0), 9) AS score
                FROM hashed_question q JOIN doc d ON d.knowledge_base_id = q.knowledge_base_id AND d.status = 'COMPLETED'
                JOIN hashed c ON c.document_id = d.document_id WHERE len(c.v) > 0 AND len(q.v) > 0)) WHERE rank <= 3)
"""


def planes_sql(width: int, tables: int, bits: int, seed: int) -> str:
    """The hyperplanes of the approximate search as a list of lists."""
    rows = ("[" + ",".join(map(repr, row)) + "]" for row in hyperplanes(width, tables, bits, seed).tolist())
    return "CAST([" + ",".join(rows) + "] AS DOUBLE[][])"


def sql(body: str) -> str:
    """The views followed by ``body``, whose own WITH list continues theirs."""
    body = body.strip()
    joint = ",\n" + body[len("WITH "):] if body.startswith("WITH ") else "\n" + body
    return f"WITH {VIEWS.strip()}{joint}"
