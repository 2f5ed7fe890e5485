"""Registered queries: one per operator, with the SQL that gives the same rows.

Each query takes (spark, folder) and returns a DataFrame over whole tables.
Long texts are compared by md5, scores by six decimals, times as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions import status as st
from corpusflow.functions import text as tx
from corpusflow.functions import vectors as vx
from corpusflow.operators import catalog, history, ivf, lifecycle, prompting, retrieval
from corpusflow.operators.chunking import chunk_documents, fixed_chunks
from corpusflow.operators.embedding import embed, hashing_encoder
from corpusflow.operators.embedding import embed_cached as cached
from corpusflow.operators.generation import first_chunk_model, generate
from corpusflow.operators.topk import add_bucket, top_k, top_k_lsh, top_k_probed
from corpusflow.plans import answering, processing
from corpusflow.plans.check_sql import TIME, TRIM, cleaned, literal, planes_sql, sql
from corpusflow.session import work_path
from corpusflow.sources import tables
from corpusflow.sources import views as vw
from corpusflow.sources.files import decode_text, write_files
from corpusflow.streaming import jobs, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(body: str, name: str | None = None):
    """Register a function under its own or the given name, with its SQL."""

    def add(run: Query) -> Query:
        QUERIES[name or run.__name__] = run
        ORACLE[name or run.__name__] = sql(body)
        return run

    return add


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _md5(column: str, alias: str | None = None):
    return F.md5(F.col(column).cast("binary")).alias(alias or f"{column}_md5")


def _six(column: str = "score"):
    return F.round(column, 6).alias(column)


def _bigint(column: str):
    return F.col(column).cast("bigint").alias(column)


# --- sources and sinks ------------------------------------------------------------

@query(f"SELECT id, name, description, {TIME.format('created_at')} AS created_at FROM kb")
def scan_kb(spark, d):
    return vw.knowledge_base(spark, d).select("id", "name", "description", _time("created_at"))


@query(f"""SELECT id, session_id, knowledge_base_id, role, md5(content) AS content_md5,
       {TIME.format('created_at')} AS created_at FROM chat_history""")
def scan_history(spark, d):
    return vw.chat_history(spark, d).select("id", "session_id", "knowledge_base_id", "role",
                                            _md5("content"), _time("created_at"))


@query("""SELECT doc.document_id, file_name, coalesce(latest.status, doc.status) AS status
       FROM doc LEFT JOIN latest ON doc.document_id = latest.document_id""")
def upsert_documents(spark, d):
    stored = vw.document(spark, d).select("document_id", "file_name", "status")
    last = lifecycle.latest_status(vw.status_event(spark, d)).select("document_id", "status")
    changed = stored.drop("status").join(last, "document_id")
    return catalog.upsert(stored, changed, ["document_id"])


# The sixteenths nearest to the items, whose texts are the same in any engine.
@query("""SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CASE WHEN round(x * 16) = 0
       THEN '0.0' ELSE CAST(CAST(round(x * 16) / 16 AS FLOAT) AS VARCHAR) END), ', ') || ']' AS text, len(embedding) AS n_items, true AS same FROM vec""")
def vector_encode(spark, d):
    rounded = F.transform("embedding", lambda x: (F.round(x * 16) / 16 + F.lit(0.0)).cast("float"))
    text, whole = vx.encode(rounded), vx.encode(F.col("embedding"))
    return vw.chunk_vector(spark, d).select(
        "vec_id", text.alias("text"), F.size(F.split(whole, ", ")).cast("bigint").alias("n_items"),
        (vx.decode(whole) == F.col("embedding")).alias("same"))


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN len(v) ELSE 0 END AS n_items,
       CASE WHEN vec_id % 5 = 0 THEN round(list_sum(v), 6) ELSE 0 END AS total FROM vec""")
def vector_decode(spark, d):
    text, kind = vx.encode(F.col("embedding")), F.col("vec_id") % 5
    damaged = (F.when(kind == 0, text).when(kind == 1, F.replace(text, F.lit(", "), F.lit(",")))
               .when(kind == 2, F.replace(text, F.lit("]"), F.lit(", x]"))).when(kind == 3, F.lit("")))
    decoded = vw.chunk_vector(spark, d).select("vec_id", vx.decode(damaged).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return decoded.select("vec_id", F.size("v").cast("bigint").alias("n_items"), F.round(total, 6).alias("total"))


@query("SELECT document_id || '_' || chunk_index AS id FROM vec WHERE document_id = 17")
def vector_ids_by_document(spark, d):
    return catalog.vector_ids(vw.chunk_vector(spark, d), 17)


@query("""SELECT vec.document_id, chunk_index, knowledge_base_id, len(embedding) AS n_items
       FROM vec JOIN doc ON doc.document_id = vec.document_id WHERE status = 'COMPLETED'""")
def write_chunks(spark, d):
    path = work_path(spark, "chunks")
    tables.write_chunks(retrieval.kb_chunks(vw.document(spark, d), vw.chunk_vector(spark, d)), path, "overwrite")
    return tables.scan(spark, path).select(
        "document_id", "chunk_index", "knowledge_base_id", F.size("embedding").cast("bigint").alias("n_items"))


# Ids that look like numbers: 007, 1e5.
KB_NUMBER = "CASE WHEN knowledge_base_id = 'src5' THEN '1e5' ELSE lpad(substr(knowledge_base_id, 4), 3, '0') END"
DOCUMENT_NUMBER = "lpad(CAST(document_id AS STRING), 7, '0')"


@query(f"""SELECT {DOCUMENT_NUMBER} AS document_id, {KB_NUMBER} AS knowledge_base_id, chunk_index, len(embedding) AS n_items
       FROM vec JOIN doc USING (document_id) WHERE status <> 'FAILED' AND knowledge_base_id <> 'src3'""")
def delete_stored_documents(spark, d):
    path = work_path(spark, "chunks")
    documents = vw.document(spark, d)
    rows = (vw.chunk_vector(spark, d).join(documents, "document_id").withColumn("number", F.expr(DOCUMENT_NUMBER))
            .select(F.col("number").alias("document_id"), "chunk_index", "embedding", "status",
                    F.expr(KB_NUMBER).alias("knowledge_base_id")))
    tables.write_chunks(rows.drop("status"), path, "overwrite")
    # Failed documents of all knowledge bases, and all documents of one, whose folder goes.
    tables.delete_documents_from(spark, path, rows.where("status = 'FAILED' OR knowledge_base_id = '003'"))
    return tables.scan(spark, path).select("document_id", "knowledge_base_id", "chunk_index",
                                           F.size("embedding").cast("bigint").alias("n_items"))


@query(f"""SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN md5(text)
       ELSE md5('你好' || regexp_replace(text, '[^\\x01-\\x7fáàéèêíìóòúùü]', '?', 'g')) END AS text_md5 FROM documents""",
       name="decode_text")
def decode_bytes(spark, d):
    # Every second document is encoded as GBK, behind two Chinese characters; what GBK lacks becomes "?".
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else ("你好" + t).encode("gbk", errors="replace")
                            for t in texts.to_pylist()], pa.binary())

    even = F.col("document_id") % 2 == 0
    gbk = F.arrow_udf(encode, "binary")(F.when(~even, F.col("text")))
    content = F.when(even, F.col("text").cast("binary")).otherwise(gbk)
    return (vw.source_text(spark, d).select("document_id", decode_text(content).alias("text"))
            .select("document_id", _md5("text")))


# --- projections, filters, predicates ---------------------------------------------

@query(f"""SELECT id, name, description, {TIME.format('created_at')} AS created_at,
       {TIME.format('created_at')} AS updated_at FROM kb""")
def kb_list(spark, d):
    return catalog.kb_list(vw.knowledge_base(spark, d)).select(
        "id", "name", "description", _time("created_at"), _time("updated_at"))


@query("SELECT id, name, description FROM kb WHERE id = 'src3'")
def kb_by_id(spark, d):
    return catalog.where_equal(vw.knowledge_base(spark, d), id="src3").select("id", "name", "description")


@query("SELECT id, name, description FROM kb WHERE name = 'src7'")
def kb_by_name(spark, d):
    return catalog.where_equal(vw.knowledge_base(spark, d), name="src7").select("id", "name", "description")


DOC = ("document_id", "knowledge_base_id", "file_name", "file_type", "status")


@query("SELECT document_id, knowledge_base_id, file_name, file_type, status FROM doc WHERE document_id = 42")
def document_by_id(spark, d):
    return catalog.where_equal(vw.document(spark, d), document_id=42).select(*DOC)


@query("SELECT document_id, knowledge_base_id, file_name, file_type, status FROM doc WHERE knowledge_base_id = 'src5'")
def documents_by_kb(spark, d):
    return catalog.where_equal(vw.document(spark, d), knowledge_base_id="src5").select(*DOC)


@query("""SELECT document_id, knowledge_base_id, file_name, file_type, status FROM doc
       WHERE knowledge_base_id = 'src5' AND file_name = 'doc_25.txt'""")
def document_by_kb_and_name(spark, d):
    return catalog.where_equal(vw.document(spark, d), knowledge_base_id="src5",
                               file_name="doc_25.txt").select(*DOC)


@query("SELECT document_id, chunk_index, md5(content) AS content_md5 FROM chunk_text WHERE document_id = 17")
def chunks_by_document(spark, d):
    return catalog.where_equal(vw.chunk_text(spark, d), document_id=17).select(
        "document_id", "chunk_index", _md5("content"))


@query("SELECT document_id, knowledge_base_id, file_name, file_type, status FROM doc WHERE status = 'COMPLETED'")
def completed_documents(spark, d):
    return retrieval.completed(vw.document(spark, d)).select(*DOC)


@query("SELECT upload_id, file_name, file_type FROM typed_upload")
def file_type(spark, d):
    return vw.upload(spark, d).select("upload_id", "file_name", tx.file_type(F.col("file_name")).alias("file_type"))


@query(f"""WITH first AS (SELECT knowledge_base_id, file_name, min(upload_id) AS upload_id FROM typed_upload GROUP BY ALL),
       fresh AS (SELECT upload_id FROM first f WHERE NOT EXISTS (SELECT 1 FROM doc
                 WHERE doc.knowledge_base_id = f.knowledge_base_id AND doc.file_name = f.file_name))
       SELECT upload_id, knowledge_base_id, file_name, file_type,
       CASE WHEN knowledge_base_id NOT IN (SELECT id FROM kb) THEN '{K.MSG_KB_MISSING}' || knowledge_base_id
            WHEN file_type = '' THEN '{K.MSG_TYPE_UNSUPPORTED}' || file_type || '{K.MSG_TYPE_HINT}'
            WHEN upload_id NOT IN (SELECT upload_id FROM fresh) THEN '{K.MSG_FILE_EXISTS}' || file_name END AS reason
       FROM typed_upload""")
def upload_validation(spark, d):
    return catalog.validate_uploads(vw.upload(spark, d), vw.knowledge_base(spark, d), vw.document(spark, d)).select(
        "upload_id", "knowledge_base_id", "file_name", "file_type", "reason")


@query(f"""SELECT document_id, 'FAILED' AS status, '{K.MSG_NO_TEXT}' AS error_message
       FROM doc WHERE status = 'FAILED' OR text IS NULL OR trim(text, {TRIM}) = ''""")
def blank_text_documents(spark, d):
    return vw.extracted(spark, d).where(~tx.has_text(F.col("text"))).select(
        "document_id", F.lit("FAILED").alias("status"), F.lit(K.MSG_NO_TEXT).alias("error_message"))


@query(f"""WITH fresh AS (SELECT min(request_id) AS request_id FROM kb_request
                 WHERE name IS NOT NULL AND trim(name, {TRIM}) <> '' AND name NOT IN (SELECT name FROM kb) GROUP BY name)
       SELECT request_id, name, CASE WHEN name IS NULL OR trim(name, {TRIM}) = '' THEN 'name is blank'
            WHEN request_id NOT IN (SELECT request_id FROM fresh) THEN '{K.MSG_KB_NAME_EXISTS}' || name END AS reason
       FROM kb_request""")
def kb_create_valid(spark, d):
    return catalog.validate_new_kbs(vw.kb_request(spark, d), vw.knowledge_base(spark, d)).select(
        "request_id", "name", "reason")


@query("SELECT vec_id, len(embedding) AS n_items FROM vec WHERE label <> 0")
def valid_vectors(spark, d):
    failed = F.when(F.col("label") == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return (vw.chunk_vector(spark, d).withColumn("embedding", failed).where(vx.is_usable(F.col("embedding")))
            .select("vec_id", F.size("embedding").cast("bigint").alias("n_items")))


@query("""SELECT query_id, rank, lower(concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4),
       substr(m, 21, 12))) AS document_id FROM (SELECT *, md5(CAST(document_id AS VARCHAR)) AS m FROM global_hit)
       WHERE document_id % 3 <> 0""")
def valid_hits(spark, d):
    hashed = F.md5(F.col("document_id").cast("string").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(hashed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    plain = F.concat(F.lit("doc-"), F.col("document_id").cast("string"))
    hits = top_k(vw.chunk_vector(spark, d), vw.question(spark, d))
    named = hits.withColumn("document_id", F.when(F.col("document_id") % 3 == 0, plain).otherwise(uuid))
    return retrieval.valid_hits(named).select("query_id", "rank", "document_id")


@query("""SELECT query_id, rank, md5(content) AS content_md5, document_id || '_' || chunk_index AS source,
       round(score, 6) AS score FROM global_hit JOIN vector_text USING (document_id, chunk_index)""")
def hit_projection(spark, d):
    questions = vw.question(spark, d)
    hits = top_k(vw.chunk_vector(spark, d), questions)
    full = retrieval.with_content(hits, vw.vector_text(spark, d), questions)
    return retrieval.project_hits(full).select("query_id", "rank", _md5("content"), "source", _six())


@query("""SELECT vec_id, CASE WHEN label % 4 IN (1, 3) THEN CAST(document_id AS VARCHAR) ELSE '' END AS document_id,
       CASE WHEN label % 4 IN (2, 3) THEN CAST(chunk_index AS VARCHAR) ELSE '0' END AS chunk_index FROM vec""")
def metadata_defaults(spark, d):
    # Label bits say which of the two keys a record carries.
    document = F.create_map(F.lit("documentId"), F.col("document_id").cast("string"))
    position = F.create_map(F.lit("chunkIndex"), F.col("chunk_index").cast("string"))
    kind, none = F.col("label") % 4, F.create_map().cast("map<string,string>")
    metadata = F.map_concat(F.when(kind.isin(1, 3), document).otherwise(none),
                            F.when(kind.isin(2, 3), position).otherwise(none))
    return retrieval.read_metadata(
        vw.chunk_vector(spark, d).select("vec_id", metadata.alias("metadata")))


@query("""SELECT document_id, status FROM latest WHERE status IN ('UPLOADING', 'PARSING', 'CHUNKING', 'EMBEDDING')""")
def processing_documents(spark, d):
    last = lifecycle.latest_status(vw.status_event(spark, d))
    return last.where(st.is_processing(F.col("status"))).select("document_id", "status")


@query("SELECT document_id, knowledge_base_id, status FROM doc WHERE status LIKE '%FAILED%'")
def failed_documents(spark, d):
    return vw.document(spark, d).where(st.is_failed(F.col("status"))).select(
        "document_id", "knowledge_base_id", "status")


@query("""SELECT event_id, e.status, CASE e.status WHEN 'UPLOADING' THEN '上传中' WHEN 'PARSING' THEN '解析中'
       WHEN 'CHUNKING' THEN '切片中' WHEN 'COMPLETED' THEN '已完成' ELSE e.status END AS label,
       CASE e.status WHEN 'UPLOADING' THEN 10 WHEN 'PARSING' THEN 30 WHEN 'CHUNKING' THEN 50
       WHEN 'COMPLETED' THEN 100 END AS progress
       FROM (SELECT event_id, CASE WHEN status = 'FAILED' THEN 'unknown' ELSE status END AS status FROM status_event) e""")
def status_labels(spark, d):
    status = F.when(F.col("status") == "FAILED", "unknown").otherwise(F.col("status"))
    events = vw.status_event(spark, d).withColumn("status", status)
    return events.select("event_id", "status", st.label(F.col("status")).alias("label"),
                         st.stage_progress(F.col("status")).alias("progress"))


@query("SELECT id, md5(content) AS content_md5 FROM chat_history h WHERE EXISTS (SELECT 1 FROM chat_history n "
       "WHERE n.session_id = h.session_id AND n.created_at > h.created_at)")
def prior_turns(spark, d):
    return history.prior_turns(vw.chat_history(spark, d)).select("id", _md5("content"))


# --- joins ------------------------------------------------------------------------

HITS = "query_id, rank, document_id || '_' || chunk_index AS source, round(score, 6) AS score"


def _hits(hits: DataFrame) -> DataFrame:
    source = tx.chunk_key(F.col("document_id"), F.col("chunk_index")).alias("source")
    return hits.select("query_id", "rank", source, _six())


@query("""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank,
       document_id || '_' || chunk_index AS source, round(score, 6) AS score
       FROM l2_hit JOIN question USING (query_id) JOIN doc USING (document_id, knowledge_base_id)
       WHERE status = 'COMPLETED'""")
def retrieve_global_then_filter(spark, d):
    return _hits(retrieval.retrieve(vw.document(spark, d), vw.chunk_vector(spark, d), vw.question(spark, d),
                                    metric="l2", scope="global_then_filter"))


@query("""SELECT document_id, chunk_index, knowledge_base_id, label FROM vec JOIN doc USING (document_id)
       WHERE status = 'COMPLETED'""")
def kb_chunks(spark, d):
    return retrieval.kb_chunks(vw.document(spark, d), vw.chunk_vector(spark, d)).select(
        "document_id", "chunk_index", "knowledge_base_id", "label")


def _first_question(spark, d) -> list[float]:
    return vw.question(spark, d).where("query_id = 7").first()["embedding"]


@query("""SELECT c.document_id, c.chunk_index, round(list_cosine_similarity(q.v, c.v), 6) AS score
       FROM vec c, (SELECT v FROM question WHERE query_id = 7) q""")
def score_all(spark, d):
    return retrieval.score_chunks(vw.chunk_vector(spark, d), _first_question(spark, d)).select(
        "document_id", "chunk_index", _six())


@query("""SELECT doc.document_id, knowledge_base_id FROM doc JOIN latest ON latest.document_id = doc.document_id
       WHERE latest.status <> 'FAILED' UNION ALL
       SELECT document_id, knowledge_base_id FROM doc WHERE document_id NOT IN (SELECT document_id FROM latest)""")
def delete_documents(spark, d):
    failed = lifecycle.latest_status(vw.status_event(spark, d)).where(st.is_failed(F.col("status")))
    documents, _ = catalog.delete_documents(vw.document(spark, d), vw.chunk_vector(spark, d), failed)
    return documents.select("document_id", "knowledge_base_id")


@query("""SELECT document_id || '_' || chunk_index AS id FROM vec
       WHERE document_id NOT IN (SELECT document_id FROM latest WHERE status = 'FAILED')""")
def delete_document_chunks(spark, d):
    failed = lifecycle.latest_status(vw.status_event(spark, d)).where(st.is_failed(F.col("status")))
    _, chunks = catalog.delete_documents(vw.document(spark, d), vw.chunk_vector(spark, d), failed)
    return chunks.select(tx.chunk_key(F.col("document_id"), F.col("chunk_index")).alias("id"))


# Knowledge bases that still have documents in progress.
BUSY = "{} IN (SELECT knowledge_base_id FROM doc WHERE status = 'EMBEDDING')"


@query(f"""SELECT 'kb' AS kind, id FROM kb WHERE NOT {BUSY.format('id')}
       UNION ALL SELECT 'document', CAST(document_id AS VARCHAR) FROM doc WHERE NOT {BUSY.format('knowledge_base_id')}
       UNION ALL SELECT 'chunk', vec.document_id || '_' || chunk_index FROM vec JOIN doc ON doc.document_id = vec.document_id
                 WHERE NOT {BUSY.format('knowledge_base_id')}
       UNION ALL SELECT 'message', id FROM chat_history WHERE NOT {BUSY.format('knowledge_base_id')}""")
def delete_kb_cascade(spark, d):
    documents = vw.document(spark, d)
    listed = prompting.readiness(documents).where("has_processing").select(F.col("knowledge_base_id").alias("id"))
    left = catalog.delete_kbs(vw.knowledge_base(spark, d), documents, vw.chunk_vector(spark, d),
                              vw.chat_history(spark, d), listed)
    ids = (F.col("id"), F.col("document_id").cast("string"),
           tx.chunk_key(F.col("document_id"), F.col("chunk_index")), F.col("id"))
    parts = [df.select(F.lit(kind).alias("kind"), key.alias("id"))
             for kind, df, key in zip(("kb", "document", "chunk", "message"), left, ids)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""SELECT vec.document_id || '_' || chunk_index AS id FROM vec JOIN doc ON doc.document_id = vec.document_id
       WHERE status = 'FAILED'""")
def orphan_chunks(spark, d):
    # Failed documents removed without their chunks.
    left = vw.document(spark, d).where(~st.is_failed(F.col("status")))
    return catalog.orphan_chunks(left, vw.chunk_vector(spark, d)).select(
        tx.chunk_key(F.col("document_id"), F.col("chunk_index")).alias("id"))


@query("""SELECT id, session_id FROM chat_history WHERE session_id NOT IN
       (SELECT session_id FROM chat_history WHERE role = 'system')""")
def delete_sessions(spark, d):
    rows = vw.chat_history(spark, d)
    return history.delete_by(rows, rows.where("role = 'system'"), "session_id").select("id", "session_id")


@query(f"""SELECT q.query_id, q.knowledge_base_id, coalesce(r.ready, false) AS ready,
       CASE WHEN coalesce(r.ready, false) THEN NULL ELSE '{K.ANSWER_NO_DOCUMENTS}' END AS answer
       FROM asked_text q LEFT JOIN (SELECT knowledge_base_id, bool_or(status = 'COMPLETED') AS ready
       FROM doc GROUP BY 1) r ON r.knowledge_base_id = q.knowledge_base_id""")
def answer_guard(spark, d):
    return prompting.guard_answers(vw.asked_text(spark, d), vw.document(spark, d)).select(
        "query_id", "knowledge_base_id", "ready", "answer")


# --- aggregations -----------------------------------------------------------------

@query("""SELECT knowledge_base_id, bool_or(status = 'COMPLETED') AS has_completed,
       bool_or(status IN ('UPLOADING', 'PARSING', 'CHUNKING', 'EMBEDDING')) AS has_processing FROM doc GROUP BY 1""")
def kb_readiness(spark, d):
    return prompting.readiness(vw.document(spark, d))


@query(f"""SELECT doc.document_id, CASE WHEN coalesce(n_ok, 0) = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
       CAST(coalesce(n_ok, 0) AS INT) AS chunk_count, CAST(coalesce(n_failed, 0) AS INT) AS failed_count,
       CASE WHEN coalesce(n_ok, 0) = 0 THEN '{K.MSG_ALL_CHUNKS_FAILED}' WHEN n_failed > 0
       THEN '{K.MSG_SOME_CHUNKS_FAILED}' || n_ok || '{K.MSG_SOME_CHUNKS_FAILED_2}' || n_failed END AS error_message
       FROM doc LEFT JOIN (SELECT document_id, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed
       FROM (SELECT document_id, substr(md5(content), 1, 1) NOT IN ('0', '1', '2', '3') AS ok FROM chunk_text)
       GROUP BY 1) c ON c.document_id = doc.document_id""")
def document_status(spark, d):
    # A quarter of the chunks counts as failed, chosen by their hash.
    ok = ~F.substring(F.md5(F.col("content").cast("binary")), 1, 1).isin("0", "1", "2", "3")
    outcomes = vw.chunk_text(spark, d).select("document_id", ok.alias("ok"))
    return lifecycle.document_status(vw.document(spark, d), outcomes).select(
        "document_id", "status", "chunk_count", "failed_count", "error_message")


@query(f"""SELECT session_id, substr(content, 1, 20) || CASE WHEN length(content) > 20 THEN '...' ELSE '' END AS title,
       {TIME.format('created_at')} AS last_time, strftime(created_at, '%Y/%-m/%-d') AS last_date
       FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS r FROM chat_history)
       WHERE r = 1""")
def session_list(spark, d):
    return history.sessions(vw.chat_history(spark, d)).select("session_id", "title", _time("last_time"), "last_date")


def _kb_hits(spark, d, n: int | None = None):
    n = n or vw.documents_count(spark, d)
    return retrieval.retrieve(vw.document(spark, d), vw.chunk_vector(spark, d, n), vw.question(spark, d, n))


def _contexts(spark, d):
    n = vw.documents_count(spark, d)
    full = retrieval.with_content(_kb_hits(spark, d, n), vw.vector_text(spark, d, n), vw.question(spark, d, n))
    return prompting.build_context(full)


@query("SELECT query_id, length(context) AS n_chars, md5(context) AS context_md5 FROM context")
def build_context(spark, d):
    return _contexts(spark, d).select("query_id", F.length("context").cast("bigint").alias("n_chars"), _md5("context"))


@query("""SELECT kb.id, count(doc.document_id) AS document_count FROM kb LEFT JOIN doc
       ON doc.knowledge_base_id = kb.id GROUP BY kb.id""")
def kb_document_counts(spark, d):
    return catalog.document_counts(vw.knowledge_base(spark, d), vw.document(spark, d))


# --- windows, sorts, limits, top-k ------------------------------------------------

@query("""SELECT CAST(row_number() OVER (ORDER BY score DESC, document_id, chunk_index) AS INT) AS rank,
       document_id, chunk_index, round(score, 6) AS score FROM kb_pair WHERE query_id = 7
       ORDER BY score DESC, document_id, chunk_index LIMIT 3""")
def topk_single(spark, d):
    chunks = retrieval.kb_chunks(vw.document(spark, d), vw.chunk_vector(spark, d))
    one = catalog.where_equal(chunks, knowledge_base_id="src7")
    return retrieval.top_k_single(one, _first_question(spark, d)).select(
        "rank", "document_id", "chunk_index", _six())


@query(f"SELECT {HITS} FROM kb_hit")
def retrieve_kb(spark, d):
    return _hits(_kb_hits(spark, d))


@query(f"SELECT {HITS} FROM l2_hit")
def topk_l2(spark, d):
    n = vw.documents_count(spark, d)
    return _hits(top_k(vw.chunk_vector(spark, d, n), vw.question(spark, d, n), metric="l2"))


LSH = dict(width=64, tables=20, bits=4, seed=7)


LSH_SQL = f"""lsh_plane AS (SELECT * FROM (SELECT unnest(range(0, {LSH['tables'] * LSH['bits']})) AS p, unnest({planes_sql(**LSH)}) AS w)),
       side AS (SELECT vec_id, v, p // {LSH['bits']} AS t, sum(CASE WHEN list_dot_product(v, w) > 0 THEN 1 << (p % {LSH['bits']})
                ELSE 0 END) AS bucket FROM vec, lsh_plane GROUP BY vec_id, v, p // {LSH['bits']}),
       pair AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id FROM side a JOIN side b USING (t, bucket)),
       lsh_scored AS (SELECT pair.query_id, c.vec_id, c.document_id, c.chunk_index,
                      round(1 / (1 + pow(list_distance(q.v, c.v), 2)), 9) AS score
                      FROM pair JOIN question q ON q.query_id = pair.query_id JOIN vec c ON c.vec_id = pair.vec_id)"""


@query(f"""WITH {LSH_SQL} SELECT {HITS} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY score DESC, document_id, chunk_index) AS INT) AS rank FROM lsh_scored) WHERE rank <= 3""")
def topk_lsh(spark, d):
    n = vw.documents_count(spark, d)
    return _hits(top_k_lsh(vw.chunk_vector(spark, d, n), vw.question(spark, d, n), metric="l2", **LSH))


PROBED = dict(width=64, bits=5, seed=7)
# The given vectors have no clusters, so most buckets have to be visited for a recall of 0.9.
PROBES = 28


PROBED_SQL = f"""plane AS (SELECT * FROM (SELECT unnest(range(0, {PROBED['bits']})) AS p, unnest({planes_sql(tables=1, **PROBED)}) AS w)),
       margin AS (SELECT vec_id, p, list_dot_product(v, w) AS m FROM vec, plane),
       home AS (SELECT vec_id, sum(CASE WHEN m > 0 THEN 1 << p ELSE 0 END) AS bucket FROM margin GROUP BY vec_id),
       visit AS (SELECT vec_id, b FROM (SELECT vec_id, b, row_number() OVER (PARTITION BY vec_id ORDER BY sum(
                 CASE WHEN ((b >> p) & 1 = 1) <> (m > 0) THEN abs(m) ELSE 0 END)) AS r
                 FROM margin, range(0, {1 << PROBED['bits']}) t(b) GROUP BY vec_id, b) WHERE r <= {PROBES}),
       probed_scored AS (SELECT q.query_id, c.vec_id, c.document_id, c.chunk_index,
                  round(1 / (1 + pow(list_distance(q.v, c.v), 2)), 9) AS score
                  FROM visit JOIN home ON home.bucket = visit.b JOIN question q ON q.query_id = visit.vec_id
                  JOIN vec c ON c.vec_id = home.vec_id)"""


def _probed(spark, d, k: int = K.TOP_K) -> DataFrame:
    path = work_path(spark, "bucketed")
    tables.write_by(add_bucket(vw.chunk_vector(spark, d), **PROBED), path, "bucket", "overwrite")
    return top_k_probed(tables.scan(spark, path), vw.question(spark, d), probes=PROBES, k=k, metric="l2", **PROBED)


@query(f"""WITH {PROBED_SQL} SELECT {HITS} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY score DESC, document_id, chunk_index) AS INT) AS rank FROM probed_scored) WHERE rank <= 3""")
def topk_probed(spark, d):
    return _hits(_probed(spark, d))


def _ivf(spark, d, k: int = K.TOP_K) -> DataFrame:
    vectors = vw.chunk_vector(spark, d)
    model = ivf.train(vectors, 64)
    return ivf.top_k_ivf(ivf.write_index(vectors, model, work_path(spark, "ivf")), vw.question(spark, d), model, k)


@query(f"SELECT {HITS} FROM l2_hit")
def topk_ivf(spark, d):
    return _hits(_ivf(spark, d))


def _other_sql(scored: str) -> str:
    """The three best hits of each question but for the question itself."""
    return f"""SELECT query_id, document_id, chunk_index, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY score DESC, document_id, chunk_index) AS INT) AS rank FROM {scored} WHERE vec_id <> query_id
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) <= 3"""


@query(f"""WITH {LSH_SQL}, {PROBED_SQL},
       all_scored AS (SELECT q.query_id, c.vec_id, c.document_id, c.chunk_index,
                      round(1 / (1 + pow(list_distance(q.v, c.v), 2)), 9) AS score FROM question q CROSS JOIN vec c),
       exact AS ({_other_sql('all_scored')}),
       found AS (SELECT 'lsh' AS method, * FROM ({_other_sql('lsh_scored')})
                 UNION ALL SELECT 'probed', * FROM ({_other_sql('probed_scored')}) UNION ALL SELECT 'ivf', * FROM exact)
       SELECT m.method, e.rank, count(*) AS exact, count(f.query_id) AS found, round(count(f.query_id) / count(*), 6) AS recall
       FROM exact e CROSS JOIN (SELECT unnest(['lsh', 'probed', 'ivf']) AS method) m LEFT JOIN found f
       ON f.method = m.method AND f.query_id = e.query_id AND f.document_id = e.document_id AND f.chunk_index = e.chunk_index
       GROUP BY m.method, e.rank""")
def topk_recall(spark, d):
    """How many of the exact hits other than the question itself each search finds, by their rank."""
    vectors, questions = vw.chunk_vector(spark, d), vw.question(spark, d)
    key = ["query_id", "document_id", "chunk_index"]
    own = vectors.select(F.col("vec_id").alias("query_id"), "document_id", "chunk_index")
    best = Window.partitionBy("query_id").orderBy("rank")

    def others(hits: DataFrame) -> DataFrame:
        left = hits.select(*key, "rank").join(own, key, "left_anti")
        return left.withColumn("rank", F.row_number().over(best)).where(f"rank <= {K.TOP_K}")

    more = K.TOP_K + 1
    searches = {"lsh": top_k_lsh(vectors, questions, k=more, metric="l2", **LSH), "probed": _probed(spark, d, more),
                "ivf": _ivf(spark, d, more)}
    named = [others(hits).select(*key, F.lit(name).alias("method"), F.lit(True).alias("hit")) for name, hits in searches.items()]
    found = named[0].unionByName(named[1]).unionByName(named[2])
    exact = others(top_k(vectors, questions, more, "l2")).withColumn(
        "method", F.explode(F.array(*map(F.lit, searches))))
    counts = exact.join(found, [*key, "method"], "left").groupBy("method", "rank").agg(
        F.count("*").alias("exact"), F.count("hit").alias("found"))
    return counts.withColumn("recall", F.round(F.col("found") / F.col("exact"), 6))


@query(f"SELECT id, role, md5(content) AS content_md5, {TIME.format('created_at')} AS created_at "
       "FROM chat_history WHERE session_id = '5' ORDER BY chat_history.created_at")
def history_by_session(spark, d):
    return history.by_session(vw.chat_history(spark, d), "5").select("id", "role", _md5("content"), _time("created_at"))


@query(f"SELECT id, session_id, {TIME.format('created_at')} AS created_at FROM chat_history "
       "WHERE knowledge_base_id = 'src4' ORDER BY chat_history.created_at DESC")
def history_by_kb(spark, d):
    return history.by_knowledge_base(vw.chat_history(spark, d), "src4").select("id", "session_id", _time("created_at"))


@query("""SELECT id, session_id, CAST(position AS INT) AS position, md5(content) AS content_md5 FROM (SELECT *, row_number() OVER
       (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS position FROM chat_history) WHERE position <= 3""")
def history_window(spark, d):
    return history.last_messages(vw.chat_history(spark, d), 3).select("id", "session_id", "position", _md5("content"))


# --- chunking and cleaning --------------------------------------------------------

@query("SELECT document_id, chunk_index, md5(content) AS content_md5 FROM chunk_text")
def chunk_fixed(spark, d):
    return vw.chunk_text(spark, d).select("document_id", "chunk_index", _md5("content"))


PARAGRAPHS = f"""paragraph AS (SELECT document_id, n, p FROM (SELECT doc_id AS document_id, generate_subscripts(ps, 1) AS n,
       unnest(ps) AS p FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(
       replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda p: trim(p, {TRIM})), lambda p: p <> '') AS ps
       FROM documents))),
       part AS (SELECT document_id, n, 0 AS i, p AS content FROM paragraph WHERE length(p) <= 500 UNION ALL
       SELECT document_id, n, i, substr(p, CAST(i * 450 + 1 AS BIGINT), 500) FROM (SELECT *, unnest(range(0,
       CAST(ceil(length(p) / 450.0) AS BIGINT))) AS i FROM paragraph WHERE length(p) > 500)),
       numbered AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY n, i) - 1 AS INT)
       AS chunk_index, content FROM part)"""


@query(f"WITH {PARAGRAPHS} SELECT document_id, chunk_index, md5(content) AS content_md5 FROM numbered")
def chunk_paragraph(spark, d):
    return chunk_documents(vw.paragraph_text(spark, d), "paragraph").select(
        "document_id", "chunk_index", _md5("content"))


@query(f"""WITH {PARAGRAPHS} SELECT 'fixed' AS strategy, document_id, count(*) AS n FROM chunk_text GROUP BY ALL
       UNION ALL SELECT 'Paragraph', document_id, count(*) FROM numbered GROUP BY ALL""")
def chunk_strategy(spark, d):
    def counted(strategy, texts):
        return (chunk_documents(texts, strategy).groupBy("document_id").agg(F.count("*").alias("n"))
                .select(F.lit(strategy).alias("strategy"), "document_id", "n"))

    return counted("fixed", vw.source_text(spark, d)).unionByName(counted("Paragraph", vw.paragraph_text(spark, d)))


# White space of the kinds the tables lack is put in front of every line break.
MESSY = "chr(12) || chr(13) || chr(10) || chr(9) || chr(11) || ' '"


@query(f"""SELECT document_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT document_id, {cleaned('m')} AS t
       FROM (SELECT doc_id AS document_id, replace(text, chr(10), {MESSY}) AS m FROM documents))""")
def clean_text(spark, d):
    messy = F.replace("text", F.lit("\n"), F.lit("\x0c\r\n\t\x0b "))
    cleaned = vw.source_text(spark, d).select("document_id", tx.clean_for_embedding(messy).alias("text"))
    return cleaned.select("document_id", F.length("text").cast("bigint").alias("n_chars"), _md5("text"))


# --- scalar functions -------------------------------------------------------------

@query("""SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM vec a JOIN vec b
       ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    rows = vw.chunk_vector(spark, d).select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select(
        "vec_id", F.round(vx.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("""SELECT document_id, chunk_index, CAST(70 + ((chunk_index + 1) * 30) // count(*) OVER (PARTITION BY document_id)
       AS INT) AS progress FROM chunk_text""")
def embed_progress(spark, d):
    # The number of chunks is known before they become rows, so nothing is shuffled.
    cut = vw.source_text(spark, d).select("document_id", fixed_chunks(F.col("text")).alias("chunks"))
    return (cut.select("document_id", F.size("chunks").alias("n"), F.posexplode("chunks").alias("chunk_index", "content"))
            .select("document_id", "chunk_index",
                    st.embedding_progress(F.col("chunk_index"), F.col("n")).alias("progress")))


PROMPT = (f"{literal(K.PROMPT_HEAD)} || c.context || {literal(K.PROMPT_QUESTION)} || q.message || {literal(K.PROMPT_TAIL)}")


@query(f"SELECT q.query_id, md5({PROMPT}) AS prompt_md5 FROM question q JOIN context c ON c.query_id = q.query_id")
def build_prompt(spark, d):
    return prompting.build_prompts(vw.question(spark, d), _contexts(spark, d)).select("query_id", _md5("prompt"))


@query(f"""SELECT query_id, CASE WHEN error IS NOT NULL THEN CASE WHEN error LIKE '%insufficient#_balance%' ESCAPE '#'
       OR error LIKE '%insufficient balance%' OR error LIKE '%1008%' THEN '{K.ANSWER_NO_BALANCE}'
       ELSE '{K.ANSWER_UNAVAILABLE}' END WHEN answer IS NULL OR answer = '' THEN '{K.ANSWER_NO_BALANCE}'
       ELSE answer END AS answer FROM model_outcome""")
def classify_answers(spark, d):
    return vw.model_outcome(spark, d).select(
        "query_id", prompting.classify_answer(F.col("answer"), F.col("error")).alias("answer"))


# --- user functions ---------------------------------------------------------------

@query("""SELECT document_id, chunk_index, md5(array_to_string(list_transform(counts, lambda c: CAST(c AS BIGINT)), ','))
       AS counts_md5 FROM hashed""")
def embed_hashing(spark, d):
    counted = embed(vw.chunk_text(spark, d), hashing_encoder(normalise=False))
    counts = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return counted.select("document_id", "chunk_index", F.md5(counts.cast("binary")).alias("counts_md5"))


@query("""SELECT document_id, chunk_index, copy, md5(array_to_string(list_transform(counts, lambda c: CAST(c AS BIGINT)), ','))
       AS counts_md5 FROM hashed, (SELECT unnest(['a', 'b']) AS copy)""")
def embed_cached(spark, d):
    """Every chunk twice; the second run finds the vectors of the first in the store."""
    store = work_path(spark, "vectors")
    chunks = vw.chunk_text(spark, d)
    copies = chunks.withColumn("copy", F.explode(F.array(F.lit("a"), F.lit("b"))))
    runs = [cached(rows, hashing_encoder(normalise=False), store) for rows in (
        copies.where("document_id % 2 = 0"), copies.where("document_id % 2 = 1"))]
    listed = F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",")
    return runs[0].unionByName(runs[1]).select("document_id", "chunk_index", "copy", F.md5(listed.cast("binary")).alias("counts_md5"))


@query("""SELECT c.query_id, md5(t.content) AS answer_md5 FROM context c JOIN kb_hit h ON h.query_id = c.query_id AND h.rank = 1
       JOIN vector_text t USING (document_id, chunk_index)""")
def batch_answers(spark, d):
    prompts = prompting.build_prompts(vw.question(spark, d), _contexts(spark, d))
    return generate(prompts, first_chunk_model).select("query_id", _md5("answer"))


# --- pipelines --------------------------------------------------------------------

@query(f"""SELECT document_id, CASE WHEN bad THEN 'FAILED' ELSE 'COMPLETED' END AS status,
       CASE WHEN bad THEN 30 ELSE 100 END AS progress,
       CASE WHEN bad THEN 0 ELSE CAST(ceil(length(text) / 450.0) AS INT) END AS chunk_count,
       CASE WHEN bad THEN '{K.MSG_NO_TEXT}' END AS error_message FROM (SELECT *,
       status = 'FAILED' OR text IS NULL OR trim(text, {TRIM}) = '' AS bad FROM doc)""")
def process_documents(spark, d):
    found = processing.outcomes(vw.extracted(spark, d), hashing_encoder())
    return processing.status_of(found).drop("knowledge_base_id")


# Plain text; a format with a parser, which fails on some files; a format without one.
FILE_TYPE = "CASE document_id % 10 WHEN 3 THEN 'pdf' WHEN 4 THEN 'doc' ELSE 'txt' END"
DAMAGED = "document_id % 20 = 3"


@query(f"""WITH file AS (SELECT *, {FILE_TYPE} AS kind, {DAMAGED} AS damaged,
       status = 'FAILED' OR text IS NULL OR trim(text, {TRIM}) = '' AS blank FROM doc),
       bad AS (SELECT *, kind = 'doc' OR (kind = 'pdf' AND damaged) OR blank AS failed FROM file)
       SELECT knowledge_base_id, 'doc_' || document_id || '.' || kind AS file_name, CASE WHEN failed THEN 'FAILED' ELSE 'COMPLETED' END AS status,
       CASE WHEN failed THEN 30 ELSE 100 END AS progress,
       CASE WHEN failed THEN 0 ELSE CAST(ceil(length(text) / 450.0) AS INT) END AS chunk_count,
       CASE WHEN kind = 'doc' THEN '{K.MSG_TYPE_UNSUPPORTED}doc{K.MSG_TYPE_HINT}'
            WHEN kind = 'pdf' AND damaged THEN 'damaged file' WHEN blank THEN '{K.MSG_NO_TEXT}' END AS error_message FROM bad""")
def stream_ingest(spark, d):
    out = work_path(spark, "ingest")
    content = F.concat(F.when(F.expr(DAMAGED), "!").otherwise("."), F.coalesce("text", F.lit("")))
    kind = F.expr(FILE_TYPE)
    found = vw.extracted(spark, d).select(
        "knowledge_base_id", F.concat(F.lit("doc_"), F.col("document_id").cast("string"), F.lit("."), kind).alias("file_name"),
        F.when(kind == "pdf", content).otherwise(F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    write_files(found, f"{out}/uploads")

    def parse(content: bytes) -> str:
        if content.startswith(b"!"):
            raise ValueError("damaged file")
        return content[1:].decode()

    jobs.ingest(spark, f"{out}/uploads", f"{out}/tables", f"{out}/checkpoint", hashing_encoder(16), "*",
                parsers={"pdf": parse}).awaitTermination()
    return jobs.ingested_documents(spark, f"{out}/tables").select(
        "knowledge_base_id", "file_name", "status", "progress", "chunk_count", "error_message")


ANSWER_SQL = f"""SELECT q.query_id, CASE WHEN h.query_id IS NULL THEN md5('{K.ANSWER_NO_DOCUMENTS}') ELSE md5(h.content) END AS answer_md5,
       s.sources FROM asked_text q LEFT JOIN hashed_hit h ON h.query_id = q.query_id AND h.rank = 1
       LEFT JOIN (SELECT query_id, string_agg(document_id || '_' || chunk_index, ' ' ORDER BY rank) AS sources
       FROM hashed_hit GROUP BY 1) s ON s.query_id = q.query_id"""


@query(ANSWER_SQL)
def answer_questions(spark, d):
    # What is not asked for is left out before the encoder, which filters don't pass.
    documents = vw.document(spark, d)
    chunks = retrieval.asked_chunks(documents, vw.chunk_text(spark, d), vw.asked_text(spark, d))
    answers = answering.answer_questions(documents, embed(chunks, hashing_encoder()), vw.hashed_questions(spark, d), chosen=True)
    listed = F.array_join(F.transform("sources", lambda s: s["source"]), " ")
    return answers.select("query_id", _md5("answer"), listed.alias("sources"))


@query(ANSWER_SQL)
def stream_answers(spark, d):
    """Questions as a stream, each answered once from the chunks as they are when it comes."""
    out = work_path(spark, "answers")
    asked = vw.asked_text_stream(spark, d)

    def snapshot(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        documents = vw.document(spark, d)
        return documents, embed(retrieval.asked_chunks(documents, vw.chunk_text(spark, d), batch), hashing_encoder())

    jobs.answer_stream(asked.union(asked), snapshot, hashing_encoder(), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    listed = F.array_join(F.transform("sources", lambda s: s["source"]), " ")
    return jobs.stream_answered(spark, f"{out}/table").select("query_id", _md5("answer"), listed.alias("sources"))


@query("""SELECT query_id, string_agg(rank || ':' || document_id || '_' || chunk_index, ' ' ORDER BY rank) AS sources,
       round(max(score), 6) AS best FROM kb_hit GROUP BY query_id""")
def answer_sources(spark, d):
    listed = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["rank"].cast("string"), s["source"])), " ")
    return prompting.sources(_kb_hits(spark, d)).select(
        "query_id", listed.alias("sources"), F.round(F.get("sources", 0)["score"], 6).alias("best"))


@query(f"""SELECT q.query_id, md5({literal(K.PROMPT_HEAD)} || c.context || coalesce({literal(K.HISTORY_HEAD)} || h.history, '')
       || {literal(K.PROMPT_QUESTION)} || q.message || {literal(K.PROMPT_TAIL)}) AS prompt_md5
       FROM question q JOIN context c ON c.query_id = q.query_id LEFT JOIN (SELECT session_id,
       string_agg(role || ': ' || content, chr(10) ORDER BY created_at, id) AS history FROM (SELECT *, row_number() OVER
       (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS r FROM chat_history) WHERE r <= 4 GROUP BY 1) h
       ON h.session_id = q.session_id""")
def prompt_with_history(spark, d):
    window = history.last_messages(vw.chat_history(spark, d), 4)
    return prompting.build_prompts_with_history(vw.question(spark, d), _contexts(spark, d), window).select(
        "query_id", _md5("prompt"))


@query("""SELECT kb.id, name, CASE WHEN f.n > 0 THEN 'failed documents: ' || f.n ELSE description END AS description,
       strftime(CASE WHEN f.n > 0 THEN TIMESTAMP '2024-06-01' ELSE created_at END, '%Y-%m-%d %H:%M:%S') AS updated_at
       FROM kb LEFT JOIN (SELECT knowledge_base_id, count(*) AS n FROM doc WHERE status = 'FAILED' GROUP BY 1) f
       ON f.knowledge_base_id = kb.id""")
def kb_update(spark, d):
    kbs = vw.knowledge_base(spark, d)
    failed = vw.document(spark, d).where(st.is_failed(F.col("status")))
    counts = catalog.document_counts(kbs, failed).where("document_count > 0")
    changes = counts.select("id", F.col("id").alias("name"), F.concat(
        F.lit("failed documents: "), F.col("document_count").cast("string")).alias("description"))
    now = F.expr("timestamp_ntz'2024-06-01 00:00:00'")
    return catalog.update_kbs(kbs, changes, now).select("id", "name", "description", _time("updated_at"))


@query("SELECT id, knowledge_base_id FROM chat_history WHERE knowledge_base_id <> 'src3'")
def clear_kb_history(spark, d):
    listed = catalog.where_equal(vw.knowledge_base(spark, d), id="src3").select(F.col("id").alias("knowledge_base_id"))
    return history.delete_by(vw.chat_history(spark, d), listed, "knowledge_base_id").select("id", "knowledge_base_id")


# --- streaming --------------------------------------------------------------------

@query("SELECT document_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM latest")
def latest_status(spark, d):
    return lifecycle.latest_status(vw.status_event(spark, d)).select("document_id", "status", _time("ts"))


@query("SELECT document_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM latest")
def stream_latest_status(spark, d):
    out = work_path(spark, "status")
    jobs.follow_status(vw.status_event_stream(spark, d), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return jobs.followed_status(spark, f"{out}/table").select("document_id", "status", _time("ts"))


@query(f"SELECT id, role, md5(content) AS content_md5, {TIME.format('created_at')} AS created_at FROM chat_history")
def stream_history(spark, d):
    out = work_path(spark, "history")
    jobs.log_messages(vw.chat_history_stream(spark, d), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return jobs.logged_messages(spark, f"{out}/table").select("id", "role", _md5("content"), _time("created_at"))


STUCK_AFTER = 6 * 3600
_ENDED = "('FAILED', 'COMPLETED')"
_STAGES_SQL = "['" + "', '".join(stateful.STAGES) + "']"


@query(f"""SELECT document_id, status, {TIME.format('since')} AS since, accepted, refused,
       stuck_stages + CAST(coalesce(NOT stuck AND status NOT IN {_ENDED} AND epoch_us(w) - epoch_us(since) > {STUCK_AFTER}000000, false) AS BIGINT) AS stuck_stages,
       stuck OR coalesce(status NOT IN {_ENDED} AND epoch_us(w) - epoch_us(since) > {STUCK_AFTER}000000, false) AS stuck
       FROM (WITH RECURSIVE mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM status_event),
       ordered AS (SELECT document_id, status, ts, w, row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id) AS n
                   FROM status_event, mark WHERE ts < w),
       walk AS (SELECT DISTINCT document_id, w, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS since,
                CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS stuck_stages, false AS stuck FROM ordered
                UNION ALL SELECT document_id, w, n, CASE WHEN ok THEN new ELSE status END, CASE WHEN ok THEN ts ELSE since END,
                accepted + CAST(ok AS BIGINT), refused + CAST(NOT ok AS BIGINT), stuck_stages + CAST(late AS BIGINT),
                CASE WHEN ok THEN false ELSE stuck OR late END FROM (
                SELECT b.document_id, b.w, o.n, b.status, b.since, b.accepted, b.refused, b.stuck_stages, b.stuck, o.status AS new, o.ts,
                coalesce(NOT b.stuck AND b.status NOT IN {_ENDED} AND epoch_us(o.ts) - epoch_us(b.since) > {STUCK_AFTER}000000, false) AS late,
                CASE WHEN o.status = 'UPLOADING' THEN b.status IS NULL OR b.status IN {_ENDED}
                     WHEN b.status IS NULL OR b.status IN {_ENDED} THEN false WHEN o.status = 'FAILED' THEN true
                     ELSE coalesce(list_position({_STAGES_SQL}, o.status) > list_position({_STAGES_SQL}, b.status), false) END AS ok
                FROM walk b JOIN ordered o ON o.document_id = b.document_id AND o.n = b.n + 1))
       SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC) = 1)""")
def stream_status_machine(spark, d):
    """Status per document with refused moves and stages that lasted longer than six hours."""
    out = work_path(spark, "machine")
    stateful.follow_machine(vw.status_event_stream(spark, d), f"{out}/table", f"{out}/checkpoint",
                            stuck_after=STUCK_AFTER).awaitTermination()
    return stateful.machine_status(spark, f"{out}/table").select(
        "document_id", "status", _time("since"), "accepted", "refused", "stuck_stages", "stuck")


@query(f"""WITH marked AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY document_id ORDER BY ts, event_id) >= INTERVAL 3 HOUR, true) AS fresh
       FROM status_event WHERE ts IS NOT NULL),
       numbered AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY document_id ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM marked)
       SELECT CAST(document_id AS VARCHAR) AS session_id, {TIME.format('min(ts)')} AS first_at, {TIME.format('max(ts)')} AS last_at,
       count(*) AS messages FROM numbered GROUP BY document_id, n
       HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM status_event)""")
def stream_sessions(spark, d):
    """Closed sessions of a stream in which every message comes twice."""
    out = work_path(spark, "sessions")
    events = vw.status_event_stream(spark, d).select(
        F.col("event_id").cast("string").alias("id"), F.col("document_id").cast("string").alias("session_id"),
        F.col("ts").alias("created_at"))
    stateful.follow_sessions(events.union(events), f"{out}/table", f"{out}/checkpoint", gap="3 hours").awaitTermination()
    return stateful.closed_sessions(spark, f"{out}/table").select(
        "session_id", _time("first_at"), _time("last_at"), "messages")


ROWS_OF_CHANGES = 250_000  # in a file


@query("""SELECT knowledge_base_id, count(*) AS document_count, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
       count(*) FILTER (WHERE status IN ('UPLOADING', 'PARSING', 'CHUNKING', 'EMBEDDING')) AS processing,
       count(*) FILTER (WHERE contains(status, 'FAILED')) AS failed FROM doc GROUP BY 1""")
def incremental_counts(spark, d):
    """Counts after three steps of changes: arrival, processing, deletion of as many other documents."""
    out = work_path(spark, "counts")
    documents = vw.document(spark, d).select("document_id", "knowledge_base_id", "status")
    others = documents.select((-1 - F.col("document_id")).alias("document_id"), "knowledge_base_id", F.lit("FAILED").alias("status"))
    both = documents.unionByName(others)
    steps = [both.withColumn("status", F.lit("UPLOADING")), both, others.withColumn("status", F.lit(None).cast("string"))]
    # Files by the number of rows, so that a micro-batch of four has work enough whatever the tasks that write them.
    files = max(4, -(-2 * vw.documents_count(spark, d) // ROWS_OF_CHANGES))
    for seq, rows in enumerate(steps):
        (rows.withColumn("seq", F.lit(seq).cast("long")).withColumn("deleted", F.lit(seq == 2)).repartition(files)
         .write.mode("append").parquet(f"{out}/changes"))
    schema = "document_id bigint, knowledge_base_id string, status string, seq bigint, deleted boolean"
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{out}/changes")
    stateful.follow_counts(changes, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return stateful.followed_counts(spark, f"{out}/table")
