import pytest
from pyspark.sql import functions as F

from corpusflow.operators import catalog, history, lifecycle, prompting
from corpusflow import constants as K


@pytest.fixture(scope="module")
def kbs(spark):
    return spark.createDataFrame([("k1", "测试知识库"), ("k2", "other")], "id string, name string")


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_create_new_name(spark, kbs):
    asked = spark.createDataFrame([(1, "测试")], "request_id int, name string")
    assert pairs(catalog.validate_new_kbs(asked, kbs), "request_id", "reason") == [(1, None)]


def test_create_taken_blank_and_repeated_names(spark, kbs):
    asked = spark.createDataFrame([(1, "测试知识库"), (2, " \t"), (3, None), (4, "new"), (5, "new"), (6, "new ")],
                                  "request_id int, name string")
    reasons = dict(pairs(catalog.validate_new_kbs(asked, kbs), "request_id", "reason"))
    assert reasons == {1: "知识库名称已存在: 测试知识库", 2: "name is blank", 3: "name is blank", 4: None,
                       5: "知识库名称已存在: new", 6: None}


def test_list_and_lookup(kbs):
    assert kbs.count() == 2
    assert catalog.kb_by_id(kbs, "k1").first()["name"] == "测试知识库"


def test_missing_kb(kbs):
    with pytest.raises(LookupError, match="知识库不存在"):
        catalog.kb_by_id(kbs, "nope")


def test_uploads(spark, kbs):
    documents = spark.createDataFrame([("k1", "old.txt")], "knowledge_base_id string, file_name string")
    uploads = spark.createDataFrame(
        [(1, "k1", "a.txt"), (2, "k9", "a.txt"), (3, "k1", "a.exe"), (4, "k1", None), (5, "k1", "A.PDF"),
         (6, "k1", "old.txt"), (7, "k1", "a.txt"), (8, "k2", "old.txt"), (9, None, "a.txt")],
        "upload_id int, knowledge_base_id string, file_name string")
    got = {r["upload_id"]: (r["file_type"], r["reason"])
           for r in catalog.validate_uploads(uploads, kbs, documents).collect()}
    assert {k for k, (_, reason) in got.items() if reason is None} == {1, 5, 8}
    assert got[2][1] == "知识库不存在: k9" and got[9][1].startswith("知识库不存在: ")
    assert got[3][1].startswith("不支持的文件类型: ，仅支持") and got[4][1] == got[3][1]
    assert got[5][0] == "pdf"
    assert got[6][1] == "文件已存在: old.txt" and got[7][1] == "文件已存在: a.txt"


def test_often_repeated_upload_is_judged_per_row(spark, kbs):
    documents = spark.createDataFrame([], "knowledge_base_id string, file_name string")
    uploads = spark.range(3000).selectExpr(
        "id AS upload_id", "'k1' AS knowledge_base_id",
        "if(id % 3 = 0, 'hot.txt', concat(id, '.txt')) AS file_name")
    got = catalog.validate_uploads(uploads, kbs, documents)
    assert got.count() == 3000 and got.where("reason IS NULL").count() == 2001
    assert got.where("file_name = 'hot.txt' AND reason IS NULL").first()["upload_id"] == 0


def test_upsert(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changed = spark.createDataFrame([("B", 2), ("c", 3)], "v string, id int")
    assert pairs(catalog.upsert(stored, changed, ["id"]), "id", "v") == [(1, "a"), (2, "B"), (3, "c")]


def test_create_and_update(spark):
    moment = lambda text: F.lit(text).cast("timestamp")
    stored = catalog.create_kbs(
        spark.createDataFrame([(1, "a", "first"), (2, "b", None), (3, "a", "again")],
                              "request_id int, name string, description string"),
        spark.createDataFrame([], "id string, name string"), moment("2024-01-01 00:00:00"))
    assert pairs(stored, "name", "description") == [("a", "first"), ("b", None)]
    changes = stored.where("name = 'b'").select("id", F.lit("c").alias("name"), F.lit("new").alias("description"))
    got = pairs(catalog.update_kbs(stored, changes, moment("2024-02-01 00:00:00")), "name", "description",
                F.month("created_at"), F.month("updated_at"))
    assert got == [("a", "first", 1, 1), ("c", "new", 1, 2)]


def test_deletes_and_orphans(spark, kbs):
    documents = spark.createDataFrame([("a", "k1"), ("b", "k2")], "document_id string, knowledge_base_id string")
    chunks = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("x", 0)], "document_id string, chunk_index int")
    talk = spark.createDataFrame([("1", "k1"), ("2", "k2")], "id string, knowledge_base_id string")
    listed = spark.createDataFrame([("b",)], "document_id string")
    left, kept = catalog.delete_documents(documents, chunks, listed)
    assert pairs(left, "document_id") == [("a",)] and pairs(kept, "document_id") == [("a",), ("x",)]
    assert pairs(catalog.orphan_chunks(documents, chunks), "document_id") == [("x",)]
    four = catalog.delete_kbs(kbs, documents, chunks, talk, spark.createDataFrame([("k2",)], "id string"))
    assert [pairs(df, df.columns[0]) for df in four] == [[("k1",)], [("a",)], [("a",), ("x",)], [("1",)]]


def test_vector_ids(spark):
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "document_id string, chunk_index int")
    assert pairs(catalog.vector_ids(chunks, "a"), "id") == [("a_0",), ("a_1",)]
    assert catalog.vector_ids(chunks, "a", 1).count() == 1


def test_counts_include_empty_kbs(spark, kbs):
    documents = spark.createDataFrame([("a", "k1"), ("b", "k1")], "document_id string, knowledge_base_id string")
    assert pairs(catalog.document_counts(kbs, documents), "id", "document_count") == [("k1", 2), ("k2", 0)]


def test_document_status(spark):
    documents = spark.createDataFrame([("all",), ("part",), ("none",), ("no chunk",)], "document_id string")
    outcomes = spark.createDataFrame([("all", True), ("part", True), ("part", False), ("part", True), ("none", False)],
                                     "document_id string, ok boolean")
    got = {r["document_id"]: (r["status"], r["chunk_count"], r["error_message"])
           for r in lifecycle.document_status(documents, outcomes).collect()}
    assert got == {"all": ("COMPLETED", 1, None), "part": ("COMPLETED", 2, "部分切片向量化失败，成功: 2, 失败: 1"),
                   "none": ("FAILED", 0, "所有切片向量化失败"), "no chunk": ("FAILED", 0, "所有切片向量化失败")}


def test_history(spark):
    talk = spark.createDataFrame(
        [("1", "s", "k", "user", "x" * 21, "2024-01-01 10:00:00"), ("2", "s", "k", "assistant", "yes", "2024-01-01 10:00:05"),
         ("3", "s", "k", "user", "more", "2024-01-01 10:00:05"), ("4", "t", "j", "user", "x" * 20, "2024-01-02 00:00:00")],
        "id string, session_id string, knowledge_base_id string, role string, content string, created_at string"
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [r["id"] for r in history.by_session(talk, "s").collect()] == ["1", "2", "3"]
    assert [r["id"] for r in history.by_knowledge_base(talk, "k").collect()] == ["3", "2", "1"]
    listed = [(r["session_id"], r["title"], r["last_date"]) for r in history.sessions(talk).collect()]
    assert listed == [("t", "x" * 20, "2024/1/2"), ("s", "x" * 20 + "...", "2024/1/1")]
    assert pairs(history.last_messages(talk, 2), "id", "position") == [("2", 2), ("3", 1), ("4", 1)]
    assert pairs(history.prior_turns(talk), "id") == [("1",), ("2",)]
    assert pairs(history.delete_by(talk, talk.where("id = '2'"), "session_id"), "id") == [("4",)]
    assert history.messages(talk).columns == ["role", "content"]


def test_contexts_and_prompts(spark):
    hits = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (2, 1, "only")], "query_id int, rank int, content string")
    contexts = prompting.build_context(hits)
    text = dict(pairs(contexts, "query_id", "context"))
    assert text[1] == "参考文档：\n\n【文档1】\none\n\n【文档2】\ntwo\n\n"
    asked = spark.createDataFrame([(1, "什么是数据表？"), (3, "no context")], "query_id int, message string")
    prompt = prompting.build_prompts(asked, contexts).collect()
    assert len(prompt) == 1
    assert prompt[0]["prompt"].startswith("你是一个专业的智能问答助手")
    assert f"=== 参考文档 ===\n{text[1]}\n\n=== 用户问题 ===\n什么是数据表？\n\n=== 回答要求 ===\n" in prompt[0]["prompt"]
    assert prompt[0]["prompt"].endswith("=== 回答 ===\n")


@pytest.mark.parametrize("answer,error,told", [
    ("text", None, "text"), (None, None, K.ANSWER_NO_BALANCE), ("", None, K.ANSWER_NO_BALANCE),
    (None, "x insufficient_balance", K.ANSWER_NO_BALANCE), (None, "code 1008", K.ANSWER_NO_BALANCE),
    (None, "insufficient balance", K.ANSWER_NO_BALANCE), (None, "timeout", K.ANSWER_UNAVAILABLE),
    (None, "", K.ANSWER_UNAVAILABLE)])
def test_classification(spark, answer, error, told):
    df = spark.createDataFrame([(answer, error)], "answer string, error string")
    assert df.select(prompting.classify_answer(df.answer, df.error)).first()[0] == told


def test_a_name_that_another_knowledge_base_has_is_refused(spark):
    schema = "id string, name string, description string"
    stored = spark.createDataFrame([("1", "one", "a"), ("2", "two", "b"), ("3", "three", "c")], schema)
    stored = stored.withColumn("updated_at", F.lit(None).cast("timestamp"))
    changes = spark.createDataFrame([("1", "two", "x"), ("2", " \t", "x"), ("3", "three", "new text"), ("9", "free", "x")], schema)
    judged = {r.id: r.reason for r in catalog.validate_renames(changes, stored).collect()}
    assert judged["1"].endswith("two") and judged["2"] == "name is blank" and judged["3"] is None
    got = {r.id: (r.name, r.description) for r in catalog.update_kbs(stored, changes).collect()}
    assert got == {"1": ("one", "a"), "2": ("two", "b"), "3": ("three", "new text")}
    both = spark.createDataFrame([("1", "new", "x"), ("2", "new", "y")], schema)
    assert {r.id: r.name for r in catalog.update_kbs(stored, both).collect()} == {"1": "new", "2": "two", "3": "three"}
