"""The same comparison on a harder copy of the tables: a third of the rows in one
source, session or document, many copies of one text and one vector, odd texts."""

import shutil

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as driver

from test_queries import FOLDER, TABLES, _sorted

ODD = [None, "", "   \t\n", "a\fb\r\n\r\nc\x0b\x0bd", "😀" * 700, "x" * 450, "x" * 451, "x" * 500, "\n\n\n", "é" * 950,
       "tab\tand\x01ctl", "line\n\n\n\nline two\n \nthree", "  lead" + "y" * 1300, "　 "]
QUERIES = ("blank_text_documents", "build_context", "chunk_fixed", "chunk_paragraph", "clean_text", "delete_kb_cascade",
           "delete_sessions", "document_status", "embed_hashing", "embed_progress", "history_window", "kb_readiness",
           "latest_status", "prior_turns", "process_documents", "answer_questions", "retrieve_kb", "session_list",
           "retrieve_global_then_filter", "stream_history", "stream_latest_status", "topk_l2", "topk_lsh",
           "upload_validation", "upsert_documents", "vector_encode")


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hard")

    def change(name, edit):
        table = pq.read_table(f"{FOLDER}/{name}.parquet")
        frame = edit(table.to_pandas())
        pq.write_table(pa.Table.from_pandas(frame, schema=table.schema.remove_metadata(), preserve_index=False),
                       f"{folder}/{name}.parquet", row_group_size=max(1, len(frame) // 5))

    def documents(df):
        df.loc[df.doc_id % 3 == 0, "source"] = "src0"
        df.loc[df.doc_id % 5 == 1, "text"] = df.loc[1, "text"]
        for i, text in enumerate(ODD):
            df.loc[i * 7, "text"] = text
        return df

    def conversations(df):
        df.loc[df.index % 3 == 0, "conv_id"] = 5
        df["turn"] = df.groupby("conv_id").cumcount()
        return df

    def events(df):
        df.loc[df.index % 3 == 0, "user_id"] = 17
        return df

    def embeddings(df):
        hot = df.embedding[0]
        df["embedding"] = pd.Series([hot if i % 3 == 0 else v for i, v in enumerate(df.embedding)])
        return df

    def benchmark(df):
        df.loc[3, "text"] = " \n "
        return df

    for edit in (documents, conversations, events, embeddings, benchmark):
        change(edit.__name__, edit)
    for name in ("pages", "labels"):
        shutil.copyfile(f"{FOLDER}/{name}.parquet", f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, hard, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{hard}/{table}.parquet'")
    df = driver.queries()[name](spark, hard)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    result = connection.execute(driver.oracle_sql()[name])
    names = [column[0] for column in result.description]
    order = [names.index(c) for c in columns]
    assert _sorted(got) == _sorted([tuple(row[i] for i in order) for row in result.fetchall()])
