import pytest
from pyspark.sql import functions as F

from corpusflow.functions import status as st
from corpusflow.functions import text as tx
from corpusflow.functions import vectors as vx


def test_file_type(rows):
    names = {"a.pdf": "pdf", "A.PDF": "pdf", "b.tar.Docx": "docx", "c.exe": "", "pdf": "", ".txt": "txt",
             "d.": "", "": "", None: "", "e.txt\n": ""}
    got = rows([(n,) for n in names], "n string", tx.file_type(F.col("n")))
    assert [g[0] for g in got] == list(names.values())


def test_trimming_and_blank(rows):
    texts = [None, "", " \t\r\n\x00\x01", "　", " ", " a　", "\x0b\x0cx\x1f"]
    got = rows([(t,) for t in texts], "t string", tx.trim_control(F.col("t")), tx.has_text(F.col("t")),
               tx.is_blank(F.col("t")))
    assert got == [(None, False, True), ("", False, True), ("", False, False), ("　", True, True),
                   (" ", True, False), ("a　", True, False), ("x", True, False)]


def test_cleaning(rows):
    cases = {"a\fb": "ab", "a\r\nb": "a b", "a\t\t \x0b b": "a b", "\x01 a \x02": "a", " \n ": " \n ",
             "": "", "x\f\ny": "x y", "　\n　": "　\n　", None: None}
    got = rows([(t,) for t in cases], "t string", tx.clean_for_embedding(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_titles_and_dates(rows):
    got = rows([("x" * 20, "2024-03-05 01:02:03"), ("x" * 21, None)], "t string, d string",
               tx.session_title(F.col("t")), tx.display_date(F.col("d").cast("timestamp")))
    assert got == [("x" * 20, "2024/3/5"), ("x" * 20 + "...", "")]


def test_uuid(rows):
    got = rows([("123e4567-e89b-12d3-a456-426614174000",), ("doc-1",), ("",), (None,)], "t string",
               tx.is_uuid(F.col("t")))
    assert [g[0] for g in got] == [True, False, False, False]


def test_vector_text(rows):
    cases = {None: [], "": [], "[": [], "[]": [], "[1,2]": [], "[a, 1]": [], "[0.5, 2.0]": [0.5, 2.0],
             "[1.0, ]": [1.0], "[, ]": [], "[7]": [7.0], "[1.0,  2.0]": [1.0, 2.0], "[1e-3, NaN1]": []}
    got = rows([(t,) for t in cases], "t string", vx.decode(F.col("t")))
    assert [list(g[0]) for g in got] == list(cases.values())
    assert rows([([0.5, -2.0, 100.0],)], "v array<float>", vx.encode(F.col("v"))) == [("[0.5, -2.0, 100.0]",)]


def test_cosine_guards(rows):
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [-1.0, -2.0]),
             ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([3.0, 4.0], [4.0, 3.0])]
    got = rows(pairs, "a array<float>, b array<float>", vx.cosine(F.col("a"), F.col("b")),
               vx.cosine(F.col("b"), F.col("a")))
    assert [g[0] for g in got] == pytest.approx([1, 0, -1, 0, 0, 0.96])
    assert all(a == b for a, b in got)


def test_distance_score(rows):
    got = rows([([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>",
               vx.distance_score(vx.squared_distance(F.col("a"), F.col("b"))))
    assert got == [(1 / 3,), (1.0,), (None,)]


def test_status_expressions(rows):
    got = rows([("UPLOADING",), ("PARSE_FAILED",), ("COMPLETED",), ("other",), (None,)], "s string",
               st.is_processing(F.col("s")), st.is_failed(F.col("s")), st.label(F.col("s")),
               st.stage_progress(F.col("s")))
    assert got == [(True, False, "上传中", 10), (False, True, "解析失败", None), (False, False, "已完成", 100),
                   (False, False, "other", None), (False, False, None, None)]


def test_embedding_progress(rows):
    cases = {(0, 3): 80, (1, 3): 90, (2, 3): 100, (0, 7): 74, (0, 0): 100}
    got = rows(list(cases), "i int, n int", st.embedding_progress(F.col("i"), F.col("n")))
    assert [g[0] for g in got] == list(cases.values())
