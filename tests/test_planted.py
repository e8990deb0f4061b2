"""Queries that find nothing in the given tables, on tables with planted cases."""

import os

import pytest

from quernstone.operators import booklet, corpus, pages, records, repair
from quernstone.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture
def plant(spark, tmp_path):
    """Writes tables of the given tables' schemas, with nulls where a case says nothing."""

    def write(**tables):
        for name, rows in tables.items():
            schema = table(spark, DATA, name).schema
            spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def found(df):
    return {tuple(r) for r in df.collect()}


def test_missing_numbers(spark, plant):
    rows = [{"id": f"{s}-{n}", "sessionId": "S", "section": s, "qno": n} for n, s in ((1, None), (2, "am2"), (5, "am2"), (1, "am1"), (9, "pm"))]
    assert found(corpus.q_missing_numbers(spark, plant(questions=rows))) == {("S", "am2", 3), ("S", "am2", 4)}


def test_second_readings(spark, plant):
    line = lambda t, y: (t, 0.9, 0.1, y, 0.5, 0.02)
    long = "後" * 200
    rows = [
        {"file": "ocr/S/A/p001.json", "lines": [line("鍵の理を", 0.1), line("行う）。", 0.2)], "tesseract": "鍵の管理を\n（行う）。" + long},
        {"file": "ocr/S/A/p002.json", "lines": [line("同じ", 0.1)], "tesseract": "同じ"},
        {"file": "ocr/S/A/p003.json", "lines": [line("無し", 0.1)], "tesseract": None},
        {"file": "ocr/S/A/p004.json", "lines": [], "tesseract": ""},
    ]
    folder = plant(ocr_pages=rows)
    assert found(pages.q_dropped_by_one(spark, folder)) == {("ocr/S/A/p001.json", "後管")}
    assert found(booklet.q_restored_kanji(spark, folder)) == {("ocr/S/A/p001.json", "鍵の管理を\n行う）。")}
    assert [r["text"] for r in repair.q_restored_brackets(spark, folder).collect()] == ["鍵の理を（行う）。"]  # the blank or line end that a lost glyph left is its place


def test_brackets_and_words(spark, plant):
    rows = [{"id": "a", "text": "値）を〕見る", "explanation": "authentication"}, {"id": "b", "text": "a) 甲\n（乙）", "explanation": None}, {"id": "c", "text": "the authentica tion と authentica tion", "explanation": ""}, {"id": "d"}]
    folder = plant(questions=rows)
    assert found(repair.q_bracket_gaps(spark, folder)) == {("a", 1, 1)}
    assert found(repair.q_rejoined_words(spark, folder)) == {("authentication", 2)}


def test_blanks_of_cases(spark, plant):
    block = lambda t: ("para", t, 1, False)
    cases = [{"id": "C1", "blanks": ["a", "b"], "body": [block("［　］と［ b ］")]}, {"id": "C2", "blanks": ["x"], "body": [block("［　］と［　］")]}, {"id": "C3", "blanks": ["p", "q"], "body": [block("［　］")]}, {"id": "C4", "blanks": None, "body": None}]
    rows = [{"id": "i1", "caseId": " C1", "text": "［ a ］に入れる"}, {"id": "i2", "caseId": "C1", "text": "［ｃ］と［c］"}, {"id": "i3", "caseId": "C9", "text": "［a］"}, {"id": "i4", "caseId": None, "text": "［a］"}]
    folder = plant(cases=cases, questions=rows)
    assert found(records.q_blank_mapping(spark, folder)) == {("C1", 0, "a"), ("C1", 1, "b"), ("C2", 0, "x"), ("C2", 1, "x")}
    assert found(records.q_item_blanks(spark, folder)) == {("i1", "a", True), ("i2", "c", False), ("i3", "a", False)}


def test_hits_of_all_valid_rules(spark, plant):
    rules = [{"ord": 1, "pattern": "(?<=[A-Za-z])1(?=[a-z])", "repl": "l"}, {"ord": 2, "pattern": "fede-\nration", "repl": "federation"}, {"ord": 3, "pattern": "ログ(イソ", "repl": "x"}, {"ord": 4, "pattern": "険証", "repl": "検証"}]
    rows = [{"id": "a", "text": "c1ass と c1ient"}, {"id": "b", "text": "a1b 険証"}, {"id": "c", "text": "federation"}, {"id": "d"}]
    assert found(repair.q_pattern_hits(spark, plant(questions=rows, corrections=rules))) == {(1, 2), (2, 1), (4, 1)}
