"""Correction rules: all valid ones in order, against plain Python."""

import os
import re

import pytest

from quernstone.operators.repair import q_corrected_texts, rejoined
from quernstone.session import table

DATA = "/root/testdata/sf0.001"
RULES = [
    (1, "fede-\nration(?=の)", "federation"), (2, "detectiori\n− 2l −", "detection"), (3, "第6期 春期\niso1ation", "isolation"), (4, "(?<=[ァ-ヶー])口|口(?=[ァ-ヶー])", "ロ"), (5, "ログ(イソ", "ログイン"),
    (6, "(?<=[A-Za-z])1(?=[a-z])", "l"), (7, r"(?P<a>Q)(\d)", r"\g<a>-\2"), (8, "x", r"\9"), (9, None, "y"), (10, "", "z"), (11, "険証", "検証"),
]


@pytest.mark.parametrize(("pattern", "repl", "want"), [("fede-\nration(?=の)", "federation", "federation(?=の)"), ("end-\nto-end", "end-to-end", "end-to-end"), ("険証\n- 25 -", "検証", "険証"), ("IH Examination AM2  第6期 春期\nclassifica tion", "classification", "classifica tion")])
def test_rejoined(pattern, repl, want):
    assert rejoined(pattern, repl) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_all_valid_rules(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(RULES, "ord int, pattern string, repl string").write.parquet(f"{folder}/corrections.parquet")
    given = table(spark, DATA, "questions").limit(1)
    texts = ["fede-\nrationの", "detectiori と iso1ation", "口グイン", "ログ(イソ", "c1ass", "Q7", "険証", "変わらない"]
    rows = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "id string, text string")
    rows.crossJoin(given.drop("id", "text")).select(*given.columns).write.parquet(f"{folder}/questions.parquet")
    want = {}
    for k, t in enumerate(texts):
        after = t
        for pattern, repl in [("fede-\nration(?=の)", "federation"), ("detectiori", "detection"), ("iso1ation", "isolation"), (RULES[3][1], "ロ"), (RULES[5][1], "l"), (RULES[6][1], RULES[6][2]), ("険証", "検証")]:
            after = re.sub(pattern, repl, after)
        if after != t:
            want[f"t{k}"] = after
    assert len(want) == 6
    assert {r["id"]: r["after"] for r in q_corrected_texts(spark, folder).collect()} == want
