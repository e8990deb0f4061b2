"""Rules for blank labels on hand-written cases, and cuts of pages against brute force."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import wording as W


def apply(spark, rule, text, labels):
    df = spark.createDataFrame([(text, labels)], "t string, l array<string>")
    return df.select(rule(F.col("t"), F.col("l")).alias("x")).first()["x"]


CASES = [
    (W.completed_ends, "［a］に入れる字句", ["a", "b"], "［a］［b］に入れる字句"),
    (W.completed_ends, "［　Ｆ　］に入れる", ["c", "d", "f"], "［c］～［f］に入れる"),
    (W.completed_ends, "［b］に入れる", ["a", "b", "c"], "［b］に入れる"),
    (W.completed_ends, "［a］と［b］", ["a", "b"], "［a］と［b］"),
    (W.completed_ends, "argv［1］", [], "argv［1］"),
    (W.quoted_labels, "本文中のf」に入れる\nア 甲」", ["f"], "本文中の［f］に入れる\nア 甲」"),
    (W.quoted_labels, "“pdf」という", ["f"], "“pdf」という"),
    (W.put_back_blank, "本文中の に入れる適切な字句\n甲 乙", ["f"], "本文中の［f］に入れる適切な字句\n甲 乙"),
    (W.put_back_blank, "本文 中の に入れる", ["f"], "本文 中の に入れる"),
    (W.put_back_blank, "the key に入れる", ["f"], "the key に入れる"),
    (W.put_back_blank, "本文中の に入れる", ["f", "g"], "本文中の に入れる"),
    (W.pulled_in_labels, "d［ ］の対策と［　Ｃ　］", ["c", "d"], "［d］の対策と［c］"),
    (W.pulled_in_labels, "SaaS-a［ ］とサイトa［　］", ["a"], "SaaS-a［ ］とサイトa［　］"),
    (W.loose_labels, "値は aを満たす。", ["a"], "値は ［a］を満たす。"),
    (W.loose_labels, "aを満たし，aと比べる。", ["a"], "aを満たし，aと比べる。"),
    (W.loose_labels, "［a］とaを比べる。", ["a"], "［a］とaを比べる。"),
    (W.loose_labels, "MAC 00:11", ["a"], "MAC 00:11"),
]


@pytest.mark.parametrize(("rule", "text", "labels", "want"), CASES)
def test_rules(spark, rule, text, labels, want):
    assert apply(spark, rule, text, labels) == want


@pytest.mark.parametrize("rule", [W.completed_ends, W.quoted_labels, W.put_back_blank, W.pulled_in_labels, W.loose_labels])
def test_nothing_to_go_by(spark, rule):
    assert apply(spark, rule, None, ["a"]) is None
    assert apply(spark, rule, "［x］を 選ぶ", None) == "［x］を 選ぶ"
    assert apply(spark, rule, "", []) == ""


@pytest.mark.parametrize(("readings", "labels", "elsewhere", "want"), [(["Ｃ", "e"], ["c", "d"], [], "c"), (["c", "d"], ["c", "d"], [], None), (["1"], ["l", "m"], [], "l"), (["1"], ["l", "m"], ["L"], None), ([], ["a"], [], None)])
def test_resolved_reading(spark, readings, labels, elsewhere, want):
    df = spark.createDataFrame([(readings, labels, elsewhere)], "r array<string>, l array<string>, e array<string>")
    assert df.select(W.resolved_reading(F.col("r"), F.col("l"), F.col("e")).alias("x")).first()["x"] == want


def test_shared_options(spark):
    df = spark.createDataFrame([("g", 1, []), ("g", 2, None), ("g", 3, ["p", "q"]), ("g", 4, []), ("h", 1, ["z"])], "g string, n int, o array<string>")
    got = {(r["g"], r["n"]): r["o"] for r in W.shared_options(df, "g", "n", "o").collect()}
    assert got == {("g", 1): ["p", "q"], ("g", 2): ["p", "q"], ("g", 3): ["p", "q"], ("g", 4): [], ("h", 1): ["z"]}


def test_pooled_runs(spark):
    one = spark.createDataFrame([("f", 0.1, 0.2, "甲"), ("g", 0.5, 0.1, "乙")], "file string, x double, w double, text string")
    two = spark.createDataFrame([("f", 0.15, 0.1, "甲'"), ("f", 0.4, 0.1, "丙"), ("g", 0.1, 0.1, "丁")], "file string, x double, w double, text string")
    assert {r["text"] for r in W.pooled_runs(one, two, ["file"]).collect()} == {"甲", "乙", "丙", "丁"}


def test_approximate_counts(spark, tmp_path):
    rows = [("exam", f"q{n % 700}", n) for n in range(5000)]
    spark.createDataFrame(rows, "mode string, question_id string, elapsed_ms long").write.parquet(f"{tmp_path}/answer_log.parquet")
    got = W.q_approximate_counts(spark, str(tmp_path)).first()
    assert abs(got["questions"] - 700) <= 21 and abs(got["median_ms"] - 2500) <= 50


def test_recovered_marker_and_many_candidates():
    from quernstone.operators.booklet import Line, assign_markers, recover_marker

    lost = [Line(0, "どれか。", 0.08, 0.1), Line(0, "ア 甲", 0.14, 0.2), Line(0, "乙の文", 0.175, 0.25), Line(0, "ウ 丙", 0.14, 0.3), Line(0, "エ 丁", 0.14, 0.35)]
    assert assign_markers(lost) is None
    assert recover_marker(lost) == ((1, 2, 3, 4), 1)
    assert recover_marker(lost[:2]) is None
    # hundreds of look-alike lines that stand elsewhere do not hide the column
    noise = [Line(0, f"{k}の行", 0.3 + 0.02 * (n % 13), 0.4 + n / 1000) for n in range(150) for k in "アイウエ"]
    block = [lost[0], *[Line(0, f"{k} x", 0.14, 0.2 + n / 50) for n, k in enumerate("アイウエ")], *noise]
    picked = assign_markers(block)
    assert picked is not None and len({round(block[i].x, 3) for i in picked}) == 1
    rows = [Line(0, "問", 0.1, 0.1), Line(0, "ア 1", 0.14, 0.2), Line(0, "イ 2", 0.5, 0.2), Line(0, "ウ 3", 0.14, 0.25), Line(0, "エ 4", 0.5, 0.25)]
    assert assign_markers(rows) == (1, 2, 3, 4)


def test_sequences_of_any_length():
    from quernstone.operators.pages import expected_sequence

    found = [(3 * n, str(n)) for n in range(1, 400) if n % 7] + [(3 * n + 1, str(n % 50 + 200)) for n in range(0, 120, 5)]
    got = expected_sequence(sorted(found), 399, list(range(0, 1300)))
    assert [got[n] for n in sorted(got)] == sorted(got.values()) and len(got) == 399
    assert all(got[n] == 3 * n for n in range(150, 400) if n % 7)
