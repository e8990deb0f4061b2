"""Text functions and rule-based repairs on hand-written cases."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import corpus, grading, pages, repair, segments
from quernstone.operators.pool import fnv1a, lcg_shuffle


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("a　 b \n c\x0c\x07", "a b\nc"), ("ガ ", "ガ"), ("", "")])
def test_clean(spark, raw, want):
    assert one(spark, T.clean(F.col("s")), s=raw) == want


def test_canonical(spark):
    assert one(spark, T.canonical(F.col("s")), s="Ａｂ，「ァー」 x．") == "ab，アx。"


def test_normalised_answer_and_marks(spark):
    assert one(spark, grading.folded(F.col("s")), s=" ＳＱＬ　インジェクション。") == "sqlインジェクション"
    assert one(spark, grading.folded(F.col("s")), s=None) == ""
    df = spark.createDataFrame([([True, True],), ([True, False],), ([False],), ([True, None],), ([],)], "m array<boolean>")
    assert [r["x"] for r in df.select(grading.auto_result(F.col("m")).alias("x")).collect()] == ["true", "partial", "false", None, None]


@pytest.mark.parametrize(("answer", "kind"), [("ア，イ", "choice"), ("暗号化", "term"), ("鍵を配る。", "essay"), ("あ" * 21, "essay")])
def test_kind(spark, answer, kind):
    assert one(spark, grading.kind_of(F.col("s")), s=answer) == kind


def test_rates_qualified_first(spark):
    assert one(spark, T.rate_of(F.col("s")), s="正答率がやや低かった。") == "やや低"
    assert one(spark, T.rate_of(F.col("s")), s="正答率は高くなかった。") == "低"


def test_tags_stand_alone(spark):
    assert one(spark, corpus.tags_for(F.col("s")), s="XDNSYとMFA") == ["認証"]
    assert one(spark, corpus.tags_for(F.col("s")), s="何もない") == ["その他"]


def test_sequence_scan():
    assert pages.expected_sequence([(0, "1"), (3, "2"), (5, "93"), (7, "4")], 4, [4, 5]) == {1: 0, 2: 3, 4: 7, 3: 4}
    assert pages.expected_sequence([(0, "1"), (1, "1"), (2, "2"), (3, "3")], 3) == {1: 0, 2: 2, 3: 3}
    assert pages.expected_sequence([], 3) == {}


def test_frames():
    assert repair.repair_frames("［ a ］と［Ｂ］", ["a", "b"]) == "［　a　］と［　b　］"
    assert repair.repair_frames("［　］と［a］", ["a", "b"]) == "［　b　］と［　a　］"
    assert repair.repair_frames("argv［12345］と［　］［　］", ["a", "b"]) == "argv［12345］と［　］［　］"


def test_brackets(spark):
    df = spark.createDataFrame([("値）を比べ（次）", "（値）を比べ（次）"), (None, "x"), ("あ", None)], "a string, b string")
    assert [r["x"] for r in df.select(repair.restore_openers("a", "b").alias("x")).collect()] == ["（値）を比べ（次）", None, "あ"]


def test_votes(spark):
    tokens = spark.createDataFrame([("パスワード", 100), ("バスワード", 2), ("サーバー", 100), ("サーハー", 2), ("サーパー", 30), ("ネットワーク", 9), ("ネットワータ", 1)], "token string, n long")
    lexicon = spark.createDataFrame([("サーハー",)], "token string")
    assert [tuple(r) for r in repair.vote_terms(tokens, lexicon).collect()] == [("バスワード", "パスワード")]


def test_answer_tables():
    got = segments.parse_answers("設問１\n(1) a 暗号化\nb 鍵\n順不同\n(2) 通信を止める\nため。\n(9) は続き")
    assert got == [(1, 1, "", "a 暗号化", ""), (1, 1, "b", "鍵", "順不同"), (1, 2, "", "通信を止めるため。", ""), (1, 2, "", "(9) は続き", "")]


def test_marker_order():
    assert segments.mend_sequence([1, 2, 9, 4]) == [1, 2, 3, 4]
    assert segments.mend_sequence([1, 3, 2]) == [1, 3, 2]


def test_unwrap(spark):
    text = "これは右端まで続く長い行であり\n次の行へ続く。\n・箇条書き\nend of\nline"
    df = spark.createDataFrame([("d", i, line) for i, line in enumerate(text.split("\n"))], "id string, pos int, line string")
    got = [r["text"] for r in segments.unwrapped(df, "id").orderBy("par").collect()]
    assert got[0] == "これは右端まで続く長い行であり次の行へ続く。" and got[1] == "・箇条書き"


def test_shuffle_is_a_permutation(spark):
    df = spark.createDataFrame([(n, s) for n in (0, 1, 2, 9) for s in (0, 1, 77)], "n int, s long")
    for r in df.select("n", "s", lcg_shuffle("n", "s").alias("o")).collect():
        assert sorted(r["o"]) == list(range(r["n"]))
    zero, first = (r["o"] for r in spark.createDataFrame([(9, 0), (9, 1)], "n int, s long").select(lcg_shuffle("n", "s").alias("o")).collect())
    assert zero == first


def test_fnv(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "s string")
    rows = [r["h"] for r in df.select(fnv1a("s").alias("h")).collect()]
    assert rows[0] == 2166136261 and rows[2] is None
    assert rows[1] == ((((2166136261 ^ 97) * 16777619) % 2**32))


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=40))
def test_nfkc_matches_python(spark, s):
    s = s.replace("\x00", "").encode("utf-8", "ignore").decode()
    assert one(spark, T.nfkc(F.col("s")), s=s) == unicodedata.normalize("NFKC", s)


def test_wording():
    labels = ["a", "b", "c"]
    assert repair.repair_wording("値］は［　］b［　］である", labels) == "値は［　b　］である"
    assert repair.repair_wording("［ a ］〜［ x ］に入れる", labels) == "［　a　］～［　c　］に入れる"
    assert repair.repair_wording("MAC ［00］:［11］", labels) == "MAC ［00］:［11］"


def test_booklet_with_damage():
    from quernstone.operators.booklet import Line, format_items, marker_rows, parse_booklet, split_merged

    rows = [
        Line(0, "問1　次の図で", 0.08, 0.1), Line(0, "アクセスするもの", 0.10, 0.13), Line(0, "ア　甲　イ　乙", 0.14, 0.16), Line(0, "ウ　丙", 0.14, 0.19), Line(0, "続き", 0.17, 0.22), Line(0, "工　丁", 0.14, 0.25),
        Line(0, "- 3 -", 0.48, 0.95), Line(1, "どれか。", 0.08, 0.1), Line(1, "ア　A1", 0.14, 0.16), Line(1, "イ　B", 0.14, 0.19), Line(1, "ウ　C", 0.14, 0.22), Line(1, "エ　D", 0.14, 0.25), Line(1, "間33台を調べた。", 0.08, 0.4), Line(1, "ア　x", 0.14, 0.5),
    ]
    assert [s.text for s in split_merged(rows[2:3])] == ["ア　甲", "イ　乙"]
    got = parse_booklet([*rows[:2], Line(0, "ア　甲", 0.14, 0.16), Line(0, "イ　乙", 0.14, 0.17), *rows[3:]], 3)
    assert got == [(1, "次の図でアクセスするもの", ["甲", "乙", "丙続き", "丁"]), (2, "どれか。", ["A1", "B", "C", "D"]), (3, "3台を調べた。ア　x", [])]
    assert parse_booklet([], 3) == []
    assert format_items(["解答群", "ア 暗号", "イ 認証", "ウ 監査と", "記録"]) == ["暗号", "認証", "監査と記録"]
    assert format_items(["ア 一つ", "イ 二つ"]) is None
    assert marker_rows([(0.1, 0.1), (0.3, 0.101), (0.1, 0.2), (0.3, 0.205)]) == [[0.1, 0.3], [0.1, 0.3]]
    assert marker_rows([(0.1, 0.1), (0.3, 0.101), (0.1, 0.2)]) is None
