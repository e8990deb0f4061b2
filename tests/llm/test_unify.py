"""One text form: agreement with the standard compositions, stability, and what must stay apart."""

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm.unify import lookalike_classes, lookalike_pairs, unified


def form(*texts):
    return unified(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(("a", "b"), [("ﾊﾞｯｸ", "バック"), ("Ａ−１", "A-1"), ("カ゛", "ガ"), ("a​b﻿", "ab"), ("x y", "x y"), ("ЅQL", "SQL"), ("⼿順", "手順"), ("ﬁle", "file"), ("é", "é")])
def test_same(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("a b", "ab"), ("a  b", "a b"), ("A", "a"), ("、", "，"), ("①", "1"), ("x²", "x2"), ("ロ", "口"), ("α版", "a版"), ("…", "...")])
def test_apart(a, b):
    assert form(a) != form(b)


def test_nulls_and_slices():
    assert form(None, "", "​", "あ" * 5000) == [None, "", "", "あ" * 5000]
    assert unified(pa.array(["x", "ｙ", None, "ｚ"]).slice(1)).to_pylist() == ["y", None, "z"]
    assert unified(pa.array([], pa.string())).to_pylist() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=20), max_size=5))
def test_stable(texts):
    once = form(*texts)
    assert form(*once) == once


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="かきはばハヒガ゚àéñgA ́̀̈", max_size=12))
def test_composes_like_the_standard(text):
    assert form(text) == [unicodedata.normalize("NFC", text)]


def test_pairs(spark):
    rows = [("q", "s", "1", "ＡＢ"), ("q", "s", "2", "AB"), ("q", "s", "3", "AB"), ("q", "t", "4", "ＡＢ"), ("q", "s", "5", None), ("q", "s", "6", "ab"), ("q", "s", "2", "AB")]
    got = {tuple(r) for r in lookalike_pairs(spark.createDataFrame(rows, "src string, scope string, id string, text string")).collect()}
    assert got == {("q", "1", "2"), ("q", "1", "3")}
    assert lookalike_pairs(spark.createDataFrame([], "src string, scope string, id string, text string")).count() == 0


def test_extra_columns_with_clashing_names(spark):
    from quernstone.llm.unify import with_form

    df = spark.createDataFrame([("q", "s", "1", "Ａ"), ("q", "s", "2", "A")], "src string, scope string, id string, text string").selectExpr("*", "1 AS form", "2 AS id_a", "3 AS other")
    assert {tuple(r) for r in lookalike_pairs(df).collect()} == {("q", "1", "2")}
    assert [r["form"] for r in with_form(df, "text").collect()] == ["A", "A"]


def test_classes_agree_with_pairs(spark):
    rows = [("s", "", f"q{k:02}", "ab" if k % 2 else "ａb") for k in range(30)] + [("s", "", "z1", "same"), ("s", "", "z2", "same"), ("s", "", "z3", None), ("s", "", "e1", ""), ("s", "", "e2", "\u200b"), ("t", "", "q00", "ab")]
    df = spark.createDataFrame(rows, "src string, scope string, id string, text string")
    classes = {r["id"]: (r["keep_id"], r["texts"], r["ids"]) for r in lookalike_classes(df).collect()}
    assert classes == {**{f"q{k:02}": ("q00", 2, 30) for k in range(30)}, "e1": ("e1", 2, 2), "e2": ("e1", 2, 2)}
    assert {i for r in lookalike_pairs(df).collect() for i in (r["id_a"], r["id_b"])} == set(classes)
