"""Copies by multiset hashing: order, repeats, hot groups and colliding fingerprints."""

from pyspark.sql import functions as F

from quernstone.llm import copies as M

SCHEMA = "id string, section string, text string, options array<string>"
ROWS = [
    ("1", "a", "x", ["p", "q", "r", "s"]), ("2", "a", "x", ["s", "r", "q", "p"]), ("3", "a", "x", ["p", "p", "q", "r"]), ("4", "a", "x", ["p", "q", "q", "r"]),
    ("5", "b", "x", ["p", "q", "r", "s"]), ("6", "a", "y", ["p", "q", "r", "s"]), ("7", "a", "", ["", "", "", ""]), ("8", "a", "", ["", "", "", ""]), ("9", "a", "x", ["r", "p", "q", "p"]),
]
WANT = {("1", "1"), ("1", "2"), ("3", "3"), ("3", "9"), ("7", "7"), ("7", "8")}


def found(df):
    return {tuple(r) for r in M.copies(df, "id", ["section", "text"], "options").collect()}


def test_copies(spark):
    assert found(spark.createDataFrame(ROWS, SCHEMA)) == WANT
    hot = [(f"h{i:04}", "a", "h", ["p", "q", "r", "s"]) for i in range(400)]
    assert found(spark.createDataFrame(ROWS + hot, SCHEMA)) == WANT | {("h0000", h[0]) for h in hot}
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(M, "fingerprint", lambda pairs, lane: F.lit(7).cast("long"))
    assert {p for p in found(spark.createDataFrame(ROWS, SCHEMA)) if p[0] != p[1]} == {p for p in WANT if p[0] != p[1]}


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS f1", "2 AS head", "3 AS pairs", "4 AS keep_id", "5 AS copies")
    assert found(df) == WANT


def test_bare(spark):
    assert spark.createDataFrame([(" A-b。ガ①\n2",)], "s string").select(M.bare(F.col("s")).alias("x")).first()["x"] == "abガ①2"
