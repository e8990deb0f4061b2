"""Groups of matches against union-find: chains, hubs, repeats, nulls, empty tables."""

import random

import pytest

from quernstone.llm import groups
from quernstone.llm.groups import components

SCHEMA = "a string, b string"


def brute(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("shape", ["chain", "hub", "random"])
def test_against_union_find(spark, shape):
    rng = random.Random(5)
    ids = [f"q{i:04}" for i in range(300)]
    rng.shuffle(ids)
    pairs = {"chain": list(zip(ids, ids[1:])), "hub": [(ids[0], x) for x in ids[1:]] + [("m", "n")], "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(150)]}[shape]
    pairs += [(b, a) for a, b in pairs[:20]] + [(None, "x"), ("x", None), ("y", "y"), pairs[0]]
    got = {r["id"]: r["group_id"] for r in components(spark.createDataFrame(pairs, SCHEMA)).collect()}
    assert got == brute(pairs)


def test_nothing(spark):
    assert components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("x", "y")], SCHEMA).selectExpr("*", "1 AS v", "2 AS u", "3 AS id", "4 AS group_id", "5 AS low")
    assert {tuple(r) for r in components(df).collect()} == {("x", "x"), ("y", "x")}


def test_hot_vertices_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(groups, "HOT", 20)
    pairs = [("hub", f"q{i:03}") for i in range(200)] + [(f"q{i:03}", f"r{i:03}") for i in range(0, 200, 3)] + [("x", "y"), ("y", "z")]
    got = {r["id"]: r["group_id"] for r in components(spark.createDataFrame(pairs, SCHEMA)).collect()}
    assert got == brute(pairs)
