"""Running sums over groups: hot groups, ties, nulls and empty tables."""

import random

from quernstone.plans.ordered import place, prefix_sum


def test_prefix_sum(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), rng.randrange(50), i, rng.choice([None, rng.randrange(9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, i int, v int")
    got = {r["i"]: (r["before"],) for r in prefix_sum(df, ["g"], ["k", "i"], "v", "before").collect()}
    want, sums = {}, {}
    for g, k, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = (sums.get(g, 0),)
        sums[g] = sums.get(g, 0) + (v or 0)
    assert got == want
    assert prefix_sum(df.limit(0), ["g"], ["k"], "v", "before").count() == 0


def test_place(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 7)], "g string, k int")
    assert {(r["g"], r["k"], r["place"]) for r in place(df, ["g"], ["k"]).collect()} == {("a", 1, 1), ("a", 3, 2), ("b", 7, 1)}


def test_release(spark):
    from quernstone import session

    session.release(spark)
    df, path = session.materialize(spark.range(5), "release")
    assert df.count() == 5 and session.release(spark) == 1
    assert session.plain_path(path) and not __import__("os").path.exists(session.plain_path(path))
    assert session.release(spark) == 0
