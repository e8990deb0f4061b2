"""Orphan references: nulls, blanks, ties of time, hot keys and empty tables against a plain check."""

import random

from quernstone.operators.references import orphans

REFS = "parent string, key string, tbl string, fld string, row_key string, at long"
PARENTS = "parent string, key string, added long, gone long"


def brute(refs, parents):
    held = {(p, k): (a, g) for p, k, a, g in parents}
    out = set()
    for p, k, t, f, r, at in refs:
        kind = None
        if (p, k) not in held:
            kind = "missing"
        elif at is not None:
            a, g = held[p, k]
            kind = "late" if a is not None and a > at else "deleted" if g is not None and g <= at else None
        if kind:
            out.add((t, f, r, kind))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    parents = [("a", f"k{i}" + "\x00" * (i % 3 == 0), rng.choice([None, rng.randrange(100)]), rng.choice([None, rng.randrange(100)])) for i in range(300)]
    keys = [p[1] for p in parents] + ["", "ghost", "é", "長い" * 500]
    refs = [("a", rng.choice([*keys, "k1"]), "t", "f", str(i), rng.choice([None, rng.randrange(100)])) for i in range(2000)]
    refs += [("a", "k1", "t", "f", f"hot{i}", i % 100) for i in range(1000)]
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), range_keys=40, group_rows=100)
    rows = {(r["tbl"], r["fld"], r["row_key"], r["kind"]) for r in got.collect()}
    assert rows == brute(refs, parents)


def test_empty_tables(spark):
    refs = spark.createDataFrame([("a", "x", "t", "f", "1", 0)], REFS)
    none = spark.createDataFrame([], PARENTS)
    assert [tuple(r) for r in orphans(refs, none).collect()] == [("t", "f", "1", "missing", "1970-01")]
    assert orphans(refs.limit(0), none).count() == 0
