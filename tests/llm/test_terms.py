"""Term counts against a plain count, with leaves so small that the hash is cut several times."""

import re
from collections import Counter

from quernstone.llm import terms as M


def brute(records):
    occ, rec = Counter(), Counter()
    for parts in records:
        found = [t.lower() for p in parts or [] if p for t in re.findall(M.TERM, p)]
        occ.update(found)
        rec.update(set(found))
    return {t: (occ[t], rec[t]) for t in occ}


def test_recursive_leaves(spark):
    records = [[f"word{i} w{i % 7} 認証{'検査' * (i % 3)} アクセス", None if i % 2 else f"Word{i}"] for i in range(600)] + [[], [None, ""], ["common " * 3000]]
    df = spark.createDataFrame([(r,) for r in records], "parts array<string>")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in M.frequencies(df, level_bits=2, leaf_rows=20).collect()}
    assert got == brute(records)


def test_nothing(spark):
    assert M.frequencies(spark.createDataFrame([], "parts array<string>")).count() == 0


def test_one_term_of_many_partial_counts(spark, monkeypatch):
    """A term that alone is more than a leaf may hold shrinks when its partition is split; only oversized partitions are split."""
    seen = []
    whole = M.spill

    def watched(partial, level_bits, leaf_rows, bits=0):
        seen.append(bits)
        return whole(partial, level_bits, leaf_rows, bits)

    monkeypatch.setattr(M, "spill", watched)
    df = spark.createDataFrame([(["hot hot"],)] * 64, "parts array<string>").repartition(16)
    assert [tuple(r) for r in M.frequencies(df, level_bits=2, leaf_rows=3).collect()] == [("hot", 128, 64)]
    assert seen == [0, 2]
