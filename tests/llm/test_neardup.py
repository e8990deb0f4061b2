"""Near duplicates against all pairs on a small set, hot buckets, and the quality of the similarity estimate."""

import random

import numpy as np
import pytest

from quernstone.llm import neardup as M

SCHEMA = "section string, kind long, id string, raw string"


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    held = [(s, k, i, M.content(t), set(M.shingles(M.content(t)).tolist())) for s, k, i, t in rows]
    for n, (s, k, i, t, g) in enumerate(held):
        for s2, k2, j, t2, g2 in held[:n]:
            if s == s2 and k != k2 and t and t2 and (t == t2 or (g and g2 and len(g & g2) >= 0.6 * len(g | g2) - 1e-9)):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(len(t))
        t[at : at + 1] = rng.choice([[], [rng.choice("abcdef")], [t[at], "z"]])
    return "".join(t)


@pytest.mark.parametrize("hot", [False, True])
def test_against_all_pairs(spark, hot):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows, n = [], 0
    for f in range(25):
        base = " ".join(word() for _ in range(14))
        for v in range(rng.choice([1, 2, 4])):
            rows.append((rng.choice("ab") if v == 3 else "a", n, f"q{n:04}", edited(rng, base, v * 3)))
            n += 1
    if hot:
        base = " ".join(word() for _ in range(14))
        rows += [("a", 10_000 + i, f"z{i:04}", edited(rng, base, 2)) for i in range(150)]
    rows += [("a", 1, "copy", rows[1][3]), ("a", 900, "wide", rows[1][3].upper()), ("a", 901, "e1", ""), ("a", 902, "e2", "  "), ("a", 903, "s1", "ab"), ("a", 904, "s2", "A b")]
    got = {r["id"]: r["group_id"] for r in M.alike_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    # the copy shares its kind with q0001 and is alike to all that q0001 is alike to
    assert got == want


def test_nothing(spark):
    assert M.alike_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    a, b = np.arange(300), np.concatenate([np.arange(100, 300), np.arange(1000, 1100)])
    w = {int(x): float(rng.uniform(0.2, 4)) for x in np.union1d(a, b)}
    flat = np.concatenate([a, b]).astype(np.int64)
    owner = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    regs = M.prob_min_hash(flat, owner, np.array([w[int(x)] for x in flat]), 2, 4000)
    total = sum(w[int(x)] for x in a), sum(w[int(x)] for x in b)
    # probability Jaccard: 1 / sum over items of max ratios
    jp = sum(1 / sum(max(w.get(int(y), 0) * (y in sa) / w[int(x)], w.get(int(y), 0) * (y in sb) / w[int(x)]) for y in w) for sa, sb in [(set(a.tolist()), set(b.tolist()))] for x in sa & sb)
    assert abs((regs[0] == regs[1]).mean() - jp) < 0.03 and total[0] > 0


def test_extra_columns_with_clashing_names(spark):
    rows = [("a", 1, "x", "one two three four five six"), ("a", 2, "y", "one two three four five sex")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS grams", "3 AS key", "4 AS text")
    assert {tuple(r) for r in M.alike_groups(df).collect()} == {("x", "x"), ("y", "x")}


def letters(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))


def test_links_of_a_template_group(spark):
    # all rows hold one text of 102 letters; of each section's rows only two have little besides
    rng = random.Random(4)
    base, rows = letters(rng, 102), []
    for s in range(12):
        own = [28, 28, *[90 + k for k in range(8)]]
        rows += [(f"s{s}", len(rows) + k, f"q{s:02}-{k}", base + letters(rng, n)) for k, n in enumerate(own)]
    want = brute(rows)
    assert len(want) == 24
    assert {r["id"]: r["group_id"] for r in M.alike_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == want


@pytest.mark.parametrize("block", [20_000, 7])
def test_links_within_crowded_buckets(spark, monkeypatch, block):
    # one register: buckets of most rows, whose smallest row is alike to few of them
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "PART", 500)
    rng = random.Random(5)
    base, rows = letters(rng, 60), []
    for f in range(60):
        own = letters(rng, 60)
        rows += [("a", 2 * f + k, f"q{f:02}-{k}", base + edited(rng, own, 6)) for k in range(2)]
    rows.append(("a", 0, "copy", rows[1][3]))
    want = brute(rows)
    assert len(want) >= 60
    assert {r["id"]: r["group_id"] for r in M.alike_groups(spark.createDataFrame(rows, SCHEMA), bands=1, band_rows=1).collect()} == want


@pytest.mark.parametrize("share", [0.16, 0.19, 0.22])
def test_template_families(spark, share):
    """Records of one text, every word replaced with a probability: no link may be missing."""
    rng = random.Random(int(share * 100))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(40)]
    rows = [("a", n, f"q{n:04}", " ".join(word() if rng.random() < share else w for w in base)) for n in range(1200)]
    sets = [M.shingles(M.content(r[3])) for r in rows]
    vocabulary = np.unique(np.concatenate(sets))
    held = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, g in enumerate(sets):
        held[i, np.searchsorted(vocabulary, g)] = 1
    shared, size = held @ held.T, held.sum(1)
    alike = shared >= 0.6 * (size[:, None] + size[None, :] - shared) - 1e-6
    np.fill_diagonal(alike, False)
    group = np.arange(len(rows))
    for _ in range(len(rows)):
        following = np.minimum(group, np.where(alike, group[None, :], len(rows)).min(axis=1))
        if (following == group).all():
            break
        group = following
    want = {rows[i][2]: rows[group[i]][2] for i in np.flatnonzero(alike.any(axis=1))}
    assert len(want) > 100
    assert {r["id"]: r["group_id"] for r in M.alike_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_crowded_buckets_of_a_batch(spark):
    """A third of the rows in one bucket of every band: the smallest node of each batch stands for them."""
    rng = random.Random(9)
    base = letters(rng, 150)
    rows = [("a", n, f"q{n:04}", edited(rng, base, 2) if n % 3 == 0 else letters(rng, 60)) for n in range(360)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert len(want) == 120
    assert {r["id"]: r["group_id"] for r in M.alike_groups(df).collect()} == want
