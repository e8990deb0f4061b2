"""The exact search for alike pairs: none missing at any size, few met that are unlike, postings with and without files."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from quernstone.plans import alike as M
from quernstone.session import plain_path, release, shared_dir


def family(rng, count):
    """Sets of all sizes about the bound of paired keys, in families whose similarities are around the threshold."""
    letters = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4E00 + 3000)) for _ in range(n))
    out = []
    while len(out) < count:
        base = letters(rng.choice([5, 20, 40, 47, 60, 75, 90, 150, 400]))
        for _ in range(5):
            t = list(base)
            for _ in range(rng.randrange(max(2, len(base) // 8))):
                t[rng.randrange(len(t))] = letters(1)
            out.append("".join(t[: rng.randrange(len(t) * 6 // 10, len(t) + 1)]))
    return out


@pytest.mark.parametrize(("threshold", "files", "block"), [(0.6, True, 20_000), (0.6, False, 20_000), (0.85, True, 20_000), (0.6, True, 3), (0.6, False, 3)])
def test_no_alike_pair_is_missed(spark, monkeypatch, threshold, files, block):
    if not files:
        monkeypatch.setattr(M, "shared_file", lambda *_, **__: None)
    texts = family(random.Random(3), 500)
    sets = [set(M.shingles(t).tolist()) for t in texts]
    want = {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if x and y and len(x & y) >= threshold * len(x | y) - 1e-9}
    assert len(want) > 30
    nodes = spark.createDataFrame([(i, 7, i, None, t) for i, t in enumerate(texts)], "node long, sec long, comp long, kind long, text string").repartition(3)
    got = {(r["a"], r["b"]) for r in M.missed_pairs(nodes, threshold=threshold, block=block, part=5000).collect()}
    assert want <= got
    assert len(got) < 3 * len(want) + 100


def test_rows_of_few_words_seldom_meet():
    """Rows of one small vocabulary share many single sequences but few keys, and their postings don't hold bitmaps."""
    rng = random.Random(8)
    words = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(8)) for _ in range(400)]
    texts = ["".join(rng.choice(words) for _ in range(25)) for _ in range(2000)]
    batch = pa.record_batch({"sec": np.zeros(len(texts), dtype=np.int64), "text": texts})
    owner, token = M.tokens(texts)
    counts = np.bincount(M._cell(token), minlength=1 << M.DF_BITS)
    row, place, key, *_ = M._prefixes(M._Order(counts), batch, 0.6)
    pairs = lambda k: int((n := np.unique(k, return_counts=True)[1]) @ (n - 1))
    # single sequences: the rarest four tenths of each row
    single = np.lexsort((token, counts[M._cell(token)], owner))
    sizes = np.bincount(owner)
    at = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    single = token[single][at <= 0.4 * sizes[owner]]
    assert pairs(key) < pairs(single) / 3


def test_products_of_bitmaps_find_all_pairs():
    """Rows of a full key are compared by products of matrices: the pairs that sizes and unlike bits allow for, no others."""
    rng = np.random.default_rng(6)
    n, tile = 300, 64
    p = M._Part.__new__(M._Part)
    p.threshold, p.found = 0.6, []
    base = rng.integers(0, 2**63, (30, M.BITS // 64)).astype(np.uint64)
    p.bits = base[np.arange(n) % 30].copy()
    for _ in range(60):
        at = rng.random(n) < 0.7
        p.bits[at, rng.integers(0, M.BITS // 64, at.sum())] ^= np.uint64(1) << rng.integers(0, 63, at.sum()).astype(np.uint64)
    p.size = rng.integers(60, 240, n)
    p.node, p.comp, p.kind, p.single = np.arange(n), np.arange(n) // 2, np.arange(n), np.ones(n, dtype=bool)
    old, M.TILE = M.TILE, tile
    try:
        p.block(np.argsort(p.size, kind="stable"))
    finally:
        M.TILE = old
    got = {tuple(x) for x in np.concatenate(p.found).tolist()}
    unlike = np.bitwise_count(p.bits[:, None] ^ p.bits[None]).sum(axis=2, dtype=np.int64)
    both = p.size[:, None] + p.size[None]
    least = np.ceil(0.375 * both - 1e-9)
    ok = (unlike <= both - 2 * least) & (np.minimum(p.size[:, None], p.size[None]) >= least) & (p.comp[:, None] != p.comp[None])
    want = {(a, b) for a, b in np.argwhere(ok).tolist() if a < b}
    assert len(want) > 50
    assert got == want


def test_groups_without_a_file_system(spark, monkeypatch):
    """Where the shared folder can't be mapped, bitmaps travel with the keys; the groups are the same."""
    from quernstone.llm import neardup

    rng = random.Random(12)
    base = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(120))
    texts = [base[:k] + base[k + 3 :] for k in range(0, 100, 2)] + family(rng, 60)
    rows = spark.createDataFrame([("a", n, f"q{n:04}", t) for n, t in enumerate(texts)], "section string, kind long, id string, raw string").repartition(2)
    want = {tuple(r) for r in neardup.alike_groups(rows).collect()}
    monkeypatch.setattr(neardup, "shared_file", lambda *_, **__: None)
    monkeypatch.setattr(M, "shared_file", lambda *_, **__: None)
    assert len(want) >= 50
    assert {tuple(r) for r in neardup.alike_groups(rows).collect()} == want


def test_files_go_with_the_tables(spark):
    nodes = spark.createDataFrame([(i, 7, i, None, f"abcdefgh{i}") for i in range(4)], "node long, sec long, comp long, kind long, text string")
    held = lambda: {x for x in os.listdir(plain_path(shared_dir(spark))) if x.startswith("alike-rows-")}
    before = held()
    M.missed_pairs(nodes, threshold=0.6).collect()
    made = held() - before
    assert made
    release(spark)
    assert not made & held()
