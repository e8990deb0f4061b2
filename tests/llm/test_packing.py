"""Packing: nothing lost, no container over its capacity, places in a row, near the lower bound."""

import random
from collections import Counter, defaultdict

import pytest

from quernstone.llm import packing as M


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_item_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([64, 500, 2048])
    hist = Counter(min(cap, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(3000))
    if seed == 3:
        hist = Counter({cap // 2 + 1: 1000, cap // 3: 2000, 1: 50})
    p = M.plan(dict(hist), cap)
    held, load, places = Counter(), Counter(), defaultdict(list)
    ranks = defaultdict(list)
    for size, rank, count, first, place in p.runs:
        held[size] += count
        ranks[size].append((rank, count))
        for c in range(first, first + count):
            load[c] += size
            places[c].append(place)
    assert held == hist and max(load.values()) <= cap and set(load) == set(range(p.used))
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    for runs in ranks.values():
        at = 0
        for rank, count in sorted(runs):
            assert rank == at
            at += count
    if seed < 3:
        assert p.used <= 1.03 * sum(s * n for s, n in hist.items()) / cap + 2


def test_nothing_to_pack():
    assert M.plan({}, 100).used == 0


def test_documents(spark):
    rows = [(1, "word " * 50), (2, None), (3, ""), (4, "a"), (5, "tok " * 7), (6, "tok " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS container")
    got = M.packed(df, [(1, "byte_bpe_50k", 16), (2, "byte_bpe_multi_50k", 1000)]).collect()
    one = [r for r in got if r["pack_id"] == 1]
    load = Counter()
    for r in one:
        load[r["container"]] += r["n_tokens"]
    assert max(load.values()) <= 16 and len({(r["container"], r["place"]) for r in one}) == len(one)
    big = [r for r in one if r["doc_id"] == 1]
    assert [r["n_tokens"] for r in sorted(big, key=lambda r: r["chunk"])][:-1] == [16] * (len(big) - 1)
    assert {r["doc_id"] for r in one if r["n_tokens"] == 0} == {2, 3}
    assert len({r["container"] for r in got if r["pack_id"] == 2}) == 1
    assert M.packed(df.limit(0), [(1, "byte_bpe_50k", 16)]).count() == 0
    assert M.packed(df, []).count() == 0


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("times", [1, 100, 10_000])
def test_program_against_best_fit_and_its_bound(seed, times):
    rng = random.Random(seed)
    cap = (2048, 4096, 500)[seed]
    hist = {s: n * times for s, n in Counter(min(cap, max(1, int(rng.lognormvariate(6, 0.9)))) for _ in range(6000)).items()}
    alone = M.Plan(cap)
    alone.decreasing(list(hist.items()))
    got, made = M.plan(hist, cap), M.configured(hist, cap)
    assert sum(s * n for s, n in hist.items()) / cap - 1e-6 <= got.bound <= got.used + 1e-6
    assert got.used <= alone.used
    assert made.left <= 0.1 and made.used <= 1.03 * alone.used + 1


def test_bound_sees_what_sums_do_not():
    # no two of these fit together, so that half of every container stays empty
    assert M.plan({51: 1000}, 100).bound > 990
    assert M.plan({51: 1000}, 100).used == 1000


def test_counts_of_ids():
    from quernstone.llm.lexicon import TOKENIZERS, Counts, encoding, pieces

    texts = ["鍵の管理 and keys", "", None, "a\x1cb  c", "長い" * 300]
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        want = [len(encoding(name).encode_ordinary(t)) if t else 0 for t in texts]
        assert Counts(name, TOKENIZERS).counts(texts, [pieces(t) if t else [] for t in texts]).tolist() == want
