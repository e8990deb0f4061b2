"""The learning state: every box and result, out-of-order answers, and the batch and stream forms against a plain fold."""

import random

import pytest

from quernstone.operators.study import DAY_MS, leitner_state, sittings
from quernstone.streaming.study import advance

SCHEMA = "question_id string, at long, seq long, result string"


def fold(events):
    out = {}
    for q, at, _, result in sorted(events, key=lambda e: (e[1], e[2])):
        out[q] = advance(out.get(q), at, result)
    return out


def test_state_equals_fold(spark):
    rng = random.Random(3)
    results = ["true", "true", "true", "partial", "false"]
    events = [(f"q{rng.randrange(40)}", rng.randrange(0, 60 * DAY_MS), s, rng.choice(results)) for s in range(1500)]
    events += [("hot", rng.randrange(0, 60 * DAY_MS), 5000 + s, rng.choice(results)) for s in range(800)]
    got = {r["question_id"]: tuple(r)[1:] for r in leitner_state(spark.createDataFrame(events, SCHEMA)).collect()}
    assert got == fold(events)


@pytest.mark.parametrize(("box", "result", "after", "days"), [(b, r, 1 if r == "false" else b if r == "partial" else min(5, b + 1), {"false": 0, "partial": {1: 0, 2: 1, 3: 3, 4: 7, 5: 16}[b], "true": {1: 1, 2: 3, 3: 7, 4: 16, 5: 35}[b]}[r]) for b in range(1, 6) for r in ("true", "partial", "false")])
def test_every_box_and_result(box, result, after, days):
    at = 5 * DAY_MS + 1234
    s = advance((1, 0, 0, None, box, 0, 0), at, result)
    assert s[4] == after
    assert s[5] == (at if days == 0 else (5 + days) * DAY_MS)


def test_state_of_nothing(spark):
    assert leitner_state(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sittings_gap_edges(spark):
    gap = 20 * 60_000
    times = [0, gap, 2 * gap + 1, 3_599_999, 3_600_000, 10_000_000]
    rows = [("s", t, i, "true" if i % 2 else "partial") for i, t in enumerate(times)]
    got = sorted((r["sitting"], r["n"], r["correct"], r["first_at"], r["last_at"]) for r in sittings(spark.createDataFrame(rows, "section string, at long, seq long, result string"), ["section"]).collect())
    assert got == [(1, 2, 1, 0, gap), (2, 3, 1, 2 * gap + 1, 3_600_000), (3, 1, 1, 10_000_000, 10_000_000)]


def test_stream_equals_batch(spark, tmp_path):
    from quernstone.operators.study import q_leitner_state
    from quernstone.streaming.study import leitner_stream

    folder = "/root/testdata/sf0.001"
    a = {tuple(r) for r in q_leitner_state(spark, folder).collect()}
    b = {tuple(r[c] for c in ("question_id", "attempts", "corrects", "partials", "last_result", "leitner_box", "due_at", "last_answered_at")) for r in leitner_stream(spark, folder).collect()}
    assert a == b
