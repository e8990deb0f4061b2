"""Streams over a log of many files read in any order of time give what the whole log gives."""

import datetime
import random

import pytest

from quernstone.operators.study import DAY_MS
from quernstone.streaming import study as M

SCHEMA = "seq long, question_id string, answered_at long, result string, mode string, device string"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("log")
    (folder / "answer_log.parquet").mkdir()
    rng = random.Random(6)
    rows = [(s, f"q{rng.randrange(8)}", rng.randrange(0, 900 * DAY_MS), rng.choice(["true", "true", "partial", "false"]), rng.choice("ab"), f"d{rng.randrange(3)}") for s in range(280)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for f in range(140):
        part = rows[2 * f : 2 * f + 2] + rows[(2 * f + 8) % 280 : (2 * f + 8) % 280 + 1]  # with rows of other files
        pq.write_table(pa.table({n: pa.array([r[k] for r in part], pa.int64() if n in ("seq", "answered_at") else pa.string()) for k, n in enumerate(names)}), folder / "answer_log.parquet" / f"part-{f:03}.parquet")
    return str(folder), rows


def test_daily(spark, log):
    folder, rows = log
    want = {}
    for _, _, at, _, mode, _ in rows:
        want[at // DAY_MS * DAY_MS, mode] = want.get((at // DAY_MS * DAY_MS, mode), 0) + 1
    assert {(r["day_ms"], r["mode"]): r["n"] for r in M.daily_stream(spark, folder).collect()} == want


def test_sittings(spark, log):
    folder, rows = log
    want = []
    for device in {r[5] for r in rows}:
        last = None
        for at, result in sorted((r[2], r[3]) for r in rows if r[5] == device):
            if last is None or at - last >= 20 * 60_000:
                want.append([device, at, 0, 0])
            want[-1][2] += 1
            want[-1][3] += result == "true"
            last = at
    got = [(r["device"], int(r["opened"].replace(tzinfo=datetime.UTC).timestamp() * 1000 + 0.5), r["n"], r["correct"]) for r in M.sittings_stream(spark, folder).collect()]
    assert sorted(got) == sorted(map(tuple, want))


def test_leitner(spark, log):
    folder, rows = log
    want = {}
    for _, q, at, result, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[q] = M.advance(want.get(q), at, result)
    assert {r["question_id"]: tuple(r)[1:] for r in M.leitner_stream(spark, folder).collect()} == want
