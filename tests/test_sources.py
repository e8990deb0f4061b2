"""The container format, packs and progress files."""

import json

import pytest

from quernstone.sources.container import MAGIC, ContainerSource, read_header, write_container
from quernstone.sources.packs import PROGRESS, offsets, read_pack, read_progress, replace_by_section, retire, write_sessions


def test_container_round_trip(spark, tmp_path):
    entries = [(f"figures/{i:03}.png", "image/png" if i % 2 else "", bytes([i]) * i) for i in range(1, 90)]
    write_container(str(tmp_path / "a.bin"), "am2", entries)
    spark.dataSource.register(ContainerSource)
    df = spark.read.format("container").option("path", str(tmp_path / "*.bin")).option("entriesPerPartition", "20").load()
    assert {(r["path"], r["type"], bytes(r["content"])) for r in df.collect()} == {(p, t or "image/jpeg", c) for p, t, c in entries}
    assert df.rdd.getNumPartitions() == 5


@pytest.mark.parametrize("raw", [b"no", MAGIC + b"\x01", MAGIC + b"\x02\x00\x00\x00{]", MAGIC + b"\x0e\x00\x00\x00" + b'{"entries":[]}'])
def test_bad_containers(tmp_path, raw):
    (tmp_path / "b.bin").write_bytes(raw)
    with pytest.raises(ValueError, match="b.bin"):
        read_header(str(tmp_path / "b.bin"))


def test_offsets(spark):
    rows = spark.createDataFrame([("g", "a", 3), ("g", "b", 5), ("g", "c", 2)], "g string, p string, n int")
    assert [r["offset"] for r in offsets(rows, "g", "p", "n").orderBy("p").collect()] == [0, 3, 8]


def test_pack_and_progress(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"meta": {}, "sessions": [{"id": "s"}], "questions": [{"id": "q1", "sessionId": "s", "no": 1}]}))
    q, s = read_pack(spark, str(tmp_path / "p.json"))
    assert [r["section"] for r in q.collect()] == ["am2"] and s.count() == 1
    (tmp_path / "e.json").write_text(json.dumps({"sessions": [{"id": "s"}], "questions": []}))
    with pytest.raises(Exception, match="no questions"):
        read_pack(spark, str(tmp_path / "e.json"))[0].collect()
    (tmp_path / "g.json").write_text(json.dumps({"kind": PROGRESS, "answers": [{"questionId": "q1", "answeredAt": 5}], "states": []}))
    assert read_progress(spark, str(tmp_path / "g.json"))[0].count() == 1
    (tmp_path / "h.json").write_text(json.dumps({"kind": "other", "answers": [{"questionId": "q1"}]}))
    with pytest.raises(Exception, match="no progress file"):
        read_progress(spark, str(tmp_path / "h.json"))[0].collect()


def test_replacement_and_registry(spark, tmp_path):
    held = spark.createDataFrame([("1", "am1"), ("2", None), ("3", "pm")], "id string, section string")
    new = spark.createDataFrame([("9", "am2")], "id string, section string")
    assert {r["id"] for r in replace_by_section(held, new).collect()} == {"1", "3", "9"}
    registry = spark.createDataFrame([("old", ["am1", "am2"]), ("pm", ["pm"])], "pack_id string, sections array<string>")
    assert {r["pack_id"] for r in retire(registry, "new", ["am2"]).collect()} == {"pm", "new"}


def test_write_replaces_only_its_sessions(spark, tmp_path):
    schema = "id string, section string, sessionId string"
    path = str(tmp_path / "t")
    write_sessions(spark.createDataFrame([("1", "am1", "a"), ("2", "am1", "b")], schema), path)
    write_sessions(spark.createDataFrame([("3", "am1", "b")], schema), path)
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {"1", "3"}


def test_replacement_of_many_sections(spark):
    held = spark.range(1500).selectExpr("concat('s', id) AS section", "id", "'old' AS v")
    got = replace_by_section(held, held.filter("id < 1400").selectExpr("section", "id", "'new' AS v"))
    assert {r["v"]: r["count"] for r in got.groupBy("v").count().collect()} == {"old": 100, "new": 1400}
