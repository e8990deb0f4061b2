"""Pairs of alike texts against all pairs."""

import random

from quernstone.operators import records as M
from quernstone.plans import alike


def sets(text):
    return {text[i : i + 3] for i in range(len(text) - 2)}


def family(rng, size, words, kept):
    """Texts that share a template, whose sequences are all hot."""
    base = ["".join(rng.choice("検査監認証復旧遮断隔離鍵管理") for _ in range(5)) for _ in range(words)]
    return ["".join(w if rng.random() < kept else "".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(5)) for w in base) for _ in range(size)]


def test_gate_against_all_pairs(spark):
    rng = random.Random(5)
    texts = [*family(rng, 60, 12, 0.85), *family(rng, 60, 12, 0.5)]
    rows = [(f"i{k:03}", "am1" if k % 3 else "am2", t) for k, t in enumerate(texts)]
    rows += [(f"c{k}", "am1", texts[1]) for k in range(4)] + [("d", "pm", texts[1]), ("e", "am1", "甲乙"), ("f", "am1", "甲乙"), ("g", "am1", "")]
    got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in M.near_gate(spark.createDataFrame(rows, "id string, section string, body string"))[0].collect()}
    want = {}
    for a, s, x in rows:
        for b, t, y in rows:
            if a < b and s == t and len(x) > 2 and len(y) > 2 and (j := len(sets(x) & sets(y)) / len(sets(x) | sets(y))) >= M.NEAR_GATE:
                want[a, b] = j
    assert got == want and len(want) > 100


def test_hot_sequences_bring_few_candidates(spark):
    """Texts of one template that are not alike share many sequences; their pairs must not be written out."""
    rng = random.Random(6)
    nodes = spark.createDataFrame([(k, 1, k, None, t) for k, t in enumerate(family(rng, 300, 12, 0.4))], "node long, sec long, comp long, kind long, text string")
    assert alike.missed_pairs(nodes, threshold=0.55).count() < 300 * 299 / 2 / 20


def test_report_compares_texts_once(spark, tmp_path):
    """Copies are one text, and alike without a comparison."""
    choices = [("ア", "甲")]
    rows = [("a", "検査の記録を監査係が保管する手順", choices), ("b", "検査の記録を監査係が保管する手順。", choices), ("c", "検査の記録を監査係が保管する手順", choices), ("d", "まったく別の文を読む", choices)]
    spark.createDataFrame([(i, None, t, c) for i, t, c in rows], "id string, section string, text string, choices array<struct<key:string,text:string>>").write.parquet(f"{tmp_path}/questions.parquet")
    assert {(r["id_a"], r["id_b"]) for r in M.q_near_report(spark, str(tmp_path)).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    _, texts = M.near_gate(spark.createDataFrame([(i, "x", t) for i, t, _ in rows], "id string, section string, body string"))
    assert texts.count() == 3
