"""The transducer is minimal and exact, and encoding equals both public libraries."""

import random

import pytest
from tokenizers import Tokenizer

from quernstone.llm import lexicon as M

TEXTS = ["", None, " ", "hello  world\n\n  it's 12345!", "情報保全技術者試験　午前Ⅱ，第6期", "<|endoftext|> a", "a\x1cb \x1f c\x85d", "é́ ﾊﾞ", "x" * 5000, "🙂👍🏽 \t\r\n", "'s't're 'LL"]


def test_lookup_and_minimality():
    rng = random.Random(0)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))).encode() for _ in range(200)} | {"試験".encode(), b"x" * 32}
    t = M.Transducer.build({w: [i, i + 1][: i % 3] for i, w in enumerate(sorted(words))})
    asked = sorted(words) + [b"", b"zzz", b"abababababab", "試".encode(), b"x" * 31]
    got = t.lookup(asked).tolist()
    assert got[: len(words)] == list(range(len(words))) and set(got[len(words) :]) <= {-1} | set(range(len(words)))
    assert t.lookup([b"", b"zzz"]).tolist() == [-1, -1]
    # equal suffixes share states: fewer arcs than a trie has
    assert len(t.arcs) < len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert M.Transducer.build({}).lookup([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_encoder_equals_library(name):
    ranks = M.encoding(name)
    lexicon = M.Transducer.build({w.encode(): ranks.encode_ordinary(w) for w in (" world", "hello", "試験", " it", "'s")})
    offsets, ids = M.Encoder(name, M.TOKENIZERS, lexicon, remember=3).encode(TEXTS)
    for i, t in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == (ranks.encode_ordinary(t) if t else [])


def test_corpus(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS ids")
    tok = Tokenizer.from_file(f"{M.TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    got = {r["doc_id"]: r["ids"] for r in M.encoded(df, frequent=1).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS * 3)}
    assert M.encoded(df.limit(0)).count() == 0
