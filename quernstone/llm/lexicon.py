"""Encoding of texts with a public tokenizer (problem 8) by a minimal acyclic transducer lexicon.

Frequent pieces (the pre-tokenizer's cuts) are compiled, with their ids as output, into a minimal acyclic automaton:
equal suffixes share states, and numbers on the arcs add up to the index of a piece, under which its ids are stored. The arrays are written to
the shared folder and mapped into memory by the executors. A batch's distinct pieces are looked up together,
byte by byte in numpy; pieces the lexicon lacks are merged exactly by their ranks. Whether a piece is in the lexicon
never changes its ids, so the lexicon's bound (`max_words`, `max_bytes`) is a setting of speed only; the counts behind it cover
all texts.

Defined results: null and empty texts give an empty list; every document has a row; special tokens' strings are ordinary
text. Texts with characters on whose class libraries differ (U+001C to U+001F) are cut by the tokenizer's own library.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import shared_file, table

#: Folder of the public vocabularies; queries read it from the session's setting of the same meaning, else from here.
TOKENIZERS, SETTING = "/opt/tokenizers", "spark.quernstone.tokenizers"
#: The pre-tokenizer of the byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces in the lexicon at most, bytes of a piece, and occurrences that make a piece frequent.
MAX_WORDS, MAX_BYTES, FREQUENT = 16_384, 32, 8
_CUT = regex.compile(PATTERN)
_ODD = regex.compile("[\x1c-\x1f]")


@lru_cache(maxsize=4)
def encoding(name: str, folder: str = TOKENIZERS) -> tiktoken.Encoding:
    """A byte-level vocabulary as ranks."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Transducer:
    """A minimal acyclic automaton over bytes with id outputs, as flat arrays."""

    NAMES = ("arcs", "targets", "adds", "final", "starts", "ids")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        """Compile sorted words, freezing finished suffixes into a register so that equal ones share states."""
        register: dict[tuple, int] = {}
        finals: list[bool] = []
        counts: list[int] = []
        arcs: list[tuple] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            state = register.get(key)
            if state is None:
                state = register[key] = len(finals)
                finals.append(node[0])
                arcs.append(key[1])
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return state

        ordered = sorted(words)
        path: list[list] = [[False, []]]  # open nodes: final, frozen arcs
        last = b""
        for word in ordered:
            common = len(os.path.commonprefix([last, word]))
            for depth in range(len(last), common, -1):
                node = path.pop()
                path[-1][1].append((last[depth - 1], freeze(node)))
            path += [[False, []] for _ in range(len(word) - common)]
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            node = path.pop()
            path[-1][1].append((last[depth - 1], freeze(node)))
        root = freeze(path[0])
        keys, targets, adds = [], [], []
        for state, out in enumerate(arcs):
            before = int(finals[state])
            for byte, target in out:
                keys.append((state << 8) | byte)
                targets.append(target)
                adds.append(before)
                before += counts[target]
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        ids = [words[w] for w in ordered]
        return cls(
            arcs=np.array(keys, dtype=np.int64)[order], targets=np.array(targets, dtype=np.int32)[order], adds=np.array(adds, dtype=np.int32)[order], final=np.array([*finals, root], dtype=np.int32),
            starts=np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), ids=np.array([i for x in ids for i in x], dtype=np.int32),
        )

    def save(self, folder: str) -> None:
        for n in self.NAMES:
            np.save(f"{folder}/{n}.npy", self.__dict__[n])

    @classmethod
    def load(cls, folder: str) -> Transducer:
        """The arrays of a folder, mapped into memory."""
        return cls(**{n: np.load(f"{folder}/{n}.npy", mmap_mode="r") for n in cls.NAMES})

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 for words that are not in the lexicon."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.arcs):
            return out
        length = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        at, state, number = np.arange(n), np.full(n, self.final[-1], dtype=np.int64), np.zeros(n, dtype=np.int64)
        step = 0
        while len(at):
            ended = length[at] == step
            done = ended & (self.final[state] > 0)
            out[at[done]] = number[done]
            at, state, number = at[~ended], state[~ended], number[~ended]
            if not len(at):
                break
            key = (state << 8) | data[start[at] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[arc] == key
            at, arc, number = at[hit], arc[hit], number[hit]
            state, number = self.targets[arc].astype(np.int64), number + self.adds[arc]
            step += 1
        return out


class Encoder:
    """Ids of texts by lexicon and exact merging, with a bounded memory of pieces."""

    def __init__(self, name: str, folder: str, lexicon: Transducer | None, remember: int = 300_000) -> None:
        self.ranks, self.lexicon, self.known, self.remember = encoding(name, folder), lexicon, {}, remember

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > self.remember:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        raw = [p.encode() for p in new]
        merge = self.ranks._core_bpe.encode_single_piece
        found = self.lexicon.lookup(raw) if self.lexicon else np.full(len(raw), -1)
        for p, r, k in zip(new, raw, found.tolist()):
            self.known[p] = array("i", self.lexicon.ids[self.lexicon.starts[k] : self.lexicon.starts[k + 1]].tobytes()) if k >= 0 else array("i", merge(r))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        flat, offsets = array("i"), [0]
        for begin in range(0, len(texts), 500):
            some = texts[begin : begin + 500]
            cuts = [_CUT.findall(t) if t and not _ODD.search(t) else None for t in some]
            wanted: set[str] = set()
            for c in cuts:
                if c:
                    wanted.update(c)
            if len(self.known) > self.remember or not wanted <= self.known.keys():
                self._learn(wanted)
            known = self.known
            for t, c in zip(some, cuts):
                if c:
                    for p in c:
                        flat.extend(known[p])
                elif t:
                    flat.extend(array("i", self.ranks.encode_ordinary(t)))
                offsets.append(len(flat))
        return np.array(offsets, dtype=np.int64), np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, dtype=np.int32)


def pieces(text: str) -> list[str] | None:
    """The pre-tokenizer's cuts, None where libraries differ on them. All byte-level vocabularies here share one pre-tokenizer."""
    return None if _ODD.search(text) else _CUT.findall(text)


class Counts:
    """Numbers of ids of texts, from those of their pieces, with a bounded memory of pieces."""

    def __init__(self, name: str, folder: str, remember: int = 500_000) -> None:
        self.ranks, self.known, self.remember = encoding(name, folder), {}, remember

    def counts(self, texts: list[str | None], cuts: list[list[str] | None]) -> np.ndarray:
        """The number of ids of each text, given its pieces (None: cut by the tokenizer's own library)."""
        if len(self.known) > self.remember:
            self.known.clear()
        merge, known = self.ranks._core_bpe.encode_single_piece, self.known
        for c in cuts:
            for p in c or ():
                if p not in known:
                    known[p] = len(merge(p.encode()))
        get = known.__getitem__
        return np.array([sum(map(get, c)) if c is not None else len(self.ranks.encode_ordinary(t)) for t, c in zip(texts, cuts)], dtype=np.int64)


def tokenizer_folder(spark: SparkSession) -> str:
    """Where the vocabularies are."""
    return spark.conf.get(SETTING, TOKENIZERS)


def _count_pieces(max_bytes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

        counts: Counter = Counter()
        longest = max_bytes  # no fewer bytes than characters
        for b in batches:
            for t in b["text"].to_pylist():
                if t:
                    counts.update(p for p in _CUT.findall(t) if len(p) <= longest)
            if len(counts) > 200_000:
                yield rows(counts)
                counts = Counter()
        if counts:
            yield rows(counts)

    return run


def frequent_pieces(documents: DataFrame, text: str = "text", *, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES, frequent: int = FREQUENT) -> list[str]:
    """The most frequent short pieces over all documents, at most `max_words`."""
    counted = documents.filter(F.length(text) > 0).select(F.col(text).alias("text")).mapInArrow(_count_pieces(max_bytes), "piece string, n long")
    total = counted.filter(F.octet_length("piece") <= max_bytes).groupBy("piece").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent)
    return [r["piece"] for r in total.orderBy(F.desc("n"), "piece").limit(max_words).collect()]


def compile_lexicon(spark: SparkSession, pieces: list[str], name: str) -> object:
    """The pieces' transducer: a folder that executors map, or a broadcast of its (bounded) arrays where the shared folder has no path."""
    ranks = encoding(name, tokenizer_folder(spark))
    made = Transducer.build({p.encode(): ranks._core_bpe.encode_single_piece(p.encode()) for p in pieces})
    where = shared_file(spark, "lexicon")
    if where is None:
        return spark.sparkContext.broadcast({n: made.__dict__[n] for n in Transducer.NAMES})
    made.save(where)
    return where


def _encode(lexicon: object, name: str, folder: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Transducer.load(lexicon) if isinstance(lexicon, str) else Transducer(**lexicon.value)
        encoder = Encoder(name, folder, held)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                offsets, ids = encoder.encode(b["text"].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b["doc_id"], lists], ["doc_id", "ids"])

    return run


def encoded(documents: DataFrame, name: str = "byte_bpe_50k", **how) -> DataFrame:  # noqa: ANN003
    """(doc_id, ids) of (doc_id, text)."""
    spark = documents.sparkSession
    lexicon = compile_lexicon(spark, frequent_pieces(documents, **how), name)
    return documents.select("doc_id", "text").mapInArrow(_encode(lexicon, name, tokenizer_folder(spark)), "doc_id long, ids array<int>")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encoded(table(spark, folder, "documents"))


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
