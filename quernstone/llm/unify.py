"""One form for text that looks the same (problem 5), computed on arrays of code points.

A batch's Arrow text becomes one numpy array of code points. Lookup tables replace, expand or drop code points by gathers and
expansion offsets; combining marks are ordered and composed with their bases by sorted pair tables, without touching single rows.

What is evened out: full and half width, composition, ligatures and radicals, invisible characters, kinds of blank, and
look-alike letters, hyphens and dashes. What is kept: the number of visible blanks, tabs and line ends, other punctuation,
letter case, and circled, raised, lowered or squared characters.

Defined results: a null text has a null form and is not compared; a text of invisible characters has the empty form; the
form of a form is itself.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import materialize, table

# Letters that look like Latin ones, each followed by the Latin letter.
LOOKALIKE_LETTERS = (
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS ҮY аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo"
)
# Strokes that look like a hyphen, and like a long dash.
HYPHENS, DASHES = "‐‑‒–−﹣－⁃˗", "―─━"
# Characters that show nothing.
INVISIBLE = "​‌‍⁠﻿­᠎‎‏⁡⁢⁣⁤͏"
#: Decompositions that keep the look. Those tagged compat count for letters, numerals and radicals only.
_KEPT = {"", "<wide>", "<narrow>", "<noBreak>", "<font>"}


def _look(cp: int) -> str | None:
    """What stands for a code point, None for itself."""
    ch = chr(cp)
    if ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F:
        return ""
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return None if ch == " " else " "
    if ch in HYPHENS:
        return "-"
    if ch in DASHES:
        return "—"
    if 0xAC00 <= cp <= 0xD7A3:  # Hangul syllables stay composed
        return None
    parts = unicodedata.decomposition(ch).split()
    if parts:
        tag = parts.pop(0) if parts[0].startswith("<") else ""
        if tag in _KEPT or (tag == "<compat>" and (kind in ("Lu", "Ll", "Lt", "Lo", "Nl") or 0x2E80 <= cp <= 0x2FDF)):
            out = "".join(chr(int(p, 16)) for p in parts)
            return "".join(_fold().get(c, c) if (x := _look(ord(c))) is None else x for c in out)
    return _fold().get(ch)


@lru_cache(maxsize=1)
def _fold() -> dict[str, str]:
    return {p[0]: p[1] for p in LOOKALIKE_LETTERS.split()} | {"゛": "゙", "゜": "゚"}


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, made by rule."""
    size = sys.maxunicode + 1
    length, first, ccc = np.ones(size, dtype=np.int8), np.arange(size, dtype=np.uint32), np.zeros(size, dtype=np.uint8)
    where, extra = np.zeros(size, dtype=np.int32), []
    pairs = {}
    for cp in range(size):
        if 0xD800 <= cp <= 0xDFFF or 0x30000 <= cp:
            continue
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        out = _look(cp)
        if out is not None:
            length[cp] = len(out)
            if len(out) == 1:
                first[cp] = ord(out)
            elif len(out) > 1:
                where[cp] = len(extra)
                extra += [ord(c) for c in out]
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[(a << 21) | b] = cp
    keys = np.array(sorted(pairs), dtype=np.int64)
    return {"length": length, "first": first, "where": where, "extra": np.array(extra, dtype=np.uint32), "ccc": ccc, "pairs": keys, "made": np.array([pairs[k] for k in keys.tolist()], dtype=np.uint32)}


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row and the offsets of each text (nulls are empty)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pa.concat_arrays([texts])  # an own array without offset
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=len(texts) + 1)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, dtype=np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, starts[at - at[0]]


def _regroup(keep: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(keep)])[offsets]


def unify(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forms of texts given as code points and offsets."""
    t = tables()
    for _ in range(4):  # a replacement may bring further ones; forms are stable after at most three
        size = t["length"][points]
        many = size > 1
        if not ((size != 1).any() or (t["first"][points] != points).any()):
            break
        begin = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        out = np.empty(begin[-1], dtype=np.uint32)
        one = size == 1
        out[begin[:-1][one]] = t["first"][points[one]]
        if many.any():
            n = size[many].astype(np.int64)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(begin[:-1][many], n) + step] = t["extra"][np.repeat(t["where"][points[many]], n) + step]
        points, offsets = out, begin[offsets]
    marks = t["ccc"][points]
    if (marks > 0).any():
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        base = np.cumsum((marks == 0) | np.concatenate([[True], row[1:] != row[:-1]])) if len(points) else np.empty(0)
        order = np.lexsort((np.arange(len(points)), marks, base))
        points, marks = points[order], marks[order]
        points = points.copy()
        start = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))  # the base of each run of marks
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(points))))
        place = np.arange(len(points)) - start[run]
        keep, last = np.ones(len(points), dtype=bool), np.where(marks[start] == 0, 0, 255)
        by_place = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[by_place], np.arange(1, place.max() + 2))
        for k in range(len(edges) - 1):  # the first marks of all runs, then the second ones
            at = by_place[edges[k] : edges[k + 1]]
            r = run[at]
            key = (points[start[r]].astype(np.int64) << 21) | points[at]
            found = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
            hit = (t["pairs"][found] == key) & (last[r] < marks[at])
            points[start[r[hit]]] = t["made"][found[hit]]
            keep[at[hit]] = False
            last[r[~hit]] = marks[at[~hit]]
        offsets = _regroup(keep, offsets)
        points = points[keep]
    return points, offsets


def to_arrow(points: np.ndarray, offsets: np.ndarray, nulls: np.ndarray) -> pa.Array:
    """Code points and offsets as Arrow text."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
    at = np.concatenate([[0], np.cumsum(width)])[offsets].astype(np.int32)
    made = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data))
    return pc.if_else(pa.array(~nulls), made, pa.scalar(None, pa.string()))


def unified(texts: pa.Array) -> pa.Array:
    """The form of each text, null for null."""
    points, offsets = unify(*code_points(texts))
    return to_arrow(points, offsets, np.asarray(pc.is_null(texts)))


def _add_form(field: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4000):
                b = whole.slice(start, 4000)
                yield pa.RecordBatch.from_arrays([*b.columns, unified(b[field])], [*b.schema.names, "form"])

    return run


def with_form(df: DataFrame, field: str) -> DataFrame:
    """`df` with the form of the text column `field` in column form; a column of that name is replaced."""
    if "form" in df.columns and field != "form":
        df = df.drop("form")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", form string"
    return df.mapInArrow(_add_form(field), schema)


def _forms(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, scope, id, form, text) of the rows, form and text as digests, and the (src, scope, form) that different texts share."""
    formed = with_form(rows.select("src", "scope", "id", "text").filter("text is not null"), "text")
    slim = formed.select("src", "scope", "id", F.md5("form").alias("form"), F.md5("text").alias("text")).distinct()
    slim, _ = materialize(slim, "p5-forms")
    return slim, slim.groupBy("src", "scope", "form").agg(F.min("text").alias("t0"), F.max("text").alias("t1")).filter("t0 <> t1").select("src", "scope", "form")


def lookalike_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (src, id_a, id_b), id_a < id_b, of the rows (src, scope, id, text) of one src and scope whose texts differ but have one form.

    Texts travel as 128-bit digests; only forms that two different texts share are joined. Pairs grow with the square of a form's rows;
    `lookalike_classes` gives the same classes a row each.
    """
    slim, shared = _forms(rows)
    some = slim.join(shared, ["src", "scope", "form"], "left_semi")
    other = some.select("src", "scope", "form", F.col("id").alias("other"), F.col("text").alias("other_text"))
    met = some.join(other, ["src", "scope", "form"]).filter("text <> other_text and id < other")
    return met.select("src", F.col("id").alias("id_a"), F.col("other").alias("id_b")).distinct()


def lookalike_classes(rows: DataFrame) -> DataFrame:
    """(src, id, keep_id, texts, ids): each row whose form two different texts share, with the smallest id of its class and the class's texts and ids.

    A form of any share of the rows is aggregated in parts before the shuffle and never paired.
    """
    slim, _ = _forms(rows)
    per_text = slim.groupBy("src", "scope", "form", "text").agg(F.min("id").alias("low"), F.count("*").alias("ids"))
    classes = per_text.groupBy("src", "scope", "form").agg(F.min("low").alias("keep_id"), F.count("*").alias("texts"), F.sum("ids").alias("ids")).filter("texts > 1")
    return slim.join(classes, ["src", "scope", "form"]).select("src", "id", "keep_id", "texts", "ids")


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    """The rows (src, scope, id, text) that are compared."""
    questions = table(spark, folder, "questions").filter("id is not null").select(F.lit("questions").alias("src"), F.lit("").alias("scope"), "id", "text")
    entries = table(spark, folder, "am_fixes").filter("id is not null and fix_key is not null").select("id", "fix_key", F.explode(F.map_entries("choices")).alias("e"))
    keyed = with_form(entries.select("id", "fix_key", F.col("e.key").alias("key"), F.col("e.value").alias("text")), "key").filter(F.trim("form") == "ア")
    return questions.unionAll(keyed.select(F.lit("am_fixes").alias("src"), F.col("id").alias("scope"), F.col("fix_key").alias("id"), "text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Questions whose texts, and fixes of one question whose choices ア, differ but look the same."""
    return lookalike_pairs(_compared(spark, folder))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The same as classes: each such question or fix with its class's smallest key, texts and rows."""
    return lookalike_classes(_compared(spark, folder))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every question's text in the one form, rows that repeat an id once."""
    rows = table(spark, folder, "questions").filter("id is not null").groupBy("id").agg(F.min("text").alias("text"))
    return with_form(rows, "text").select("id", "form")


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes, "p5_forms": p5_forms}
ORACLE: dict[str, str] = {}
