"""Choice booklets: lines with boxes parsed into numbered questions with four options.

A booklet's lines are a bounded group (some twenty-five questions), parsed together because every step depends on the order before it.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from quernstone.operators.pages import expected_sequence
from quernstone.operators.study import questions
from quernstone.session import table

# Glyphs read for each option's marker.
MARKERS = {"ア": "アァ", "イ": "イィ", "ウ": "ウゥワヮ", "エ": "エェ工ヱ"}
# Fixed values, measured in shares of the page: width of a column of markers, height of a row, how much further right a text without its
# marker begins, and how far headings may stand from the leftmost one.
SPREAD, ROW, SHIFT, COLUMN, RIM = 0.013, 0.02, (0.028, 0.052), 0.06, 0.008
_HEAD = re.compile(r"^[問間]\s*(\d{1,3})")
_PAGE = re.compile(r"^[\s\-–—ー−=_]*\d{1,3}[\s\-–—ー−=_]*$")


@dataclass(frozen=True)
class Line:
    """A read line with its page and box."""

    page: int
    text: str
    x: float
    y: float
    w: float = 0.5
    h: float = 0.02


def opens(line: Line, key: str) -> bool:
    """Whether a line begins with an option's marker."""
    return bool(line.text.strip()) and line.text.strip()[0] in MARKERS[key]


def split_merged(lines: list[Line]) -> list[Line]:
    """Lines that hold two successive options cut in two; the second's edge follows from its place in the text."""
    out = []
    for line in lines:
        keys = list(MARKERS)
        for a, b in zip(keys, keys[1:]):
            if opens(line, a) and (m := re.search(rf"[\s　]+(?=[{MARKERS[b]}][\s　])", line.text[1:])):
                at = 1 + m.end()
                out.append(replace(line, text=line.text[: 1 + m.start()]))
                line = replace(line, text=line.text[at:], x=line.x + line.w * at / len(line.text))  # noqa: PLW2901
        out.append(line)
    return out


def in_column(block: list[Line], places: list[list[int]]) -> tuple[int, ...] | None:
    """The latest rising choice of one place from each list whose lines begin within one column.

    For every column that some line opens on the left, the last line of each list before the one chosen after it is best.
    """
    best = None
    for left in {block[i].x for some in places for i in some}:
        chosen, bound = [], len(block)
        for some in reversed(places):
            bound = max((i for i in some if i < bound and 0 <= block[i].x - left < SPREAD), default=-1)
            chosen.append(bound)
            if bound < 0:
                break
        else:
            best = max(best or chosen, chosen)
    return tuple(reversed(best)) if best else None


def in_rows(block: list[Line], places: list[list[int]]) -> tuple[int, ...] | None:
    """The latest rising choice of one place from each list in which some neighbours share a row, each right of the one before.

    chains: for a last place and whether a row is shared so far, the latest choice up to it, written from its end.
    """
    row = [(line.page, round(line.y / ROW)) for line in block]
    chains = {(i, False): (i,) for i in places[0]}
    for some in places[1:]:
        longer: dict[tuple[int, bool], tuple[int, ...]] = {}
        for (i, shared), chain in chains.items():
            for j in some:
                same = row[i] == row[j]
                if i < j and (not same or block[i].x < block[j].x):
                    key = (j, shared or same)
                    longer[key] = max(longer.get(key, ()), (j, *chain))
        chains = longer
    best = max((chain for (_, shared), chain in chains.items() if shared), default=None)
    return best[::-1] if best else None


def latest(block: list[Line], places: list[list[int]]) -> tuple[int, ...] | None:
    """The latest choice of either layout."""
    return max((c for c in (in_column(block, places), in_rows(block, places)) if c), key=lambda c: c[::-1], default=None)


def assign_markers(block: list[Line]) -> tuple[int, ...] | None:
    """Lines that open the four options: the latest that stand in line; None if no four do."""
    return latest(block, [[i for i, line in enumerate(block) if opens(line, k)] for k in MARKERS])


def recover_marker(block: list[Line]) -> tuple[tuple[int, ...], int] | None:
    """(lines that open the four options, which one of them shows no marker) where exactly one marker was not read.

    The line must stand between its neighbours: a text that begins a glyph further right goes first, then a line in the markers'
    column, then any that does not stand left of them.
    """
    places = [[i for i, line in enumerate(block) if opens(line, k)] for k in MARKERS]
    for n in range(len(places)):
        seen = latest(block, places[:n] + places[n + 1 :]) if all(places[:n] + places[n + 1 :]) else None
        if seen is None:
            continue
        columns = [block[i].x for i in seen]

        def rank(x: float, columns: list[float] = columns) -> int:
            return 0 if any(SHIFT[0] <= x - c <= SHIFT[1] for c in columns) else 1 if any(abs(x - c) <= SPREAD for c in columns) else 2 if x >= min(columns) - SPREAD else 3

        between = range(seen[n - 1] + 1 if n else 1, seen[n] if n < len(seen) else len(block))
        fit = min(((rank(block[i].x), i) for i in between), default=(3, 0))
        if fit[0] < 3:
            return (*seen[:n], fit[1], *seen[n:]), n
    return None


def run_on(parts: list[str]) -> str:
    """Lines in one, with a blank only between ASCII letters or digits."""
    out = ""
    for p in (p.strip() for p in parts):
        seam = out and p and out[-1].isascii() and out[-1].isalnum() and p[0].isascii() and p[0].isalnum()
        out += (" " if seam else "") + p
    return out


def parse_booklet(lines: list[Line], top: int) -> list[tuple[int, str, list[str]]]:
    """(number, text, options) of the questions 1..top; options are empty where markers could not be told."""
    rows = split_merged([line for line in lines if line.text.strip() and not (_PAGE.match(line.text) and line.y > 0.88)])
    heads = [(i, m[1]) for i, line in enumerate(rows) if (m := _HEAD.match(line.text.strip()))]
    if not heads:
        return []
    edge = min(rows[i].x for i, _ in heads)
    heads = [(i, d) for i, d in heads if rows[i].x <= edge + COLUMN]
    far = max(rows[i].x for i, _ in heads) + RIM
    found = expected_sequence(heads, top, [i for i, line in enumerate(rows) if line.x <= far])
    out = []
    starts = sorted((i, n) for n, i in found.items())
    for (i, n), (j, _) in zip(starts, [*starts[1:], (len(rows), 0)]):
        block = rows[i:j]
        block[0] = replace(block[0], text=re.sub(rf"^[問間]\s*{n}[\s　]*", "", block[0].text.strip()))
        picked, bare = assign_markers(block), -1
        if picked is None:
            recovered = recover_marker(block)
            if recovered is None:
                out.append((n, run_on([b.text for b in block]), []))
                continue
            picked, bare = recovered
        ends = [*picked[1:], len(block)]
        # a recovered line has lost its marker, or shows a misread one before a blank
        options = [run_on([re.sub(r"^.[\s　.．]+" if k == bare else r"^.[\s　.．]*", "", block[a].text.strip(), count=1), *(b.text for b in block[a + 1 : z])]) for k, (a, z) in enumerate(zip(picked, ends))]
        out.append((n, run_on([b.text for b in block[: picked[0]]]), options))
    return out


def format_items(lines: list[str]) -> list[str] | None:
    """Items of the last group of lines that run in order from its first marker, if there are three; a marker may be read as its look-alike."""
    series = ["①②③④⑤⑥⑦⑧", "アイウエオカキク", "abcdefgh"]
    text = "\n".join(lines)
    for order in series:
        at, places = 0, []
        for mark in order:
            hit = re.compile(rf"(?m)(?:^|\n|　)\s*[{MARKERS.get(mark, mark)}][\s　.．]").search(text, at)
            if hit is None:
                break
            places.append((hit.start(), hit.end()))
            at = hit.end()
        if len(places) >= 3:
            ends = [p[0] for p in places[1:]] + [len(text)]
            items = [run_on(text[b:e].split("\n")) for (_, b), e in zip(places, ends)]
            return items if all(len(i) >= 2 for i in items) else None
    return None


def marker_rows(points: list[tuple[float, float]], step: float = 0.012) -> list[list[float]] | None:
    """Points (x, y) in rows: a new row where y is more than `step` below the row's first; None if rows differ in number."""
    rows: list[list[tuple[float, float]]] = []
    for x, y in sorted(points, key=lambda p: (p[1], p[0])):
        if rows and y - rows[-1][0][1] <= step:
            rows[-1].append((x, y))
        else:
            rows.append([(x, y)])
    return [sorted(x for x, _ in r) for r in rows] if len({len(r) for r in rows}) == 1 else None


@F.pandas_udf(StringType())
def dropped_restored(text, reference):  # noqa: ANN001, ANN202
    """Texts with the one or two kanji in a row that only a second reading of at least 200 characters shows between the same neighbours."""

    def one(a: str | None, b: str | None) -> str | None:
        if not a or not b or len(b) < 200:
            return a
        out, at = [], 0
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            out.append(a[at:i2])
            at = i2
            if op == "insert" and re.fullmatch("[一-鿿]{1,2}", b[j1:j2]) and 0 < i1 < len(a):
                out.append(b[j1:j2])
        return "".join(out)

    return pd.Series([one(x, y) for x, y in zip(text, reference)])


def _set(spark: SparkSession, folder: str, size: int = 25) -> DataFrame:
    """Choice questions set as lines of booklets of `size`: (booklet, n, id, page, text, x, y)."""
    q = questions(spark, folder).filter("text <> '' and size(choices) = 4").withColumn("text", F.regexp_replace("text", r"(?U)\s+", "")).filter("text <> ''")
    options = F.transform("choices", lambda c: F.regexp_replace(F.coalesce(c["text"], F.lit("")), r"(?U)\s+", ""))
    # booklets by session and section; the place within is counted in slices, so that no session is ordered in one task
    sliced = q.select("id", "sessionId", "section", F.pmod(F.xxhash64("id"), F.lit(64)).alias("slice"), "text", options.alias("options"))
    place = F.row_number().over(Window.partitionBy("sessionId", "section", "slice").orderBy("id")) - 1
    numbered = sliced.withColumn("k", place).select("id", "text", "options", F.concat_ws("/", "sessionId", "section", F.col("slice").cast("string"), F.floor(F.col("k") / size).cast("string")).alias("booklet"), (F.col("k") % size + 1).alias("n"))
    wrapped = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 30).cast("int")), lambda i: F.struct(F.lit(0.10).alias("x"), F.concat(F.when(i == 0, F.concat(F.lit("問"), F.col("n").cast("string"), F.lit("　"))).otherwise(""), F.substring("text", i * 30 + 1, F.lit(30))).alias("text")))
    first = F.transform(wrapped, lambda s, i: F.struct(F.when(i == 0, 0.08).otherwise(s["x"]).alias("x"), s["text"].alias("text")))
    marked = F.transform("options", lambda o, i: F.struct(F.lit(0.14).alias("x"), F.concat(F.get(F.array(*map(F.lit, MARKERS)), i), F.lit("　"), o).alias("text")))
    every = numbered.select("*", F.posexplode(F.concat(first, marked)).alias("i", "line"))
    return every.select("booklet", "n", "id", "i", F.col("line.text").alias("text"), F.col("line.x").alias("x"))


def q_parsed_booklets(spark: SparkSession, folder: str) -> DataFrame:
    """Questions set as booklet lines and parsed again: text and options come out as they went in."""
    lines = _set(spark, folder)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "i"])
        rows = [Line(k // 40, t, x, (k % 40) / 50) for k, (t, x) in enumerate(zip(pdf["text"], pdf["x"]))]
        ids = dict(zip(pdf["n"], pdf["id"]))
        got = [(ids[n], re.sub(r"\s", "", text), "|".join(re.sub(r"\s", "", o) for o in options)) for n, text, options in parse_booklet(rows, max(ids)) if n in ids]
        return pd.DataFrame(got, columns=["id", "text", "options"])

    return lines.groupBy("booklet").applyInPandas(run, "id string, text string, options string")


def q_restored_kanji(spark: SparkSession, folder: str) -> DataFrame:
    """Pages to which the second reading adds kanji that the lines dropped."""
    p = table(spark, folder, "ocr_pages").filter("tesseract is not null").select("file", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("own"), "tesseract").distinct()
    return p.select("file", "own", dropped_restored("own", "tesseract").alias("text")).filter("own <> text").select("file", "text")


def q_blank_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The widest empty band between a page's lines: a sweep with the running end of all lines above."""
    p = table(spark, folder, "ocr_pages").filter("file is not null").groupBy("file").agg(F.min("lines").alias("lines")).select("file", F.explode("lines").alias("l")).select("file", "l.y", "l.h")
    w = Window.partitionBy("file").orderBy("y", "h")
    upto = F.max(F.col("y") + F.col("h")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bands = p.withColumn("gap", F.round(F.col("y") - upto, 6)).filter("gap > 0")
    return bands.groupBy("file").agg(F.max("gap").alias("gap"))


_Q = "q AS (SELECT id, any_value(text) AS text, any_value(choices) AS choices FROM questions WHERE id IS NOT NULL GROUP BY id)"
_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "parsed_booklets": f"WITH {_Q} SELECT id, regexp_replace(text, '{_WS}', '', 'g') AS text, array_to_string(list_transform(choices, lambda c: regexp_replace(coalesce(c.text, ''), '{_WS}', '', 'g')), '|') AS options FROM q WHERE text <> '' AND len(choices) = 4 AND regexp_replace(text, '{_WS}', '', 'g') <> ''",
    "blank_bands": "WITH p AS (SELECT file, min(lines) AS lines FROM ocr_pages WHERE file IS NOT NULL GROUP BY file), l AS (SELECT file, unnest(lines) AS l FROM p), b AS (SELECT file, round(l.y - max(l.y + l.h) OVER (PARTITION BY file ORDER BY l.y, l.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS gap FROM l) SELECT file, max(gap) AS gap FROM b WHERE gap > 0 GROUP BY file",
}
