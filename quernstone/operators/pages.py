"""Pages of read lines: reading order, rows, columns, pitch, gaps, boxes and spatial joins.

All work is within a page (a bounded group). A page read twice counts once, by its first reading in the order of its text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import table

#: Lines nearer than this share of the larger height are one row; columns, bins and gaps in shares of the page.
ROW, TOLERANCE, BIN, GAP = 0.6, 0.015, 0.005, 0.05
#: Margins, and the kinds of line dropped from running text.
TOP, BOTTOM = 0.08, 0.88
NOTICE = "設問はありません|余白|下書き用紙|検印欄|持出禁止|複写|続き"
PAGE_NUMBER = r"^[\s\-–—−－=~〜\[（(]*[0-9０-９]{1,3}[\s\-–—−－=~〜\]）)]*$|^p\.\s*[0-9]{1,3}$|^[0-9]{1,3} ページ$|^[0-9]{1,3}/[0-9]{1,3}$"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, one reading of each file."""
    p = table(spark, folder, "ocr_pages").filter("file is not null and lines is not null")
    return p.groupBy("file").agg(F.min(F.struct("lines", "tesseract")).alias("p")).select("file", "p.lines", "p.tesseract")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines (file, line_no, text, conf, x, y, w, h), with the booklet and page of the file's path."""
    part = F.split("file", "/")
    flat = pages(spark, folder).select("file", F.posexplode("lines").alias("line_no", "l")).select("file", "line_no", "l.*")
    return flat.withColumn("booklet", F.concat_ws("/", F.get(part, F.lit(1)), F.get(part, F.lit(2)))).withColumn("page", F.regexp_extract("file", r"p(\d+)\.json$", 1).cast("int"))


def q_line_table(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select("file", "line_no", "text", F.col("conf").cast("double").alias("conf"), "booklet", "page")


def q_reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each line from top to bottom, then left to right."""
    w = Window.partitionBy("file").orderBy("y", "x", "line_no")
    return lines(spark, folder).select("file", "line_no", F.row_number().over(w).cast("long").alias("place"))


def q_body_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without margins' page numbers, headers and notices."""
    body = lines(spark, folder).filter(~((F.col("y") > BOTTOM) & F.col("text").rlike(PAGE_NUMBER)) & (F.col("y") >= TOP) & ~F.col("text").rlike(NOTICE))
    return body.select("file", "line_no", "text")


def q_notice_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a notice and what remains on them."""
    return lines(spark, folder).groupBy("file").agg(F.count_if(F.col("text").rlike(NOTICE)).alias("notices"), F.count("*").alias("n")).filter("notices > 0")


def q_row_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """Lines joined to rows where they stand at one height: (file, row, parts, text)."""
    w = Window.partitionBy("file").orderBy("y", "x", "line_no")
    opens = F.coalesce(F.abs(F.col("y") - F.lag("y").over(w)) > ROW * F.greatest("h", F.lag("h").over(w)), F.lit(True)).cast("int")
    rows = lines(spark, folder).withColumn("opens", opens).withColumn("row", F.sum("opens").over(w))
    parts = F.array_sort(F.collect_list(F.struct("x", "line_no", "text")))  # a row's lines
    return rows.groupBy("file", "row").agg(F.count("*").alias("parts"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def q_modal_indent(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent left edge of each page, the leftmost of equals."""
    bins = lines(spark, folder).select("file", F.round("x", 2).alias("edge")).groupBy("file", "edge").agg(F.count("*").alias("n"))
    return bins.groupBy("file").agg(F.min_by("edge", F.struct(-F.col("n"), "edge")).alias("edge"))


def q_column_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Left edges that three lines and more share, runs of nearly equal edges taken together: mean and number."""
    w = Window.partitionBy("file").orderBy("x", "line_no")
    runs = lines(spark, folder).withColumn("opens", F.coalesce(F.col("x") - F.lag("x").over(w) > TOLERANCE, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(w))
    return runs.groupBy("file", "run").agg(F.round(F.avg("x"), 4).alias("edge"), F.count("*").alias("n")).filter("n >= 3")


def q_line_pitch(spark: SparkSession, folder: str) -> DataFrame:
    """Median distance of successive lines of each page."""
    w = Window.partitionBy("file").orderBy("y", "x", "line_no")
    step = lines(spark, folder).select("file", (F.lead("y").over(w) - F.col("y")).alias("dy")).filter("dy is not null")
    return step.groupBy("file").agg(F.round(F.median("dy"), 6).alias("pitch"))


def q_widest_gap(spark: SparkSession, folder: str) -> DataFrame:
    """The largest empty band of each page of those higher than a twentieth of it."""
    w = Window.partitionBy("file").orderBy("y", "x", "line_no")
    step = lines(spark, folder).select("file", "line_no", F.round(F.lead("y").over(w) - F.col("y") - F.col("h"), 6).alias("gap")).filter(F.col("gap") > GAP)
    return step.groupBy("file").agg(F.max_by(F.struct("line_no", "gap"), F.struct("gap", -F.col("line_no"))).alias("g")).select("file", "g.line_no", "g.gap")


def q_bounding_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The box of each page's body lines, with a rim, within the page."""
    body = lines(spark, folder).filter((F.col("y") >= TOP) & (F.col("y") <= BOTTOM))
    lo, hi = (lambda c: F.round(F.greatest(F.lit(0.0), F.min(c) - 0.01), 6)), (lambda a, b: F.round(F.least(F.lit(1.0), F.max(F.col(a) + F.col(b)) + 0.01), 6))
    return body.groupBy("file").agg(lo("x").alias("x0"), lo("y").alias("y0"), hi("x", "w").alias("x1"), hi("y", "h").alias("y1"))


def q_right_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """For each header or footer line, the nearest line to its right at about its height."""
    pts = lines(spark, folder).select("file", "line_no", "x", "y", "h")
    other = pts.select("file", F.col("line_no").alias("right_no"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = pts.join(other, "file").filter((F.abs(F.col("y2") - F.col("y")) < 0.05) & (F.col("x2") > F.col("x") + 0.05))
    return met.groupBy("file", "line_no").agg(F.min_by("right_no", F.struct("x2", "right_no")).alias("right_no"))


def q_lines_in_rect(spark: SparkSession, folder: str) -> DataFrame:
    """Lines within regions: each page's upper and lower half, the first region that holds a line."""
    regions = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.5), (2, 0.0, 0.4, 1.0, 1.0)], "region int, rx double, ry double, rx1 double, ry1 double")
    pad = 0.004
    held = lines(spark, folder).join(F.broadcast(regions), (F.col("x") >= F.col("rx") - pad) & (F.col("y") >= F.col("ry") - pad) & (F.col("x") + F.col("w") <= F.col("rx1") + pad) & (F.col("y") + F.col("h") <= F.col("ry1") + pad))
    return held.groupBy("file", "line_no").agg(F.min("region").alias("region")).groupBy("file", "region").agg(F.count("*").alias("n"))


def q_page_reading(spark: SparkSession, folder: str) -> DataFrame:
    """Text of each page: the second reading where it is long enough, else the lines, with where it comes from."""
    own = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    good = F.length(F.coalesce("tesseract", F.lit(""))) > 200
    return pages(spark, folder).select("file", F.when(good, F.col("tesseract")).otherwise(own).alias("text"), F.when(good, "second").otherwise("first").alias("origin"))


def q_booklet_text(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, lines and characters of each booklet."""
    return lines(spark, folder).groupBy("booklet").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars"))


def q_dropped_by_one(spark: SparkSession, folder: str) -> DataFrame:
    """Kanji of each page that only the second reading has."""
    kanji = F.lit("[一-鿿]")
    p = pages(spark, folder).filter("tesseract is not null")
    own = F.array_distinct(F.regexp_extract_all(F.array_join(F.transform("lines", lambda x: x["text"]), ""), kanji, F.lit(0)))
    second = F.array_distinct(F.regexp_extract_all("tesseract", kanji, F.lit(0)))
    return p.select("file", F.array_join(F.array_sort(F.array_except(second, own)), "").alias("only_second")).filter("only_second <> ''")


def _readings(shown: str, top: int) -> dict[int, int]:
    """Numbers up to `top` that a run of digits may stand for, with their worth: 2 as it is, 1 with other digits stuck to its end."""
    return {n: 2 if k == len(shown) else 1 for k in range(1, len(shown) + 1) if 1 <= (n := int(shown[:k])) <= top}


def expected_sequence(found: list[tuple[int, str]], top: int, free: list[int] = ()) -> dict[int, int]:
    """Numbers 1..top to places, from candidates (place, digits) in order.

    The numbers must rise with the places, so the heaviest rising chain is taken: by dynamic programming, with the best chain below each
    number held in a tree of prefix maxima; of equal chains the one that stands earlier. Numbers that no candidate shows take the free places between
    their neighbours, in order.
    """
    # prefix maxima over numbers: (worth, link), a link is (number, place, link before)
    tree: list[tuple[int, tuple | None]] = [(0, None)] * (top + 1)
    for place, shown in found:
        grown = []
        for n, worth in _readings(shown, top).items():
            best, k = (0, None), n - 1
            while k > 0:
                best, k = max(best, tree[k], key=lambda x: x[0]), k & (k - 1)
            grown.append((n, (best[0] + worth, (n, place, best[1]))))
        for n, chain in grown:
            while n <= top:
                if chain[0] > tree[n][0]:
                    tree[n] = chain
                n += n & -n  # noqa: PLW2901
    best, k = (0, None), top
    while k > 0:
        best, k = max(best, tree[k], key=lambda x: x[0]), k & (k - 1)
    got, link = {}, best[1]
    while link:
        got[link[0]] = link[1]
        link = link[2]
    spare = sorted(set(free) - set(got.values()))
    anchors = sorted(got.items())
    for (low, after), (high, before) in zip([(0, -1), *anchors], [*anchors, (top + 1, 1 << 62)]):
        between = spare[bisect_right(spare, after) : bisect_left(spare, before)]
        got.update(zip(range(low + 1, high), between))
    return got


def q_page_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Page numbers printed in a booklet in the order expected, with the page that shows each."""
    foot = lines(spark, folder).filter((F.col("y") > 0.9) & F.col("text").rlike(r"^\D*\d{1,3}\D*$")).select("booklet", "page", F.regexp_extract("text", r"(\d{1,3})", 1).alias("digits"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        top = int(pdf["page"].max())
        got = expected_sequence(list(zip(pdf["page"], pdf["digits"])), top)
        return pd.DataFrame({"booklet": pdf["booklet"].iloc[0], "number": list(got), "page": list(got.values())})

    return foot.groupBy("booklet").applyInPandas(scan, "booklet string, number int, page int")  # a booklet's footers


_P = "p AS (SELECT file, min((lines, coalesce(tesseract, chr(0)))) AS p FROM ocr_pages WHERE file IS NOT NULL AND lines IS NOT NULL GROUP BY file), pg AS (SELECT file, p[1] AS lines, nullif(p[2], chr(0)) AS tesseract FROM p)"
_L = f"WITH {_P}, u AS (SELECT file, unnest(range(len(lines))) AS line_no, lines FROM pg), l AS (SELECT file, CAST(line_no AS INT) AS line_no, lines[line_no + 1].text AS text, lines[line_no + 1].conf AS conf, lines[line_no + 1].x AS x, lines[line_no + 1].y AS y, lines[line_no + 1].w AS w, lines[line_no + 1].h AS h, split_part(file, '/', 2) || '/' || split_part(file, '/', 3) AS booklet, CAST(regexp_extract(file, 'p([0-9]+)\\.json$', 1) AS INT) AS page FROM u)"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "line_table": _L + " SELECT file, line_no, text, conf::DOUBLE AS conf, booklet, page FROM l",
    "reading_order": _L + " SELECT file, line_no, row_number() OVER (PARTITION BY file ORDER BY y, x, line_no) AS place FROM l",
    "body_lines": _L + f" SELECT file, line_no, text FROM l WHERE NOT (y > {BOTTOM} AND regexp_matches(text, '{PAGE_NUMBER}')) AND y >= {TOP} AND NOT regexp_matches(text, '{NOTICE}')",
    "notice_pages": _L + f" SELECT file, count(*) FILTER (regexp_matches(text, '{NOTICE}')) AS notices, count(*) AS n FROM l GROUP BY file HAVING count(*) FILTER (regexp_matches(text, '{NOTICE}')) > 0",
    "row_assembly": _L + f", o AS (SELECT *, CASE WHEN abs(y - lag(y) OVER v) <= {ROW} * greatest(h, lag(h) OVER v) THEN 0 ELSE 1 END AS opens FROM l WINDOW v AS (PARTITION BY file ORDER BY y, x, line_no)), r AS (SELECT *, sum(opens) OVER (PARTITION BY file ORDER BY y, x, line_no) AS row FROM o) SELECT file, CAST(row AS BIGINT) AS row, count(*) AS parts, string_agg(text, ' ' ORDER BY x, line_no) AS text FROM r GROUP BY file, row",
    "modal_indent": _L + ", b AS (SELECT file, round(x, 2) AS edge, count(*) AS n FROM l GROUP BY ALL) SELECT file, arg_min(edge, (-n, edge)) AS edge FROM b GROUP BY file",
    "column_edges": _L + f", o AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY file ORDER BY x, line_no) <= {TOLERANCE} THEN 0 ELSE 1 END AS opens FROM l), r AS (SELECT *, sum(opens) OVER (PARTITION BY file ORDER BY x, line_no) AS run FROM o) SELECT file, CAST(run AS BIGINT) AS run, round(avg(x), 4) AS edge, count(*) AS n FROM r GROUP BY file, run HAVING count(*) >= 3",
    "line_pitch": _L + ", s AS (SELECT file, lead(y) OVER (PARTITION BY file ORDER BY y, x, line_no) - y AS dy FROM l) SELECT file, round(median(dy), 6) AS pitch FROM s WHERE dy IS NOT NULL GROUP BY file",
    "widest_gap": _L + f", s AS (SELECT file, line_no, round(lead(y) OVER (PARTITION BY file ORDER BY y, x, line_no) - y - h, 6) AS gap FROM l) SELECT file, arg_max(line_no, (gap, -line_no)) AS line_no, max(gap) AS gap FROM s WHERE gap > {GAP} GROUP BY file",
    "bounding_boxes": _L + f" SELECT file, round(greatest(0.0, min(x) - 0.01), 6) AS x0, round(greatest(0.0, min(y) - 0.01), 6) AS y0, round(least(1.0, max(x + w) + 0.01), 6) AS x1, round(least(1.0, max(y + h) + 0.01), 6) AS y1 FROM l WHERE y BETWEEN {TOP} AND {BOTTOM} GROUP BY file",
    "right_neighbours": _L + " SELECT a.file, a.line_no, arg_min(b.line_no, (b.x, b.line_no)) AS right_no FROM l a JOIN l b ON a.file = b.file AND abs(b.y - a.y) < 0.05 AND b.x > a.x + 0.05 GROUP BY a.file, a.line_no",
    "lines_in_rect": _L + ", g AS (SELECT file, line_no, min(r.region) AS region FROM l JOIN (VALUES (1, 0.0, 0.0, 1.0, 0.5), (2, 0.0, 0.4, 1.0, 1.0)) r(region, rx, ry, rx1, ry1) ON x >= rx - 0.004 AND y >= ry - 0.004 AND x + w <= rx1 + 0.004 AND y + h <= ry1 + 0.004 GROUP BY file, line_no) SELECT file, region, count(*) AS n FROM g GROUP BY file, region",
    "page_reading": f"WITH {_P} SELECT file, CASE WHEN length(coalesce(tesseract, '')) > 200 THEN tesseract ELSE array_to_string(list_transform(lines, lambda x: x.text), chr(10)) END AS text, CASE WHEN length(coalesce(tesseract, '')) > 200 THEN 'second' ELSE 'first' END AS origin FROM pg",
    "booklet_text": _L + " SELECT booklet, count(DISTINCT page) AS pages, count(*) AS n_lines, sum(length(text))::BIGINT AS chars FROM l GROUP BY booklet",
    "dropped_by_one": f"WITH {_P}, k AS (SELECT file, regexp_extract_all(array_to_string(list_transform(lines, lambda x: x.text), ''), '[一-鿿]') AS own, list_distinct(regexp_extract_all(tesseract, '[一-鿿]')) AS second FROM pg WHERE tesseract IS NOT NULL), d AS (SELECT file, array_to_string(list_sort(list_filter(second, lambda c: NOT list_contains(own, c))), '') AS only_second FROM k) SELECT * FROM d WHERE only_second <> ''",
}
