"""Segmentation: documents and answers cut into blocks, paragraphs and items by order-dependent rules.

Each rule works within one document or case, whose lines are ordered by an explicit place; nothing relies on the order of rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import text as T
from quernstone.operators.study import questions
from quernstone.session import table

#: A heading, lines that open a block, and line ends that end a sentence.
HEADING = r"^(〔.+〕|\[Background.*\])$"
OPENS = r"^\s*(?:[・●○◆■□▪]|\(\d+\)|（\d+）|[0-9０-９]+[.．]|[ア-ン][.．)）]|[①-⑳]|【|〔|\[)"
ENDS = r"[。！？!?：:]\s*$"
WRAPPED = 0.8


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the documents (doc_id, pos, line), empty ones included."""
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def q_line_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Text between headings belongs to the heading above it: (doc_id, seg, heading, lines, chars)."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike(HEADING)
    marked = document_lines(spark, folder).filter("line <> ''").withColumn("seg", F.sum(head.cast("int")).over(w)).withColumn("heading", F.when(head, F.col("line")))
    return marked.groupBy("doc_id", "seg").agg(F.max("heading").alias("heading"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


def q_paragraph_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document that are not empty."""
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


def unwrapped(lines: DataFrame, key: str) -> DataFrame:
    """Paragraphs of hard-wrapped lines (key, pos, line): (key, par, text).

    The width above which nine tenths of a text's lines do not reach is full; a line of four fifths of it that ends no sentence goes on in
    the next, unless that opens a block or an empty line is between.
    """
    w = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("line", F.regexp_replace("line", r"^[ \t　]+|[ \t　]+$", ""))
    rows = rows.withColumn("gap", (F.lag("line").over(w) == "").cast("int")).filter("line <> ''")
    rows = rows.withColumn("width", F.length("line") + F.length(F.regexp_replace("line", "[\\x20-\\x7e｡-ﾟ]", "")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("width")) - 1
    total = F.count("*").over(Window.partitionBy(key))
    full = rows.withColumn("r", rank).withColumn("n", total).filter(F.col("r") == F.floor(F.col("n") * 0.9)).select(key, F.col("width").alias("full"))
    rows = rows.join(full, key)
    wrapped = (F.col("width") >= WRAPPED * F.col("full")) & ~F.col("line").rlike(ENDS)
    opens = ~F.coalesce(F.lag(wrapped).over(w), F.lit(False)) | F.col("line").rlike(OPENS) | (F.coalesce("gap", F.lit(0)) == 1)
    rows = rows.withColumn("par", F.sum(opens.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    joined = F.aggregate(F.transform(parts, lambda p: p["line"]), F.lit(""), T.seam)
    return rows.groupBy(key, "par").agg(joined.alias("text"))


def q_unwrapped_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of scanned question texts."""
    q = questions(spark, folder).filter("text is not null")
    return unwrapped(q.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")), "id")


def q_case_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the cases in order, with the heading each stands under."""
    w = Window.partitionBy("id").orderBy("pos")
    b = table(spark, folder, "cases").select("id", F.posexplode("body").alias("pos", "b")).select("id", "pos", "b.kind", "b.text", "b.page")
    return b.select("id", "pos", "kind", "page", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("heading"))


def q_case_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Successive paragraphs of one page joined: a paragraph goes on while kind and page stay."""
    w = Window.partitionBy("id").orderBy("pos")
    b = table(spark, folder, "cases").select("id", F.posexplode("body").alias("pos", "b")).select("id", "pos", "b.kind", "b.text", "b.page")
    opens = ~((F.col("kind") == "para") & F.lag("kind").over(w).eqNullSafe(F.lit("para")) & F.lag("page").over(w).eqNullSafe(F.col("page")))
    runs = b.withColumn("run", F.sum(opens.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return runs.groupBy("id", "run").agg(F.min("kind").alias("kind"), F.count("*").alias("blocks"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def q_captions_below(spark: SparkSession, folder: str) -> DataFrame:
    """Drawn region of each caption: the blocks after it up to the next heading or caption."""
    after = Window.partitionBy("id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    b = table(spark, folder, "cases").select("id", F.posexplode("body").alias("pos", "b")).select("id", "pos", "b.kind", "b.text")
    stop = F.min(F.when(F.col("kind").isin("heading", "caption"), F.col("pos"))).over(after)
    end = F.max("pos").over(Window.partitionBy("id"))
    return b.withColumn("stop", F.coalesce(stop, end + 1)).filter("kind = 'caption'").select("id", "pos", "text", (F.col("stop") - F.col("pos") - 1).alias("blocks"))


def q_case_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rating of each case against the one its overview states, if it does."""
    c = table(spark, folder, "cases").filter("overview is not null")
    return c.select("id", "overviewRate", T.rate_of(F.col("overview")).alias("stated"))


def q_item_commentary(spark: SparkSession, folder: str) -> DataFrame:
    """Written items with their own explanation, else the case's overview."""
    q = questions(spark, folder).filter("section = 'pm' and caseId is not null").select("id", F.trim("caseId").alias("case_id"), "explanation")
    c = table(spark, folder, "cases").select(F.col("id").alias("case_id"), "overview", "overviewRate")
    return q.join(c, "case_id", "left").select("id", F.coalesce("explanation", "overview").alias("commentary"), "overviewRate", F.when(F.col("explanation").isNotNull(), "item").when(F.col("overview").isNotNull(), "case").otherwise("none").alias("origin"))


def q_choice_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Choice questions whose options are not marked ア to エ in order."""
    q = questions(spark, folder).filter("choices is not null")
    marks = F.array_join(F.col("choices.key"), "")
    return q.select("id", marks.alias("marks")).filter("marks <> 'アイウエ'")


def q_figure_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that point at an exhibit, and whether they have figures."""
    mention = F.col("text").rlike(r"図[0-9０-９中]|表[0-9０-９中]|図に示す|表に示す|下線[①-⑳]")
    return questions(spark, folder).filter("text is not null").filter(mention).select("id", (F.size("figures") > 0).alias("has_figure"))


def q_markers_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """Circled numbers of each text, as numbers in order."""
    q = questions(spark, folder).filter("text is not null")
    found = F.transform(F.regexp_extract_all("text", F.lit("[①-⑳]"), F.lit(0)), lambda c: F.ascii(c) - 9311)
    return q.select("id", found.alias("numbers")).filter("size(numbers) > 0").select("id", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"))


def mend_sequence(numbers: list[int]) -> list[int]:
    """Numbers that should run 1, 2, 3 …: the one out of order is replaced by the number that fits, if only one does."""
    wrong = [i for i, n in enumerate(numbers) if n != i + 1]
    if len(wrong) == 1 and numbers[wrong[0]] not in range(1, len(numbers) + 1):
        return [i + 1 if i == wrong[0] else n for i, n in enumerate(numbers)]
    return numbers


#: Lines of an answer table: item, sub-item, label with answer, remark.
_ITEM, _SUB, _LABEL, _REMARK = re.compile(r"^設問\s*([0-9０-９]+)"), re.compile(r"^[（(]([0-9０-９]+)[）)]\s*(.*)"), re.compile(r"^([a-zア-ン]|[①-⑳])[\s　]+(.+)"), re.compile(r"^(?:全て)?(?:各)?順不同$|^.{0,20}も可$|^別解$")


def parse_answers(text: str) -> list[tuple[int, int, str, str, str]]:
    """Parts (item, sub, label, answer, remark) of an answer table's lines.

    A sub-number that is neither the next nor the one after is text; a line that matches nothing goes on in the answer above.
    """
    out: list[list] = []
    item = sub = 0
    for raw in text.split("\n"):
        line = raw.strip().lstrip("・").strip()
        if not line:
            continue
        if m := _ITEM.match(line):
            item, sub = int(m[1].translate(str.maketrans(T.FULL_DIGITS, "0123456789"))), 0
            line = line[m.end() :].strip()
            if not line:
                continue
        if (m := _SUB.match(line)) and int(m[1].translate(str.maketrans(T.FULL_DIGITS, "0123456789"))) in (sub + 1, sub + 2):
            sub = int(m[1].translate(str.maketrans(T.FULL_DIGITS, "0123456789")))
            line = m[2].strip()
            if not line:
                continue
            out.append([item, sub, "", line, ""])
        elif _REMARK.match(line):
            if out:
                out[-1][4] = line
        elif m := _LABEL.match(line):
            out.append([item, sub, m[1], m[2], ""])
        elif out and out[-1][0] == item and not out[-1][3].endswith("。"):
            out[-1][3] += line
        else:
            out.append([item, sub, "", line, ""])
    return [tuple(x) for x in out]


def answer_parts(tables: DataFrame) -> DataFrame:
    """Parts of answer tables (doc, text): (doc, pos, item, sub, label, answer, remark)."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = [(d, i, *p) for d, t in zip(pdf["doc"], pdf["text"]) for i, p in enumerate(parse_answers(t or ""))]
            yield pd.DataFrame(rows, columns=["doc", "pos", "item", "sub", "label", "answer", "remark"])

    return tables.select("doc", "text").mapInPandas(run, "doc string, pos int, item int, sub int, label string, answer string, remark string")


def q_answer_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Answer tables of the cases, made of their blanks and rates, parsed into parts."""
    c = table(spark, folder, "cases").filter("size(blanks) > 0")
    lines = F.concat(F.array(F.lit("設問1")), F.transform("blanks", lambda b: F.concat(b, F.lit(" "), F.coalesce("title", F.lit("")))), F.array(F.lit("順不同")))
    return answer_parts(c.select(F.col("id").alias("doc"), F.array_join(lines, "\n").alias("text"))).select("doc", "pos", "item", "label", "answer", "remark")


_Q = "q AS (SELECT id, any_value(coalesce(section, 'am2')) AS section, any_value(text) AS text, any_value(explanation) AS explanation, any_value(choices) AS choices, any_value(figures) AS figures, any_value(trim(caseId)) AS case_id FROM questions WHERE id IS NOT NULL GROUP BY id)"
_B = "WITH u AS (SELECT id, unnest(range(len(body))) AS pos, body FROM cases), b AS (SELECT id, CAST(pos AS INT) AS pos, body[pos + 1].kind AS kind, body[pos + 1].text AS text, body[pos + 1].page AS page FROM u)"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "line_segments": f"WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(len(ls))) AS pos, ls FROM d), l AS (SELECT doc_id, pos, ls[pos + 1] AS line FROM u WHERE ls[pos + 1] <> ''), s AS (SELECT *, sum(regexp_matches(line, '{HEADING}')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM l) SELECT doc_id, CAST(seg AS BIGINT) AS seg, max(CASE WHEN regexp_matches(line, '{HEADING}') THEN line END) AS heading, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM s GROUP BY doc_id, seg",
    "paragraph_counts": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS paragraphs FROM documents WHERE text IS NOT NULL",
    "case_blocks": _B + " SELECT id, pos, kind, page, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM b",
    "case_paragraphs": _B + ", o AS (SELECT *, CASE WHEN kind = 'para' AND lag(kind) OVER w IS NOT DISTINCT FROM 'para' AND lag(page) OVER w IS NOT DISTINCT FROM page THEN 0 ELSE 1 END AS opens FROM b WINDOW w AS (PARTITION BY id ORDER BY pos)), r AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY pos) AS run FROM o) SELECT id, CAST(run AS BIGINT) AS run, min(kind) AS kind, count(*) AS blocks, string_agg(text, '' ORDER BY pos) AS text FROM r GROUP BY id, run",
    "captions_below": _B + ", s AS (SELECT *, coalesce(min(CASE WHEN kind IN ('heading', 'caption') THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(pos) OVER (PARTITION BY id) + 1) AS stop FROM b) SELECT id, pos, text, stop - pos - 1 AS blocks FROM s WHERE kind = 'caption'",
    "case_overview": "SELECT id, overviewRate, CASE WHEN regexp_matches(overview, '正答率[^。]{0,8}やや低') THEN 'やや低' WHEN regexp_matches(overview, '正答率[^。]{0,8}やや高') THEN 'やや高' WHEN regexp_matches(overview, '正答率[^。]{0,8}平均的') THEN '平均' WHEN regexp_matches(overview, '正答率[^。]{0,8}(低|高くなかった)') THEN '低' WHEN regexp_matches(overview, '正答率[^。]{0,8}高') THEN '高' END AS stated FROM cases WHERE overview IS NOT NULL",
    "item_commentary": f"WITH {_Q} SELECT q.id, coalesce(explanation, overview) AS commentary, overviewRate, CASE WHEN explanation IS NOT NULL THEN 'item' WHEN overview IS NOT NULL THEN 'case' ELSE 'none' END AS origin FROM q LEFT JOIN cases c ON c.id = q.case_id WHERE q.section = 'pm' AND case_id IS NOT NULL",
    "choice_markers": f"WITH {_Q} SELECT id, array_to_string(list_transform(choices, lambda c: c.key), '') AS marks FROM q WHERE choices IS NOT NULL AND array_to_string(list_transform(choices, lambda c: c.key), '') <> 'アイウエ'",
    "figure_mentions": f"WITH {_Q} SELECT id, len(figures) > 0 AS has_figure FROM q WHERE regexp_matches(text, '図[0-9０-９中]|表[0-9０-９中]|図に示す|表に示す|下線[①-⑳]')",
    "markers_in_text": f"WITH {_Q}, n AS (SELECT id, list_transform(regexp_extract_all(text, '[①-⑳]'), lambda c: unicode(c) - 9311) AS n FROM q WHERE text IS NOT NULL) SELECT id, array_to_string(n, ',') AS numbers FROM n WHERE len(n) > 0",
}
