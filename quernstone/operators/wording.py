"""Blank labels put back into wording, and written pages cut into body, asks and answers.

A blank of a written question is a frame with a label, ［a］. Scans lose the frame, the label or both. Every rule acts only where one reading is
possible, and leaves all other texts as they are. Rules are column expressions, so they run where the rows are; pages are cut by windows within a
page.

Defined results: null texts stay null; null or empty label lists change nothing; labels compare by width and letter case evened out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.pages import lines
from quernstone.operators.study import questions
from quernstone.session import table

# Letters in full and half width; digits that pass for letters, and the letters.
WIDE, NARROW = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS, LETTERS = "0169", "olbg"
# Fixed values, in shares of the page: gap within a row that may be a frame, indent that may be one, indent of artwork; and the pitch that a missing row leaves.
INNER_GAP, HEAD_GAP, FAR_INDENT, HOLE = 0.030, 0.04, 0.15, 2.5
BLANK = r"[\s　]*"
FRAME = rf"［{BLANK}([^］\s　]{{1,3}}){BLANK}］"
EMPTY = rf"［{BLANK}］"
#: A blank between two Japanese characters.
GAP = r"(?<=[^\x00-\x7f\s　])[ 　](?=[^\x00-\x7f\s　])"


def evened(label: Column) -> Column:
    """A label without width and letter case."""
    return F.lower(F.translate(label, WIDE, NARROW))


def _class(label: Column) -> Column:
    """A class of all letters that a one-letter label may be read as."""
    plain = evened(label)
    return F.concat(F.lit("["), label, plain, F.upper(plain), F.translate(plain, NARROW, WIDE), F.translate(F.upper(plain), NARROW, WIDE), F.lit("]"))


def _single(labels: Column) -> Column:
    return F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.length(x) == 1)


def _framed(label: Column) -> Column:
    return F.concat(F.lit("［"), label, F.lit("］"))


def _first_line(text: Column, change) -> Column:  # noqa: ANN001
    """`change` of the first line; options under it stay as they are."""
    head = F.substring_index(text, "\n", 1)
    return F.concat(change(head), F.substring(text, F.length(head) + 1, F.length(text)))


def completed_ends(text: Column, labels: Column) -> Column:
    """A single frame with the first or last of several labels becomes the pair, or the range, that it is the end of."""
    shown = F.regexp_extract_all(text, F.lit(FRAME), F.lit(1))
    first, last = F.get(labels, F.lit(0)), F.get(labels, F.size(labels) - 1)
    only = evened(F.get(shown, F.lit(0)))
    whole = F.concat(_framed(first), F.when(F.size(labels) == 2, "").otherwise("～"), _framed(last))
    return F.when((F.size(labels) >= 2) & (F.size(shown) == 1) & ((only == evened(first)) | (only == evened(last))), F.regexp_replace(text, F.lit(FRAME), whole)).otherwise(text)


def quoted_labels(text: Column, labels: Column) -> Column:
    """A frame read as a quotation mark beside its label is a frame again; only in the first line."""

    def change(head: Column) -> Column:
        return F.aggregate(_single(labels), head, lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(rf"(?<![A-Za-z0-9])[「【〔]?{BLANK}"), _class(x), F.lit(rf"{BLANK}[」】〕]")), _framed(x)))

    return _first_line(text, change)


def put_back_blank(text: Column, labels: Column) -> Column:
    """The frame of the only label, lost outright, stands where the only blank between Japanese characters is; only in the first line."""

    def change(head: Column) -> Column:
        lost = (F.size(labels) == 1) & ~head.rlike("［") & (F.regexp_count(head, F.lit(GAP)) == 1)
        return F.when(lost, F.regexp_replace(head, F.lit(GAP), _framed(F.get(labels, F.lit(0))))).otherwise(head)

    return _first_line(text, change)


def pulled_in_labels(text: Column, labels: Column) -> Column:
    """A label that stands before its empty frame goes into it, and frames show labels in their own width and case."""

    def one(acc: Column, x: Column) -> Column:
        acc = F.regexp_replace(acc, F.concat(F.lit(r"(?<![-ー−0-9A-Za-zァ-ヶ])"), _class(x), F.lit(BLANK + EMPTY)), _framed(x))
        return F.regexp_replace(acc, F.concat(F.lit(f"［{BLANK}"), _class(x), F.lit(f"{BLANK}］")), _framed(x))

    return F.aggregate(_single(labels), text, one)


def loose_labels(text: Column, labels: Column) -> Column:
    """A label without any frame in the text, which stands alone beside kana exactly once, is framed there."""

    def one(acc: Column, x: Column) -> Column:
        alone = F.concat(F.lit(r"(?<![-ー−0-9A-Za-zァ-ヶ［])"), _class(x), F.lit("(?=[ぁ-ん])"))
        framed = F.regexp_count(acc, F.concat(F.lit(f"［{BLANK}"), _class(x), F.lit(f"{BLANK}］"))) > 0
        return F.when(~framed & (F.regexp_count(acc, alone) == 1), F.regexp_replace(acc, alone, _framed(x))).otherwise(acc)

    return F.aggregate(_single(labels), text, one)


def resolved_reading(readings: Column, labels: Column, elsewhere: Column) -> Column:
    """The label that the alternative readings of a frame mean, if they mean exactly one.

    A digit passes for the letter it looks like only for labels that were read nowhere else (`elsewhere`: labels read in other frames).
    """
    plain = F.transform(readings, lambda r: evened(F.trim(r)))
    direct = F.filter(labels, lambda x: F.array_contains(plain, evened(x)))
    loose = F.transform(plain, lambda r: F.translate(r, DIGITS, LETTERS))
    missing = F.filter(labels, lambda x: ~F.array_contains(F.transform(elsewhere, evened), evened(x)) & F.array_contains(loose, evened(x)))
    return F.when(F.size(direct) == 1, F.get(direct, F.lit(0))).when((F.size(direct) == 0) & (F.size(missing) == 1), F.get(missing, F.lit(0)))


def shared_options(parts: DataFrame, group: str, place: str, options: str) -> DataFrame:
    """Parts without options of their own get those of the next part of their group that has some."""
    after = Window.partitionBy(group).orderBy(place).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return parts.withColumn(options, F.coalesce(F.first(F.when(F.size(options) > 0, F.col(options)), ignorenulls=True).over(after), F.col(options)))


def pooled_runs(runs: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, x, w, text) with those of a further reading whose middle lies in none of the first's."""
    inner = runs.select(*keys, F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"))
    middle = F.col("x") + F.col("w") / 2
    rows = others.select(*keys, "x", "w", "text")
    return runs.select(*keys, "x", "w", "text").unionAll(rows.join(inner, [*[rows[k] == inner[k] for k in keys], (middle >= inner["x0"]) & (middle <= inner["x1"])], "left_anti"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Written questions with the labels of their case: (id, text, labels)."""
    cases = table(spark, folder, "cases").select(F.col("id").alias("case_id"), F.col("blanks").alias("labels"))
    return questions(spark, folder).filter("section = 'pm' and text is not null").select("id", F.trim("caseId").alias("case_id"), "text").join(cases, "case_id").select("id", "text", "labels")


def q_completed_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Written questions whose single frame stands for a pair or a range."""
    return _labelled(spark, folder).select("id", F.col("text").alias("was"), completed_ends(F.col("text"), F.col("labels")).alias("text")).filter("was <> text").select("id", "text")


def q_put_back_blanks(spark: SparkSession, folder: str) -> DataFrame:
    """Wording of every written question after the rules for quoted, lost and misplaced labels."""
    text, labels = F.col("text"), F.col("labels")
    return _labelled(spark, folder).select("id", pulled_in_labels(put_back_blank(quoted_labels(text, labels), labels), labels).alias("text"))


def q_body_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of case bodies with frames in the labels' own form, and labels beside kana framed."""
    blocks = table(spark, folder, "cases").select("id", F.col("blanks").alias("labels"), F.posexplode("body").alias("pos", "b")).select("id", "labels", "pos", F.col("b.text").alias("text"))
    return blocks.filter("text is not null").select("id", "pos", loose_labels(pulled_in_labels(F.col("text"), F.col("labels")), F.col("labels")).alias("text"))


def q_shared_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of every written item; an item without its own has those of the next item of its case."""
    items = questions(spark, folder).filter("section = 'pm' and caseId is not null").select("id", F.trim("caseId").alias("case_id"), "figures")
    return shared_options(items, "case_id", "id", "figures").select("id", F.array_join("figures", "|").alias("figures"))


def q_asks_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Pages cut at their first ask: the line, and the lines before and from it on (all before where there is none)."""
    w = Window.partitionBy("file").orderBy("y", "x", "line_no")
    ranked = lines(spark, folder).withColumn("place", F.row_number().over(w))
    first = F.min(F.when(F.col("text").rlike("^設問[ 　]*[0-9０-９]"), F.col("place")))
    cut = ranked.groupBy("file").agg(first.alias("first"), F.count("*").alias("n"))
    return cut.select("file", F.col("first").cast("long").alias("first"), F.coalesce(F.col("first") - 1, "n").cast("long").alias("before"), F.coalesce(F.col("n") - F.col("first") + 1, F.lit(0)).cast("long").alias("asks"))


#: What a line opens: an ask, a question, answers, remarks, a header; other lines stay where they are.
STATES = (("ask", "^設問"), ("question", "^[問間][ 　]*[0-9０-９]"), ("answer", "^(?:正解|解答)"), ("remark", "^(?:講評|解説|出題趣旨)"), ("option", "^[アイウエ][ 　.．]"))


def q_line_states(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each page by the part they stand in: the last part opened at or above them, `head` above all."""
    opened = F.lit(None).cast("string")
    for name, pattern in reversed(STATES):
        opened = F.when(F.col("text").rlike(pattern), name).otherwise(opened)
    upto = Window.partitionBy("file").orderBy("y", "x", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.coalesce(F.last("opened", ignorenulls=True).over(upto), F.lit("head"))
    return lines(spark, folder).withColumn("opened", opened).withColumn("state", state).groupBy("file", "state").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def q_answer_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of clean explanations as answer rows: the sub-number stays until the next one, a letter before a blank opens a label, other lines go on."""
    q = questions(spark, folder).filter("explanation is not null").select("id", F.posexplode(F.split("explanation", "\n")).alias("pos", "line")).filter("trim(line) <> ''")
    sub = F.regexp_extract("line", r"^[（(]([0-9])[)）]", 1)
    label = F.regexp_extract("line", r"^(?:[（(][0-9][)）])?[ 　]*([a-zア-ン])[ 　.．]", 1)
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = q.withColumn("sub", F.when(sub != "", sub)).withColumn("label", F.when(label != "", label))
    rows = rows.withColumn("row", F.sum((F.col("sub").isNotNull() | F.col("label").isNotNull()).cast("int")).over(upto)).withColumn("sub", F.last("sub", ignorenulls=True).over(upto))
    return rows.groupBy("id", "row").agg(F.first("sub", ignorenulls=True).alias("sub"), F.max("label").alias("label"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars")).select("id", F.col("row").cast("long").alias("row"), "sub", "label", "n_lines", "chars")


def q_frame_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Where a frame may have been: wide gaps between parts of a row, lines that begin right of the page's usual edge, lines that end early without a stop."""
    w = Window.partitionBy("file", F.round("y", 2)).orderBy("x", "line_no")
    edge = lines(spark, folder).select("file", F.round("x", 2).alias("edge")).groupBy("file", "edge").agg(F.count("*").alias("n")).groupBy("file").agg(F.min_by("edge", F.struct(-F.col("n"), "edge")).alias("edge"))
    at = lines(spark, folder).join(edge, "file").withColumns({"last_end": F.lag(F.col("x") + F.col("w")).over(w), "more": F.lead("x").over(w)})
    inner = F.col("last_end").isNotNull() & (F.col("x") - F.col("last_end") > INNER_GAP)
    head = F.col("last_end").isNull() & (F.col("x") - F.col("edge") > HEAD_GAP) & (F.col("x") - F.col("edge") < FAR_INDENT) & ~F.col("text").rlike("^[「（(・ア-エ]")
    tail = F.col("more").isNull() & (F.col("x") + F.col("w") < 0.8) & ~F.col("text").rlike("[。．.a-zA-Z0-9)）」]$")
    kinds = F.filter(F.array(F.when(inner, "inner"), F.when(head, "head"), F.when(tail, "tail")), lambda x: x.isNotNull())
    return at.select("file", "line_no", F.explode(kinds).alias("kind"))


def q_missing_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with one hole and no other of at least two and a half times their median pitch: the line above it and the height a lost row would have."""
    w = Window.partitionBy("file").orderBy("y", "x", "line_no")
    step = lines(spark, folder).select("file", "line_no", "y", F.round(F.lead("y").over(w) - F.col("y"), 6).alias("dy")).filter("dy > 0")
    pitch = step.groupBy("file").agg(F.round(F.median("dy"), 6).alias("pitch"))
    holes = step.join(pitch, "file").filter(F.col("dy") >= HOLE * F.col("pitch"))
    return holes.groupBy("file").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"), F.round(F.min(F.col("y") + F.col("dy") / 2), 6).alias("height")).filter("n = 1").select("file", "line_no", "height")


def q_figure_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of each page that belongs to a figure: far indented, or a caption after a sentence's end, with the reason."""
    w = Window.partitionBy("file").orderBy("y", "x", "line_no")
    left = Window.partitionBy("file")
    at = lines(spark, folder).withColumns({"place": F.row_number().over(w), "above": F.lag("text").over(w), "edge": F.min("x").over(left)})
    reason = F.when(F.col("text").rlike("^(?:[［〔(（]|図|表)") & (F.col("place") == 1) | F.col("above").rlike("[。．]$") & F.col("text").rlike("^(?:[［〔]|図[0-9０-９]|表[0-9０-９])"), "caption").when(F.col("x") - F.col("edge") > FAR_INDENT, "indent")
    return at.withColumn("reason", reason).filter("reason is not null").groupBy("file").agg(F.min(F.struct("place", "line_no", "reason")).alias("r")).select("file", "r.line_no", "r.reason")


def q_pooled_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pages read twice: those of the first reading, and those of others that it has nothing at the place of."""
    p = table(spark, folder, "ocr_pages").filter("file is not null and lines is not null").select("file", "lines").distinct()
    first = p.groupBy("file").agg(F.min("lines").alias("lines"))
    flat = lambda df: df.select("file", F.explode("lines").alias("l")).select("file", F.round("l.y", 2).alias("row"), F.col("l.x").alias("x"), F.col("l.w").alias("w"), F.col("l.text").alias("text"))
    rest = p.join(first.withColumnRenamed("lines", "own"), "file").filter("lines <> own").select("file", "lines")
    return pooled_runs(flat(first), flat(rest).distinct(), ["file", "row"]).groupBy("file").agg(F.count("*").alias("runs"))


def q_approximate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Answers, distinct questions and the median time of each mode, by sketches that merge (within 1 and 2 parts in a hundred)."""
    log = table(spark, folder, "answer_log").filter("mode is not null")
    return log.groupBy("mode").agg(F.approx_count_distinct("question_id", 0.01).alias("questions"), F.percentile_approx("elapsed_ms", 0.5, 10_000).alias("median_ms"))


_P = "p AS (SELECT file, min(lines) AS lines FROM ocr_pages WHERE file IS NOT NULL AND lines IS NOT NULL GROUP BY file)"
_L = f"{_P}, u AS (SELECT file, unnest(range(len(lines))) AS k, lines FROM p), l AS (SELECT file, CAST(k AS INT) AS line_no, lines[k + 1].text AS text, lines[k + 1].x AS x, lines[k + 1].y AS y, lines[k + 1].w AS w FROM u)"
_O = "(PARTITION BY file ORDER BY y, x, line_no)"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "asks_cut": f"WITH {_L}, r AS (SELECT *, row_number() OVER {_O} AS place FROM l), c AS (SELECT file, min(place) FILTER (regexp_matches(text, '^設問[ 　]*[0-9０-９]')) AS first, count(*) AS n FROM r GROUP BY file) SELECT file, first, coalesce(first - 1, n) AS before, coalesce(n - first + 1, 0) AS asks FROM c",
    "line_states": f"WITH {_L}, o AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in STATES) + f" END AS opened FROM l), s AS (SELECT file, text, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY file ORDER BY y, x, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'head') AS state FROM o) SELECT file, state, count(*) AS n, sum(length(text))::BIGINT AS chars FROM s GROUP BY file, state",
    "answer_rows": "WITH q AS (SELECT id, any_value(explanation) AS e FROM questions WHERE id IS NOT NULL GROUP BY id), u AS (SELECT id, unnest(range(len(string_split(e, chr(10))))) AS pos, string_split(e, chr(10)) AS ls FROM q WHERE e IS NOT NULL), l AS (SELECT id, pos, ls[pos + 1] AS line FROM u WHERE trim(ls[pos + 1]) <> ''),"
    " m AS (SELECT *, nullif(regexp_extract(line, '^[（(]([0-9])[)）]', 1), '') AS s, nullif(regexp_extract(line, '^(?:[（(][0-9][)）])?[ 　]*([a-zア-ン])[ 　.．]', 1), '') AS label FROM l),"
    " r AS (SELECT *, sum(CASE WHEN s IS NOT NULL OR label IS NOT NULL THEN 1 ELSE 0 END) OVER v AS row, last_value(s IGNORE NULLS) OVER v AS sub FROM m WINDOW v AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT id, row::BIGINT AS row, min(sub) AS sub, max(label) AS label, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM r GROUP BY id, row",
    "frame_gaps": f"WITH {_L}, b AS (SELECT file, round(x, 2) AS edge, count(*) AS n FROM l GROUP BY ALL), e AS (SELECT file, arg_min(edge, (-n, edge)) AS edge FROM b GROUP BY file), a AS (SELECT l.*, edge, lag(x + w) OVER v AS last_end, lead(x) OVER v AS more FROM l JOIN e USING (file) WINDOW v AS (PARTITION BY file, round(y, 2) ORDER BY x, line_no)),"
    f" k AS (SELECT file, line_no, unnest([CASE WHEN last_end IS NOT NULL AND x - last_end > {INNER_GAP} THEN 'inner' END, CASE WHEN last_end IS NULL AND x - edge > {HEAD_GAP} AND x - edge < {FAR_INDENT} AND NOT regexp_matches(text, '^[「（(・ア-エ]') THEN 'head' END, CASE WHEN more IS NULL AND x + w < 0.8 AND NOT regexp_matches(text, '[。．.a-zA-Z0-9)）」]$') THEN 'tail' END]) AS kind FROM a) SELECT * FROM k WHERE kind IS NOT NULL",
    "missing_rows": f"WITH {_L}, s AS (SELECT file, line_no, y, round(lead(y) OVER {_O} - y, 6) AS dy FROM l), t AS (SELECT * FROM s WHERE dy > 0), m AS (SELECT file, round(median(dy), 6) AS pitch FROM t GROUP BY file) SELECT file, min(line_no) AS line_no, round(min(y + dy / 2), 6) AS height FROM t JOIN m USING (file) WHERE dy >= {HOLE} * pitch GROUP BY file HAVING count(*) = 1",
    "figure_starts": f"WITH {_L}, a AS (SELECT *, row_number() OVER {_O} AS place, lag(text) OVER {_O} AS above, min(x) OVER (PARTITION BY file) AS edge FROM l), r AS (SELECT *, CASE WHEN (regexp_matches(text, '^(?:[［〔(（]|図|表)') AND place = 1) OR (regexp_matches(above, '[。．]$') AND regexp_matches(text, '^(?:[［〔]|図[0-9０-９]|表[0-9０-９])')) THEN 'caption' WHEN x - edge > {FAR_INDENT} THEN 'indent' END AS reason FROM a) SELECT file, arg_min(line_no, place) AS line_no, arg_min(reason, place) AS reason FROM r WHERE reason IS NOT NULL GROUP BY file",
    "shared_figures": "WITH q AS (SELECT id, any_value(section) AS section, any_value(caseId) AS caseId, any_value(figures) AS figures FROM questions WHERE id IS NOT NULL GROUP BY id), c AS (SELECT id, trim(caseId) AS case_id, figures FROM q WHERE section = 'pm' AND caseId IS NOT NULL) SELECT id, coalesce(array_to_string(coalesce(first_value(CASE WHEN len(figures) > 0 THEN figures END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), figures), '|'), CASE WHEN figures IS NULL THEN NULL ELSE '' END) AS figures FROM c",
}
