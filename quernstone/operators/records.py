"""Records around the corpus: answer keys and explanations cut from text, near-duplicate reports, runs and their setup, labels, links and reports."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import text as T
from quernstone.operators.corpus import NEAR_GATE, NEAR_RATIO, sequence_ratio
from quernstone.operators.grading import kind_of
from quernstone.operators.study import log, questions
from quernstone.plans.alike import alike_pairs
from quernstone.session import materialize, table

#: Exam setups by section: items, minutes, cases and how many to choose.
EXAMS = (("am1", 30, 50, 0, 0), ("am2", 25, 40, 0, 0), ("pm", 0, 150, 4, 2))


@dataclass(frozen=True)
class Settings:
    """User settings; unknown stored keys are dropped, missing ones keep their default."""

    count: int = 10
    merge: bool = True
    shuffle: bool = False
    theme: str = "auto"

    @classmethod
    def over(cls, stored: dict | None) -> Settings:
        return cls(**{k: v for k, v in (stored or {}).items() if k in asdict(cls())})


def select_partitions(df: DataFrame, section: str | None, sessions: list[str]) -> DataFrame:
    """Rows of one section and some sessions (all where none is named); an unknown section is an error."""
    if section is not None:
        if section not in {e[0] for e in EXAMS}:
            raise ValueError(f"unknown section {section}")
        df = df.filter(F.col("section") == section)
    return df.filter(F.col("sessionId").isin(sessions)) if sessions else df


def source_path(root: Column, session: Column, prefix: Column, kind: Column) -> Column:
    """Where a session's file of a kind is."""
    return F.concat(root, F.lit("/"), session, F.lit("/"), prefix, F.lit("_"), kind, F.lit(".pdf"))


def data_uri(uri: Column) -> Column:
    """The bytes of a base64 data URI."""
    return F.unbase64(F.split_part(uri, F.lit(","), F.lit(2)))


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """`df` without the rows whose keys are in `keys`."""
    return df.join(keys.select(*on), on, "left_anti")


def q_source_paths(spark: SparkSession, folder: str) -> DataFrame:
    s = select_partitions(questions(spark, folder), "pm", []).select("sessionId", "section").distinct()
    return s.select("sessionId", source_path(F.lit("src"), F.col("sessionId"), F.lit("q"), F.lit("ans")).alias("path"))


def q_answer_key_table(spark: SparkSession, folder: str) -> DataFrame:
    """Keys printed as `問 N key`, one text a booklet of 25, and cut out again; booklets that name a number twice with other keys are marked."""
    q = questions(spark, folder).filter("answer is not null").select("id", "sessionId", "section", "answer", F.pmod(F.xxhash64("id"), F.lit(64)).alias("slice"))
    k = F.row_number().over(Window.partitionBy("sessionId", "section", "slice").orderBy("id")) - 1
    n = q.withColumn("k", k).select("id", "answer", F.concat_ws("/", "sessionId", "section", F.col("slice").cast("string"), F.floor(F.col("k") / 25).cast("string")).alias("book"), (F.col("k") % 25 + 1).alias("n"))
    printed = n.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "answer"))), lambda x: F.concat(F.lit("問"), x["n"].cast("string"), F.lit(" "), x["answer"])), "\n").alias("text"))
    pairs = F.transform(F.regexp_extract_all("text", F.lit(r"問\s*\d{1,2}\s+[ア-エ]"), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"(\d+)", 1).cast("int").alias("n"), F.regexp_extract(m, r"([ア-エ])$", 1).alias("key")))
    cut = printed.select("book", F.explode(pairs).alias("p")).select("book", "p.n", "p.key").groupBy("book", "n").agg(F.min("key").alias("key"), (F.count_distinct("key") > 1).alias("conflict"))
    return cut.join(n, ["book", "n"]).select("id", "key", "conflict")


def q_explanation_split(spark: SparkSession, folder: str) -> DataFrame:
    """Explanations printed one after the other under headings `問N` in booklets of 25, without line ends, and split at the headings again."""
    q = questions(spark, folder).filter("explanation <> '' and answer is not null").select("id", "sessionId", "section", F.regexp_replace("explanation", r"\n", "").alias("e"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("slice"))
    k = F.row_number().over(Window.partitionBy("sessionId", "section", "slice").orderBy("id")) - 1
    n = q.withColumn("k", k).select("id", "e", F.concat_ws("/", "sessionId", "section", F.col("slice").cast("string"), F.floor(F.col("k") / 25).cast("string")).alias("book"), (F.col("k") % 25 + 1).cast("int").alias("n"))
    lines = n.select("book", "n", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.concat(F.lit("問"), F.col("n").cast("string")).alias("line")), F.struct(F.lit(1).alias("o"), F.col("e").alias("line")))).alias("l")).select("book", (F.col("n") * 2 + F.col("l.o")).alias("pos"), "l.line")
    w = Window.partitionBy("book").orderBy("pos")
    head = F.col("line").rlike(r"^問\d+$")
    seg = lines.withColumn("seg", F.last(F.when(head, F.regexp_extract("line", r"(\d+)", 1).cast("int")), ignorenulls=True).over(w)).filter(~head)
    got = seg.groupBy("book", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("explanation"))
    return got.join(n.select("book", F.col("n").alias("seg"), "id"), ["book", "seg"]).select("id", "explanation")


def near_gate(rows: DataFrame, threshold: float = NEAR_GATE) -> tuple[DataFrame, DataFrame]:
    """Pairs (id_a, id_b, jaccard, node_a, node_b) of one section, id_a < id_b, whose sets of three-character sequences reach a Jaccard similarity, and
    the distinct texts (node, text); rows: (id, section, body).

    Exact (`plans.alike`). Texts that are equal are one node, so copies are compared once.
    """
    rows = rows.filter("length(body) >= 3").withColumn("c", F.struct(F.xxhash64("body").alias("h"), F.xxhash64(F.lit(1), "body").alias("k")))
    made, _ = materialize(rows.groupBy("section", "c").agg(F.first("body").alias("text")).withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    placed, _ = materialize(rows.select("section", "c", "id").join(made.select("section", "c", "node"), ["section", "c"]).select("node", "id"), "near-ids")
    nodes = made.select("node", "section", "text")
    near, _ = materialize(alike_pairs(nodes, threshold), "near-pairs")
    a, b = placed.withColumnsRenamed({"node": "a", "id": "x"}), placed.withColumnsRenamed({"node": "b", "id": "y"})
    unlike = near.join(a, "a").join(b, "b")
    ahead = F.col("x") < F.col("y")
    unlike = unlike.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "jaccard", F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("node_a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("node_b"))
    copies = placed.join(placed.select("node", F.col("id").alias("id_b")), "node").filter("id < id_b").select(F.col("id").alias("id_a"), "id_b", F.lit(1.0).alias("jaccard"), F.col("node").alias("node_a"), F.col("node").alias("node_b"))
    return unlike.unionAll(copies), nodes.select("node", "text")


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).filter("text is not null and choices is not null").select("id", "section", T.canonical_plain(F.col("text")).alias("body"))


def q_near_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Choice questions whose folded texts share enough three-character sequences."""
    return near_gate(_bodies(spark, folder))[0].select("id_a", "id_b", F.round("jaccard", 4).alias("jaccard"))


def q_near_report(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs past the gate whose texts are as similar as reprints; each pair of texts is compared once in either order."""
    pairs, texts = near_gate(_bodies(spark, folder))
    pairs, _ = materialize(pairs.select("id_a", "id_b", "node_a", "node_b"), "near-met")
    side = texts.hint("merge")  # wide texts of small files: not sent to the driver
    met = pairs.filter("node_a <> node_b").select("node_a", "node_b").distinct().join(side.select(F.col("node").alias("node_a"), F.col("text").alias("a")), "node_a").join(side.select(F.col("node").alias("node_b"), F.col("text").alias("b")), "node_b")
    alike, _ = materialize(met.select("node_a", "node_b", F.round(sequence_ratio("a", "b"), 3).alias("ratio")).filter(F.col("ratio") >= NEAR_RATIO), "near-ratios")
    return pairs.join(alike, ["node_a", "node_b"]).select("id_a", "id_b", "ratio").unionAll(pairs.filter("node_a = node_b").select("id_a", "id_b", F.lit(1.0).alias("ratio")))


def q_exam_config(spark: SparkSession, folder: str) -> DataFrame:
    """Setup of each section present."""
    setup = spark.createDataFrame(EXAMS, "section string, items int, minutes int, cases int, choose int")
    return questions(spark, folder).select("section").distinct().join(F.broadcast(setup), "section")


def q_created_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs as created for each mode and section: graded at the end or at once, and the time limit in milliseconds after the start."""
    modes = spark.createDataFrame([("practice",), ("exam",), ("review",), ("case",)], "mode string")
    exam = F.col("mode") == "exam"
    written = F.col("section") == "pm"
    # sections by modes: a dozen rows
    return q_exam_config(spark, folder).join(F.broadcast(modes), F.lit(True)).select("section", "mode", F.when(exam | written, "end").otherwise("immediate").alias("grading"), F.when(exam | (written & (F.col("minutes") > 0)), F.col("minutes").cast("long") * 60000).alias("limit_ms"))


def q_resumable(spark: SparkSession, folder: str) -> DataFrame:
    """Runs (device, mode, day) with answers and with items left open."""
    day = F.floor(F.col("answered_at") / 86_400_000).alias("day")
    r = log(spark, folder).filter("device is not null and answered_at is not null").groupBy("device", "mode", day).agg(F.count("result").alias("done"), F.count("*").alias("items"))
    return r.filter("done > 0 and done < items")


def q_unmarked_first(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each item of a run: those without a verdict first, then by time."""
    day = F.floor(F.col("answered_at") / 86_400_000)
    w = Window.partitionBy("device", "mode", "day").orderBy(F.col("result").isNull().desc(), "answered_at", "seq")
    e = log(spark, folder).filter("device is not null and answered_at is not null").withColumn("day", day)
    return e.select("seq", F.row_number().over(w).cast("long").alias("place"))


def q_item_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of each written answer by its parts: essay before term before choice; none is an essay."""
    parts = F.transform(F.filter(F.coalesce("typed", F.array().cast("array<string>")), lambda t: t.isNotNull() & (F.trim(t) != "")), kind_of)
    kind = F.when(F.size(parts) == 0, "essay").when(F.array_contains(parts, "essay"), "essay").when(F.array_contains(parts, "term"), "term").otherwise("choice")
    return log(spark, folder).filter("typed is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def drop_page_numbers(s: Column) -> Column:
    """Rows of a dash and digits dropped, and trailing ones up to three times."""
    s = F.regexp_replace(s, r"(?m)^[-–—−－][ 　]?[0-9]{1,3}[ 　]?[-–—−－]?$\n?", "")
    for _ in range(3):
        s = F.regexp_replace(s, r"[ \n][-–—−－][ 　]?[0-9]{1,3}[ 　]?[-–—−－]?\s*$", "")
    return s


def q_without_page_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that lose page numbers."""
    q = questions(spark, folder).filter("text is not null").select("id", "text", drop_page_numbers(F.col("text")).alias("kept"))
    return q.filter("text <> kept").select("id", F.length("kept").alias("chars"))


def q_labelled_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes' options written as `label：text（N字）` and stripped to label and text again."""
    e = table(spark, folder, "am_fixes").filter("choices is not null").select("fix_key", F.explode(F.map_entries("choices")).alias("e")).filter("length(e.value) > 0 and e.key rlike '^[ア-エ]$'")
    line = F.concat(F.col("e.key"), F.lit("："), F.col("e.value"), F.lit("（"), F.length("e.value").cast("string"), F.lit("字）"))
    body = F.regexp_replace(line, r"（[0-9]+字）$", "")
    return e.select("fix_key", F.regexp_extract(body, r"^([^：]+)：", 1).alias("label"), F.regexp_replace(body, r"^[^：]+：", "").alias("answer"))


def q_blank_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """The nth frame of a case's paragraphs is its nth label, where their numbers agree or there is one label."""
    c = table(spark, folder, "cases").filter("size(blanks) > 0").select("id", "blanks", F.array_join("body.text", "").alias("text"))
    frames = F.regexp_extract_all("text", F.lit("［[^［］]*］"), F.lit(0))
    m = c.withColumn("frames", frames).filter("size(frames) > 0 and (size(frames) = size(blanks) or size(blanks) = 1)")
    return m.select("id", F.posexplode("frames").alias("pos", "frame"), "blanks").select("id", "pos", F.get("blanks", F.when(F.size("blanks") == 1, 0).otherwise(F.col("pos"))).alias("label"))


def q_item_blanks(spark: SparkSession, folder: str) -> DataFrame:
    """Framed labels that written items name, and whether their case has them."""
    q = questions(spark, folder).filter("caseId is not null and text is not null").select("id", F.trim("caseId").alias("case_id"), F.explode(F.regexp_extract_all("text", F.lit("［[ 　]*([a-zア-ン])[ 　]*］"), F.lit(1))).alias("label")).distinct()
    c = table(spark, folder, "cases").select(F.col("id").alias("case_id"), F.coalesce("blanks", F.array().cast("array<string>")).alias("blanks"))
    return q.join(c, "case_id", "left").select("id", "label", F.coalesce(F.array_contains("blanks", F.col("label")), F.lit(False)).alias("reachable"))


def q_figure_links(spark: SparkSession, folder: str) -> DataFrame:
    """Exhibits that written items name (図N, 表N) against the captions of their case."""
    q = questions(spark, folder).filter("caseId is not null and text is not null").select("id", F.trim("caseId").alias("case_id"), F.explode(F.regexp_extract_all("text", F.lit("([図表][0-9]+)"), F.lit(1))).alias("ref")).distinct()
    caps = table(spark, folder, "cases").select(F.col("id").alias("case_id"), F.explode("body").alias("b")).filter("b.kind = 'caption'").select("case_id", F.regexp_extract("b.text", "^([図表][0-9]+)", 1).alias("ref")).filter("ref <> ''").distinct().withColumn("found", F.lit(True))
    return q.join(caps, ["case_id", "ref"], "left").select("id", "ref", F.coalesce("found", F.lit(False)).alias("linked"))


def q_placed_blanks(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that a case lacks between two it has, each with the neighbours it goes between."""
    c = table(spark, folder, "cases").select("id", F.explode("blanks").alias("label")).filter("label rlike '^[a-z]$'").distinct().withColumn("code", F.ascii("label"))
    after = F.lead("code").over(Window.partitionBy("id").orderBy("code"))
    holes = c.withColumn("next", after).filter("next > code + 1")
    return holes.select("id", F.explode(F.sequence(F.col("code") + 1, F.col("next") - 1)).alias("m"), F.col("label").alias("after"), F.char("next").alias("before")).select("id", F.char("m").alias("label"), "after", "before")


def is_prose(s: Column) -> Column:
    """Whether a line reads as prose: at least twelve characters, eight of them Japanese, and no inner gap."""
    return (F.length(s) >= 12) & ~s.rlike(r"\S[ 　]{2,}\S") & (F.length(F.regexp_replace(s, "[^ぁ-ゖァ-ヺー一-鿿々]", "")) >= 8)


def q_prose_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Prose and other lines of each source's documents."""
    lines = table(spark, folder, "documents").filter("text is not null").select("source", F.explode(F.split("text", "\n")).alias("s")).filter("s <> ''")
    return lines.groupBy("source").agg(F.count_if(is_prose(F.col("s"))).alias("prose"), F.count("*").alias("n_lines"))


def q_session_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Session labels without the word for the term's number, and the exam's name rebuilt."""
    s = table(spark, folder, "sessions")
    short = F.regexp_replace("label", r"期\s*", "-")
    return s.select("id", short.alias("short"), F.concat(F.regexp_extract("exam_name", r"^(\S+)", 1), F.lit(" "), F.col("label")).alias("name"))


def q_review_report(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the review report: a heading and the start of the text of each question marked for review."""
    q = questions(spark, folder).filter("needsReview")
    return q.select("id", F.concat(F.lit("## "), "id", F.lit("\n"), T.preview(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n", " "), 40)).alias("entry"))


def q_without_orphan_states(spark: SparkSession, folder: str) -> DataFrame:
    """States after those of unknown questions are deleted."""
    s = table(spark, folder, "states").select("question_id", "attempts")
    gone = delete_keys(s, questions(spark, folder).select(F.col("id").alias("question_id")), ["question_id"])
    return delete_keys(s, gone, ["question_id"])


def q_source_share(spark: SparkSession, folder: str) -> DataFrame:
    """Where explanations come from."""
    return questions(spark, folder).groupBy(F.coalesce("explanationSource", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.count_if("needsReview").alias("review"))


_Q = "q AS (SELECT id, any_value(coalesce(section, 'am2')) AS section, any_value(sessionId) AS sessionId, any_value(text) AS text, any_value(answer) AS answer, any_value(explanation) AS explanation, any_value(choices) AS choices, any_value(trim(caseId)) AS case_id, any_value(needsReview) AS needsReview, any_value(explanationSource) AS src FROM questions WHERE id IS NOT NULL GROUP BY id)"
_L = "l AS (SELECT *, CAST(floor(answered_at / 86400000.0) AS BIGINT) AS day FROM (SELECT DISTINCT * FROM answer_log))"
_C = "c AS (SELECT DISTINCT id, unnest(blanks) AS label FROM cases), v AS (SELECT id, label, ascii(label) AS code FROM c WHERE regexp_matches(label, '^[a-z]$'))"


def _gate_sql() -> str:
    from quernstone.operators.corpus import _canon_sql

    return f"""WITH {_Q}, t AS (SELECT id, section, {_canon_sql('text')} AS b FROM q WHERE text IS NOT NULL AND choices IS NOT NULL),
g AS (SELECT DISTINCT id, section, unnest(list_transform(range(1, length(b) - 1), lambda i: substring(b, i, 3))) AS g FROM t WHERE length(b) >= 3), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.section = b.section AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b, round(k / (x.n + y.n - k), 4)::DOUBLE AS jaccard FROM m JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k / (x.n + y.n - k) >= {NEAR_GATE}"""


_KINDS = "CASE WHEN regexp_matches(trim(t), '^[（(]?[ア-ン][）)]?(?:\\s*[，,、]\\s*[（(]?[ア-ン][）)]?)*$') THEN 'choice' WHEN length(trim(t)) <= 20 AND NOT contains(t, '。') THEN 'term' ELSE 'essay' END"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "without_page_numbers": "WITH q AS (SELECT id, any_value(text) AS text FROM questions WHERE id IS NOT NULL GROUP BY id), k0 AS (SELECT id, text, regexp_replace(text, '(?m)^[-–—−－][ 　]?[0-9]{1,3}[ 　]?[-–—−－]?$\n?', '', 'g') AS k FROM q WHERE text IS NOT NULL),"
    + "".join(f" k{n} AS (SELECT id, text, regexp_replace(k, '[ \\n][-–—−－][ 　]?[0-9]{{1,3}}[ 　]?[-–—−－]?\\s*$', '', 'g') AS k FROM k{n - 1})," for n in (1, 2, 3)).rstrip(",")
    + " SELECT id, length(k) AS chars FROM k3 WHERE text <> k",
    "source_paths": f"WITH {_Q} SELECT DISTINCT sessionId, 'src/' || sessionId || '/q_ans.pdf' AS path FROM q WHERE section = 'pm'",
    "answer_key_table": f"WITH {_Q} SELECT id, answer AS key, false AS conflict FROM q WHERE answer IS NOT NULL",
    "explanation_split": f"WITH {_Q} SELECT id, replace(explanation, chr(10), '') AS explanation FROM q WHERE explanation <> '' AND answer IS NOT NULL",
    "near_gate": _gate_sql(),
    "exam_config": f"WITH {_Q} SELECT DISTINCT section, items, minutes, cases, choose FROM q JOIN (VALUES ('am1', 30, 50, 0, 0), ('am2', 25, 40, 0, 0), ('pm', 0, 150, 4, 2)) e(s, items, minutes, cases, choose) ON s = section",
    "created_runs": f"WITH {_Q} SELECT DISTINCT section, mode, CASE WHEN mode = 'exam' OR section = 'pm' THEN 'end' ELSE 'immediate' END AS grading, CASE WHEN mode = 'exam' OR section = 'pm' THEN CAST(minutes AS BIGINT) * 60000 END AS limit_ms FROM q JOIN (VALUES ('am1', 50), ('am2', 40), ('pm', 150)) e(s, minutes) ON s = section, (VALUES ('practice'), ('exam'), ('review'), ('case')) m(mode)",
    "resumable": f"WITH {_L} SELECT device, mode, day, count(result) AS done, count(*) AS items FROM l WHERE device IS NOT NULL AND answered_at IS NOT NULL GROUP BY ALL HAVING count(result) > 0 AND count(result) < count(*)",
    "unmarked_first": f"WITH {_L} SELECT seq, row_number() OVER (PARTITION BY device, mode, day ORDER BY (result IS NULL) DESC, answered_at, seq) AS place FROM l WHERE device IS NOT NULL AND answered_at IS NOT NULL",
    "item_kinds": f"WITH {_L}, p AS (SELECT list_transform(list_filter(typed, lambda t: t IS NOT NULL AND trim(t) <> ''), lambda t: {_KINDS}) AS k FROM l WHERE typed IS NOT NULL) SELECT CASE WHEN len(k) = 0 OR list_contains(k, 'essay') THEN 'essay' WHEN list_contains(k, 'term') THEN 'term' ELSE 'choice' END AS kind, count(*) AS n FROM p GROUP BY 1",
    "labelled_answers": "WITH e AS (SELECT fix_key, unnest(map_entries(choices)) AS e FROM am_fixes WHERE choices IS NOT NULL) SELECT fix_key, e.key AS label, e.value AS answer FROM e WHERE length(e.value) > 0 AND regexp_matches(e.key, '^[ア-エ]$')",
    "item_blanks": f"WITH {_Q}, r AS (SELECT DISTINCT id, case_id, unnest(regexp_extract_all(text, '［[ 　]*([a-zア-ン])[ 　]*］', 1)) AS label FROM q WHERE case_id IS NOT NULL AND text IS NOT NULL) SELECT r.id, label, coalesce(list_contains(blanks, label), false) AS reachable FROM r LEFT JOIN cases c ON c.id = case_id",
    "figure_links": f"WITH {_Q}, r AS (SELECT DISTINCT id, case_id, unnest(regexp_extract_all(text, '([図表][0-9]+)', 1)) AS ref FROM q WHERE case_id IS NOT NULL AND text IS NOT NULL), b AS (SELECT id AS case_id, unnest(body) AS b FROM cases), k AS (SELECT DISTINCT case_id, regexp_extract(b.text, '^([図表][0-9]+)', 1) AS ref FROM b WHERE b.kind = 'caption') SELECT r.id, r.ref, k.ref IS NOT NULL AS linked FROM r LEFT JOIN k ON k.case_id = r.case_id AND k.ref = r.ref",
    "placed_blanks": f"WITH {_C}, h AS (SELECT id, label AS after, code, lead(code) OVER (PARTITION BY id ORDER BY code) AS nxt FROM v), m AS (SELECT id, after, nxt, unnest(range(code + 1, nxt)) AS m FROM h WHERE nxt > code + 1) SELECT id, chr(CAST(m AS INT)) AS label, after, chr(CAST(nxt AS INT)) AS before FROM m",
    "prose_lines": "WITH s AS (SELECT source, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL) SELECT source, count(*) FILTER (length(s) >= 12 AND NOT regexp_matches(s, '[^\\s][ 　]{2,}[^\\s]') AND length(regexp_replace(s, '[^ぁ-ゖァ-ヺー一-鿿々]', '', 'g')) >= 8) AS prose, count(*) AS n_lines FROM s WHERE s <> '' GROUP BY source",
    "session_labels": "SELECT id, regexp_replace(label, '期\\s*', '-', 'g') AS short, regexp_extract(exam_name, '^([^\\s]+)', 1) || ' ' || label AS name FROM sessions",
    "review_report": f"WITH {_Q}, r AS (SELECT id, replace(coalesce(text, ''), chr(10), ' ') AS t FROM q WHERE needsReview) SELECT id, '## ' || id || chr(10) || CASE WHEN length(t) > 40 THEN substring(t, 1, 40) || '…' ELSE t END AS entry FROM r",
    "without_orphan_states": "SELECT question_id, attempts FROM states WHERE question_id IN (SELECT id FROM questions)",
    "source_share": f"WITH {_Q} SELECT coalesce(src, 'none') AS source, count(*) AS n, count(*) FILTER (needsReview) AS review FROM q GROUP BY 1",
}
