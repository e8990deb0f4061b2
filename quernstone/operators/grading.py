"""Grading of answers and the results of runs. A run is one device's answers of one mode on one day (UTC)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernstone.operators.study import DAY_MS, log, pct, questions
from quernstone.session import table

#: Share of the items that passes.
PASS = 0.6


@F.pandas_udf(StringType())
def nfkc(text):  # noqa: ANN001, ANN202
    """Compatibility composition of each text."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def folded(text: Column) -> Column:
    """An answer without what is not the answer: width, blanks, closing stops, quotes and letter case; null is empty."""
    t = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?U)\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, "[，、,]", ","), "[。．.]+$", "")
    return F.lower(F.regexp_replace(t, "[\"'“”‘’`´]", ""))


def auto_mark(kind: Column, answer: Column, options: Column, typed: Column) -> Column:
    """Whether a typed part equals its answer or an option; an essay is for people to judge (null), nothing typed is wrong. All but kind are folded."""
    wanted = F.filter(F.concat(F.array(answer), F.coalesce(options, F.array().cast("array<string>"))), lambda x: x != "")
    return F.when(kind != "essay", F.when(typed == "", False).otherwise(F.array_contains(wanted, typed)))


def auto_result(marks: Column) -> Column:
    """The verdict of all parts: true, partial or false; null if there is no part or one needs a person."""
    return F.when((F.size(marks) <= 0) | F.exists(marks, lambda m: m.isNull()), None).when(F.forall(marks, lambda m: m), "true").when(F.exists(marks, lambda m: m), "partial").otherwise("false")


def kind_of(answer: Column) -> Column:
    """choice (markers only), term (short, no sentence) or essay."""
    a = F.trim(answer)
    return F.when(a.rlike(r"^[（(]?[ア-ン][）)]?(?:\s*[，,、]\s*[（(]?[ア-ン][）)]?)*$"), "choice").when((F.length(a) <= 20) & ~a.contains("。"), "term").otherwise("essay")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    e = log(spark, folder).filter("question_id is not null and answered_at is not null and device is not null")
    return e.withColumn("day", F.floor(F.col("answered_at") / DAY_MS)).select("device", "mode", "day", "question_id", "selected", "typed", "result", "seq")


def q_grade_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Choices held against the key: the recorded and the own verdict."""
    q = questions(spark, folder).filter("answer is not null").select(F.col("id").alias("question_id"), "answer")
    return log(spark, folder).filter("selected is not null").join(q, "question_id").select("seq", "result", F.when(F.col("selected") == F.col("answer"), "true").otherwise("false").alias("verdict"))


def q_typed_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of what was typed."""
    return log(spark, folder).select(F.explode("typed").alias("t")).filter("t is not null").groupBy(kind_of(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


def q_auto_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Typed answers held against the headings' terms of their case; every part of an event."""
    q = questions(spark, folder).filter("section = 'pm'").select(F.col("id").alias("question_id"), F.coalesce("tags", F.array().cast("array<string>")).alias("options"), F.coalesce("answer", F.lit("")).alias("answer"))
    e = log(spark, folder).filter("size(typed) > 0").select("seq", "question_id", F.posexplode("typed").alias("part", "t")).join(q, "question_id")
    marks = e.select("seq", "part", auto_mark(kind_of(F.coalesce("t", F.lit(""))), folded(F.col("answer")), F.transform("options", lambda o: F.lower(o)), folded(F.col("t"))).alias("mark"))
    return marks.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "mark"))), lambda x: x["mark"]).alias("marks")).select("seq", auto_result(F.col("marks")).alias("result"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).groupBy("device", "mode", "day").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "true").alias("correct"), F.count_if(F.col("result") == "partial").alias("partials"), F.count_if(F.col("selected").isNotNull() | F.exists(F.coalesce("typed", F.array().cast("array<string>")), lambda t: F.trim(t) != "") | F.col("result").isNotNull()).alias("answered"))


def q_run_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each run; a partial answer counts half, and sixty per cent pass."""
    s = _scores(spark, folder)
    ratio = (F.col("correct") + 0.5 * F.col("partials")) / F.col("n")
    return s.select("device", "mode", "day", "n", "correct", "partials", "answered", F.round(ratio, 4).alias("ratio"), (ratio >= PASS).alias("passed"))


def q_choice_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Exam runs by full matches only."""
    s = _scores(spark, folder).filter("mode = 'exam'")
    return s.groupBy().agg(F.count("*").alias("runs"), F.count_if(F.col("correct") >= PASS * F.col("n")).alias("passed"))


def q_tag_tally(spark: SparkSession, folder: str) -> DataFrame:
    """Items and correct ones per tag of each mode's runs."""
    q = questions(spark, folder).select(F.col("id").alias("question_id"), F.explode("tags").alias("tag"))
    return _runs(spark, folder).join(q, "question_id").groupBy("mode", "tag").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "true").alias("correct"))


def q_case_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Points per case of runs over at least two cases: one, a half or none for each item."""
    q = questions(spark, folder).filter("caseId is not null").select(F.col("id").alias("question_id"), F.trim("caseId").alias("case_id"))
    r = _runs(spark, folder).join(q, "question_id")
    points = F.when(F.col("result") == "true", 1.0).when(F.col("result") == "partial", 0.5).otherwise(0.0)
    cases = r.groupBy("device", "mode", "day", "case_id").agg(F.sum(points).alias("points"), F.count("*").alias("n"))
    many = cases.groupBy("device", "mode", "day").agg(F.count("*").alias("cases")).filter("cases > 1")
    return cases.join(many, ["device", "mode", "day"]).select("device", "mode", "day", "case_id", "points", "n")


def q_item_status(spark: SparkSession, folder: str) -> DataFrame:
    """Items by how they stand: a verdict, written but unmarked, or untouched."""
    written = F.exists(F.coalesce("typed", F.array().cast("array<string>")), lambda t: F.trim(t) != "") | F.col("selected").isNotNull()
    status = F.when(F.col("result").isNotNull(), F.col("result")).when(written, "unmarked").otherwise("untouched")
    return log(spark, folder).groupBy("mode", status.alias("status")).agg(F.count("*").alias("n"))


def q_wrong_list(spark: SparkSession, folder: str) -> DataFrame:
    """Questions answered wrong, with the start of their text."""
    bad = log(spark, folder).filter("result = 'false'").groupBy("question_id").agg(F.count("*").alias("wrong"))
    text = F.regexp_replace("text", "\n", "")
    q = questions(spark, folder).filter("text is not null").select(F.col("id").alias("question_id"), F.when(F.length(text) > 46, F.concat(F.substring(text, 1, 46), F.lit("…"))).otherwise(text).alias("preview"))
    return bad.join(q, "question_id")


def q_suggested_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The recorded verdict, else the one the flag gives."""
    flag = F.when(F.col("correct"), "true").when(~F.col("correct"), "false")
    return log(spark, folder).groupBy(F.coalesce("result", flag, F.lit("open")).alias("verdict")).agg(F.count("*").alias("n"))


def q_two_source_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys held against a second source, the choice most often recorded as correct: those that disagree."""
    right = log(spark, folder).filter("correct and selected is not null").groupBy("question_id", "selected").agg(F.count("*").alias("n"))
    best = right.groupBy("question_id").agg(F.max_by("selected", F.struct("n", "selected")).alias("second"))
    q = questions(spark, folder).filter("answer is not null").select(F.col("id").alias("question_id"), "answer")
    return q.join(best, "question_id").filter("answer <> second")


def q_accuracy_by_case_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of correct answers by the examiners' rating of the case."""
    q = questions(spark, folder).filter("caseId is not null").select(F.col("id").alias("question_id"), F.trim("caseId").alias("case_id"))
    c = table(spark, folder, "cases").select(F.col("id").alias("case_id"), "overviewRate")
    r = _runs(spark, folder).join(q, "question_id").join(c, "case_id").groupBy("overviewRate").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "true").alias("correct"))
    return r.withColumn("pct", pct(F.col("correct"), F.col("n")))


_L = "l AS (SELECT DISTINCT * FROM answer_log)"
_R = f"{_L}, r AS (SELECT *, CAST(floor(answered_at / 86400000.0) AS BIGINT) AS day FROM l WHERE question_id IS NOT NULL AND answered_at IS NOT NULL AND device IS NOT NULL)"
_Q = "q AS (SELECT id, any_value(coalesce(section, 'am2')) AS section, any_value(tags) AS tags, any_value(answer) AS answer, any_value(trim(caseId)) AS case_id, any_value(text) AS text FROM questions WHERE id IS NOT NULL GROUP BY id)"
_WRITTEN = "(selected IS NOT NULL OR len(list_filter(coalesce(typed, []), lambda t: trim(t) <> '')) > 0)"
_S = f"WITH {_R}, s AS (SELECT device, mode, day, count(*) AS n, count(*) FILTER (result = 'true') AS correct, count(*) FILTER (result = 'partial') AS partials, count(*) FILTER ({_WRITTEN} OR result IS NOT NULL) AS answered FROM r GROUP BY ALL)"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "grade_choice": f"WITH {_L}, {_Q} SELECT seq, result, CASE WHEN selected = answer THEN 'true' ELSE 'false' END AS verdict FROM l JOIN q ON q.id = l.question_id WHERE selected IS NOT NULL AND answer IS NOT NULL",
    "typed_kinds": f"WITH {_L}, t AS (SELECT unnest(typed) AS t FROM l) SELECT CASE WHEN regexp_matches(trim(t), '^[（(]?[ア-ン][）)]?(?:\\s*[，,、]\\s*[（(]?[ア-ン][）)]?)*$') THEN 'choice' WHEN length(trim(t)) <= 20 AND NOT contains(t, '。') THEN 'term' ELSE 'essay' END AS kind, count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY 1",
    "run_scores": _S + " SELECT device, mode, day, n, correct, partials, answered, round((correct + 0.5 * partials) / n, 4)::DOUBLE AS ratio, (correct + 0.5 * partials) / n >= 0.6 AS passed FROM s",
    "choice_pass": _S + " SELECT count(*) AS runs, count(*) FILTER (correct >= 0.6 * n) AS passed FROM s WHERE mode = 'exam'",
    "tag_tally": f"WITH {_R}, {_Q}, t AS (SELECT id, unnest(tags) AS tag FROM q) SELECT mode, tag, count(*) AS n, count(*) FILTER (result = 'true') AS correct FROM r JOIN t ON t.id = r.question_id GROUP BY ALL",
    "case_scores": f"WITH {_R}, {_Q}, c AS (SELECT device, mode, day, case_id, sum(CASE result WHEN 'true' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END)::DOUBLE AS points, count(*) AS n FROM r JOIN q ON q.id = r.question_id WHERE case_id IS NOT NULL GROUP BY ALL) SELECT * FROM c WHERE (device, mode, day) IN (SELECT (device, mode, day) FROM c GROUP BY device, mode, day HAVING count(*) > 1)",
    "item_status": f"WITH {_L} SELECT mode, CASE WHEN result IS NOT NULL THEN result WHEN {_WRITTEN} THEN 'unmarked' ELSE 'untouched' END AS status, count(*) AS n FROM l GROUP BY ALL",
    "wrong_list": f"WITH {_L}, {_Q}, b AS (SELECT question_id, count(*) AS wrong FROM l WHERE result = 'false' GROUP BY 1) SELECT question_id, wrong, CASE WHEN length(replace(text, chr(10), '')) > 46 THEN substring(replace(text, chr(10), ''), 1, 46) || '…' ELSE replace(text, chr(10), '') END AS preview FROM b JOIN q ON q.id = b.question_id WHERE text IS NOT NULL",
    "suggested_verdict": f"WITH {_L} SELECT coalesce(result, CASE WHEN correct THEN 'true' WHEN NOT correct THEN 'false' END, 'open') AS verdict, count(*) AS n FROM l GROUP BY 1",
    "two_source_keys": f"WITH {_L}, {_Q}, c AS (SELECT question_id, selected, count(*) AS n FROM l WHERE correct AND selected IS NOT NULL GROUP BY ALL), b AS (SELECT question_id, arg_max(selected, (n, selected)) AS second FROM c GROUP BY 1) SELECT b.question_id, answer, second FROM b JOIN q ON q.id = b.question_id WHERE answer <> second",
    "accuracy_by_case_rate": f"WITH {_R}, {_Q} SELECT overviewRate, count(*) AS n, count(*) FILTER (result = 'true') AS correct, CAST(round(100.0 * count(*) FILTER (result = 'true') / count(*)) AS BIGINT) AS pct FROM r JOIN q ON q.id = r.question_id JOIN cases c ON c.id = q.case_id GROUP BY overviewRate",
}
