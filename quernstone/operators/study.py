"""Study records: spaced repetition, due queue, accuracy, sittings and trends.

The learning state is not folded event by event: attempts are counts, and the box is one more than the correct answers
since the last wrong one (at most five), so a question with any share of the log is aggregated in parts before the shuffle.
Repeated log rows count once; rows without a question, time or result are not graded and change no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import table

#: Days until a box comes round, and for a question that leaves the last box (fixed values).
DAYS, LAST_DAYS = {1: 0, 2: 1, 3: 3, 4: 7, 5: 16}, 35
DAY_MS, GAP_MS, HOUR_MS = 86_400_000, 20 * 60_000, 3_600_000


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The answer log, rows that repeat once."""
    return table(spark, folder, "answer_log").distinct()


def graded(spark: SparkSession, folder: str) -> DataFrame:
    """Graded events (question_id, at, seq, result)."""
    return log(spark, folder).filter("question_id is not null and answered_at is not null and result is not null").select("question_id", F.col("answered_at").alias("at"), "seq", "result", "mode", "elapsed_ms")


def section(col: Column) -> Column:
    """The section, which is am2 where it is absent."""
    return F.coalesce(col, F.lit("am2"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions, one row per id, with the section filled in."""
    return table(spark, folder, "questions").filter("id is not null").withColumn("section", section(F.col("section"))).dropDuplicates(["id"])


def _days(box: Column) -> Column:
    out = F.lit(0)
    for b, d in DAYS.items():
        out = F.when(box == b, d).otherwise(out)
    return out


def day_after(at: Column, days: Column) -> Column:
    """Midnight (UTC) of the day plus whole days; no days is the moment itself."""
    return F.when(days == 0, at).otherwise((F.floor(at / DAY_MS) + days) * F.lit(DAY_MS).cast("long"))


def leitner_state(events: DataFrame) -> DataFrame:
    """State of each question after its events (question_id, at, seq, result), in order of time, then seq."""
    moment = F.struct("at", "seq")
    base = events.groupBy("question_id").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("result") == "true").alias("corrects"),
        F.count_if(F.col("result") == "partial").alias("partials"),
        F.max_by("result", moment).alias("last_result"),
        F.max("at").alias("last_answered_at"),
        F.max(F.when(F.col("result") == "false", moment)).alias("fell"),
    )
    since = (
        events.filter("result = 'true'")
        .join(base.select("question_id", "fell"), "question_id")
        .filter(F.col("fell").isNull() | (F.struct("at", "seq") > F.col("fell")))
        .groupBy("question_id")
        .agg(F.count("*").alias("run"))
    )
    run = F.coalesce("run", F.lit(0))
    box = F.least(F.lit(5), 1 + run)
    before = F.when(F.col("last_result") == "true", F.least(F.lit(5), run)).otherwise(box)
    at = F.col("last_answered_at")
    due = (
        F.when(F.col("last_result") == "false", at)
        .when(F.col("last_result") == "partial", day_after(at, _days(before)))
        .when(before >= 5, day_after(at, F.lit(LAST_DAYS)))
        .otherwise(day_after(at, _days(before + 1)))
    )
    return base.join(since, "question_id", "left").select("question_id", "attempts", "corrects", "partials", "last_result", box.cast("long").alias("leitner_box"), due.alias("due_at"), "last_answered_at")


def q_leitner_state(spark: SparkSession, folder: str) -> DataFrame:
    return leitner_state(graded(spark, folder))


def q_leitner_box_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Questions in each of the five boxes; empty boxes count zero."""
    boxes = spark.range(1, 6).select(F.col("id").alias("leitner_box"))
    counts = q_leitner_state(spark, folder).groupBy("leitner_box").agg(F.count("*").alias("n"))
    return boxes.join(F.broadcast(counts), "leitner_box", "left").select("leitner_box", F.coalesce("n", F.lit(0)).alias("n"))


def q_due_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Attempted questions due by the time of the last event."""
    states = q_leitner_state(spark, folder)
    now = graded(spark, folder).agg(F.max("at").alias("now"))
    return states.crossJoin(F.broadcast(now)).filter("attempts > 0 and coalesce(due_at, 0) <= now").select("question_id", "leitner_box", "due_at")  # one row on the right


def q_states_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Stored states merged with the log's: of each question the one answered last; ties keep the stored one."""
    stored = table(spark, folder, "states").select("question_id", F.col("attempts").cast("long"), F.col("corrects").cast("long"), F.col("partials").cast("long"), "last_result", F.col("leitner_box").cast("long"), "due_at", "last_answered_at", F.lit(1).alias("own"))
    both = stored.unionByName(q_leitner_state(spark, folder).withColumn("own", F.lit(0)))
    rest = [c for c in both.columns if c not in ("question_id", "own")]
    best = both.groupBy("question_id").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("last_answered_at", F.lit(-1)), "own")).alias("s"))
    return best.select("question_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def pct(a: Column, b: Column) -> Column:
    """Whole per cent, 0 of nothing."""
    return F.when(b == 0, 0).otherwise(F.round(100 * a / b)).cast("long")


def _states(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "states").filter("attempts > 0")


def q_accuracy_overall(spark: SparkSession, folder: str) -> DataFrame:
    sums = _states(spark, folder).agg(F.count("*").alias("attempted"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("corrects"), F.lit(0)).alias("corrects"))
    return sums.withColumn("pct", pct(F.col("corrects"), F.col("attempts")))


def q_accuracy_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    """A question counts in each of its tags."""
    q = questions(spark, folder).select(F.col("id").alias("question_id"), F.explode("tags").alias("tag"))
    sums = _states(spark, folder).join(q, "question_id").groupBy("tag").agg(F.sum("attempts").alias("attempts"), F.sum("corrects").alias("corrects"))
    return sums.withColumn("pct", pct(F.col("corrects"), F.col("attempts")))


def q_accuracy_by_session(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder).select(F.col("id").alias("question_id"), "sessionId")
    sums = _states(spark, folder).join(q, "question_id").groupBy("sessionId").agg(F.count("*").alias("attempted"), F.sum("attempts").alias("attempts"), F.sum("corrects").alias("corrects"))
    return sums.withColumn("pct", pct(F.col("corrects"), F.col("attempts")))


def sittings(events: DataFrame, keys: list[str], gap_ms: int = GAP_MS) -> DataFrame:
    """Runs of events (at, seq, result) of each key with no gap longer than `gap_ms`: (keys, sitting, n, correct, first_at, last_at).

    Events are ordered within hours; hours are stitched by their first and last events. So a key that holds any share of the log is
    spread over its hours.
    """
    hour = F.floor(F.col("at") / HOUR_MS).alias("hour")
    e = events.select(*keys, "at", "seq", "result", hour)
    inside = Window.partitionBy(*keys, "hour").orderBy("at", "seq")
    hours = e.groupBy(*keys, "hour").agg(F.min("at").alias("head"), F.max("at").alias("tail"))
    over = Window.partitionBy(*keys).orderBy("hour")
    hours = hours.withColumn("opens", (F.lag("tail").over(over).isNull() | (F.col("head") - F.lag("tail").over(over) > gap_ms)).cast("long"))
    marked = e.withColumn("inner", (F.col("at") - F.lag("at").over(inside) > gap_ms).cast("long")).fillna(0, ["inner"])
    counted = marked.groupBy(*keys, "hour").agg(F.sum("inner").alias("more"))
    before = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    placed = hours.join(counted, [*keys, "hour"]).withColumn("base", F.coalesce(F.sum(F.col("opens") + F.col("more")).over(before), F.lit(0)) + F.col("opens"))
    run = Window.partitionBy(*keys, "hour").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("own", F.sum("inner").over(run)).join(placed.select(*keys, "hour", "base"), [*keys, "hour"])
    return (
        numbered.withColumn("sitting", F.col("base") + F.col("own"))
        .groupBy(*keys, "sitting")
        .agg(F.count("*").alias("n"), F.count_if(F.col("result") == "true").alias("correct"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    )


def _by_section(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder).select(F.col("id").alias("question_id"), "section")
    return graded(spark, folder).join(q, "question_id")


def q_sittings(spark: SparkSession, folder: str) -> DataFrame:
    return sittings(_by_section(spark, folder), ["section"])


def q_sitting_trend(spark: SparkSession, folder: str) -> DataFrame:
    """The last thirty sittings of each section with their accuracy."""
    last = Window.partitionBy("section").orderBy(F.desc("sitting"))
    return q_sittings(spark, folder).withColumn("back", F.row_number().over(last)).filter("back <= 30").select("section", "sitting", "n", pct(F.col("correct"), F.col("n")).alias("pct"), "first_at", "last_at")


def q_rolling_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Events in each of the seven days of 24 hours before the last event, oldest first."""
    e = graded(spark, folder)
    now = e.agg(F.max("at").alias("now"))
    back = F.floor((F.col("now") - F.col("at")) / DAY_MS)
    counts = e.crossJoin(F.broadcast(now)).withColumn("d", back).filter("d between 0 and 6").groupBy((6 - F.col("d")).alias("bucket")).agg(F.count("*").alias("n"))  # one row on the right
    return spark.range(7).select(F.col("id").alias("bucket")).join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def q_record_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Answers, last study time and attempted questions of each section."""
    q = questions(spark, folder).select(F.col("id").alias("question_id"), "section")
    answers = log(spark, folder).join(q, "question_id").groupBy("section").agg(F.count("*").alias("answers"), F.max("answered_at").alias("last_at"))
    attempted = _states(spark, folder).join(q, "question_id").groupBy("section").agg(F.count("*").alias("attempted"))
    return answers.join(attempted, "section", "full").select("section", F.coalesce("answers", F.lit(0)).alias("answers"), "last_at", F.coalesce("attempted", F.lit(0)).alias("attempted"))


def q_remarks_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Written answers marked again on one device within a day count by their last verdict only."""
    e = log(spark, folder).filter("typed is not null and question_id is not null and answered_at is not null")
    day = F.floor(F.col("answered_at") / DAY_MS).alias("day")
    return e.groupBy("question_id", "device", day).agg(F.max_by("result", F.struct("answered_at", "seq")).alias("result"), F.count("*").alias("marks"))


def q_progress_export(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as exported: without seq and what the store adds, result and times kept."""
    return log(spark, folder).select("question_id", "answered_at", "selected", "correct", "result", "mode", "elapsed_ms")


def q_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Time per mode: events, median and longest, of the events that have one."""
    e = log(spark, folder).filter("elapsed_ms >= 0")
    return e.groupBy("mode").agg(F.count("*").alias("n"), F.expr("percentile(elapsed_ms, 0.5)").alias("median_ms"), F.max("elapsed_ms").alias("longest_ms"))


def q_clock(spark: SparkSession, folder: str) -> DataFrame:
    """Elapsed times as minutes and seconds, never below zero."""
    seconds = F.greatest(F.lit(0), F.round(F.col("elapsed_ms") / 1000)).cast("long")
    return log(spark, folder).filter("elapsed_ms is not null").select("seq", F.concat(F.lpad(F.floor(seconds / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")).alias("clock"))


_EVENTS = "e AS (SELECT DISTINCT question_id, answered_at AS at_ms, seq, result FROM (SELECT DISTINCT * FROM answer_log) WHERE question_id IS NOT NULL AND answered_at IS NOT NULL AND result IS NOT NULL)"
_Q = "q AS (SELECT id, any_value(coalesce(section, 'am2')) AS section, any_value(sessionId) AS sessionId, any_value(tags) AS tags FROM questions WHERE id IS NOT NULL GROUP BY id)"
_STATE = f"""
WITH {_EVENTS},
g AS (SELECT *, sum(CASE WHEN result = 'false' THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY at_ms, seq) AS fell FROM e),
b AS (SELECT *, least(5, 1 + sum(CASE WHEN result = 'true' THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, fell ORDER BY at_ms, seq)) AS box FROM g),
p AS (SELECT *, coalesce(lag(box) OVER (PARTITION BY question_id ORDER BY at_ms, seq), 1) AS prev, row_number() OVER (PARTITION BY question_id ORDER BY at_ms DESC, seq DESC) AS rn FROM b),
d AS (SELECT *, CASE WHEN result = 'false' THEN 0 WHEN result = 'partial' THEN CASE prev WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 7 ELSE 16 END
  ELSE CASE prev WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 16 ELSE 35 END END AS days FROM p WHERE rn = 1),
c AS (SELECT question_id, count(*) AS attempts, count(*) FILTER (result = 'true') AS corrects, count(*) FILTER (result = 'partial') AS partials FROM e GROUP BY question_id),
state AS (SELECT d.question_id, attempts, corrects, partials, result AS last_result, CAST(box AS BIGINT) AS leitner_box,
  CAST(CASE WHEN days = 0 THEN at_ms ELSE floor(at_ms / 86400000.0) * 86400000 + CAST(days AS BIGINT) * 86400000 END AS BIGINT) AS due_at, at_ms AS last_answered_at FROM d JOIN c USING (question_id))
"""
_SITTINGS = f"""
WITH {_EVENTS}, {_Q},
s AS (SELECT q.section, e.* FROM e JOIN q ON q.id = e.question_id),
n AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY section ORDER BY at_ms, seq) <= 1200000 THEN 0 ELSE 1 END AS opens FROM s),
i AS (SELECT *, sum(opens) OVER (PARTITION BY section ORDER BY at_ms, seq) AS sitting FROM n),
t AS (SELECT section, CAST(sitting AS BIGINT) AS sitting, count(*) AS n, count(*) FILTER (result = 'true') AS correct, min(at_ms) AS first_at, max(at_ms) AS last_at FROM i GROUP BY ALL)
"""
_PCT = "CAST(CASE WHEN {b} = 0 THEN 0 ELSE round(100.0 * {a} / {b}) END AS BIGINT) AS pct"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "leitner_state": _STATE + "SELECT * FROM state",
    "leitner_box_counts": _STATE + "SELECT r.b AS leitner_box, count(question_id) AS n FROM (SELECT unnest(range(1, 6)) AS b) r LEFT JOIN state ON leitner_box = r.b GROUP BY r.b",
    "due_queue": _STATE + "SELECT question_id, leitner_box, due_at FROM state WHERE due_at <= (SELECT max(at_ms) FROM e)",
    "states_merged": _STATE
    + """, u AS (SELECT *, 0 AS own FROM state UNION ALL BY NAME SELECT question_id, attempts::BIGINT AS attempts, corrects::BIGINT AS corrects, partials::BIGINT AS partials, last_result, leitner_box::BIGINT AS leitner_box, due_at, last_answered_at, 1 AS own FROM states)
SELECT question_id, attempts, corrects, partials, last_result, leitner_box, due_at, last_answered_at FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(last_answered_at, -1) DESC, own DESC) AS rn FROM u) WHERE rn = 1""",
    "accuracy_overall": f"SELECT count(*) AS attempted, coalesce(sum(attempts), 0)::BIGINT AS attempts, coalesce(sum(corrects), 0)::BIGINT AS corrects, {_PCT.format(a='coalesce(sum(corrects), 0)', b='coalesce(sum(attempts), 0)')} FROM states WHERE attempts > 0",
    "accuracy_by_tag": f"WITH {_Q}, t AS (SELECT id, unnest(tags) AS tag FROM q) SELECT tag, sum(attempts)::BIGINT AS attempts, sum(corrects)::BIGINT AS corrects, {_PCT.format(a='sum(corrects)', b='sum(attempts)')} FROM states JOIN t ON t.id = question_id WHERE attempts > 0 GROUP BY tag",
    "accuracy_by_session": f"WITH {_Q} SELECT sessionId, count(*) AS attempted, sum(attempts)::BIGINT AS attempts, sum(corrects)::BIGINT AS corrects, {_PCT.format(a='sum(corrects)', b='sum(attempts)')} FROM states JOIN q ON q.id = question_id WHERE attempts > 0 GROUP BY sessionId",
    "sittings": _SITTINGS + "SELECT * FROM t",
    "sitting_trend": _SITTINGS + f"SELECT section, sitting, n, {_PCT.format(a='correct', b='n')}, first_at, last_at FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY sitting DESC) AS back FROM t) WHERE back <= 30",
    "rolling_histogram": f"WITH {_EVENTS}, m AS (SELECT max(at_ms) AS now FROM e), d AS (SELECT CAST(floor((now - at_ms) / 86400000.0) AS BIGINT) AS d FROM e, m) SELECT CAST(r.b AS BIGINT) AS bucket, count(d.d) AS n FROM (SELECT unnest(range(7)) AS b) r LEFT JOIN d ON 6 - d.d = r.b GROUP BY r.b",
    "record_counts": f"WITH {_Q}, a AS (SELECT section, count(*) AS answers, max(answered_at) AS last_at FROM (SELECT DISTINCT * FROM answer_log) l JOIN q ON q.id = l.question_id GROUP BY section), s AS (SELECT section, count(*) AS attempted FROM states JOIN q ON q.id = question_id WHERE attempts > 0 GROUP BY section) SELECT coalesce(a.section, s.section) AS section, coalesce(answers, 0) AS answers, last_at, coalesce(attempted, 0) AS attempted FROM a FULL JOIN s ON a.section = s.section",
    "remarks_collapsed": "SELECT question_id, device, CAST(floor(answered_at / 86400000.0) AS BIGINT) AS day, arg_max_null(result, (answered_at, seq)) AS result, count(*) AS marks FROM (SELECT DISTINCT * FROM answer_log) WHERE typed IS NOT NULL AND question_id IS NOT NULL AND answered_at IS NOT NULL GROUP BY 1, 2, 3",
    "progress_export": "SELECT question_id, answered_at, selected, correct, result, mode, elapsed_ms FROM (SELECT DISTINCT * FROM answer_log)",
    "elapsed": "SELECT mode, count(*) AS n, quantile_cont(elapsed_ms, 0.5) AS median_ms, max(elapsed_ms) AS longest_ms FROM (SELECT DISTINCT * FROM answer_log) WHERE elapsed_ms >= 0 GROUP BY mode",
    "clock": "WITH s AS (SELECT seq, greatest(0, CAST(round(elapsed_ms / 1000.0) AS BIGINT)) AS s FROM (SELECT DISTINCT * FROM answer_log) WHERE elapsed_ms IS NOT NULL) SELECT seq, lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM s",
}
