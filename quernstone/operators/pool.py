"""Question pools: filters of the query builder, merging of duplicates, sampling whole groups, and setup counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType
from pyspark.sql.window import Window

from quernstone.operators.study import questions
from quernstone.plans.ordered import place
from quernstone.session import table


@dataclass(frozen=True)
class Pool:
    """What to draw. Empty lists filter nothing."""

    section: str
    mode: str = "practice"  # practice | review | exam | session | case
    sessions: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    cases: tuple[str, ...] = ()
    unseen: bool = False
    wrong: bool = False
    reused: bool = False
    merge: bool = False
    now: int | None = None
    count: int = 0
    seed: int = 1
    order: tuple[str, ...] = field(default=("id",))


def group_size(q: DataFrame) -> DataFrame:
    """`q` with the number of questions of its duplicate group (one without a group)."""
    sizes = q.filter("duplicateGroupId is not null").groupBy("duplicateGroupId").agg(F.count("*").alias("size"))
    return q.join(sizes, "duplicateGroupId", "left").withColumn("size", F.coalesce("size", F.lit(1)))


def heads(q: DataFrame) -> DataFrame:
    """Group ids with the first question of the whole corpus that has each."""
    return q.filter("duplicateGroupId is not null").groupBy("duplicateGroupId").agg(F.min("id").alias("head"))


def draw_order(id_col: Column, seed: int) -> Column:
    """A reproducible random order that any engine can repeat."""
    return F.md5(F.concat(id_col, F.lit(f"#{seed}")))


def build(spark: SparkSession, folder: str, pool: Pool) -> DataFrame:
    """Ids of the pool, in the builder's order of steps: section, mode, sessions, tags, cases, state, merge, draw."""
    corpus = questions(spark, folder)
    q = corpus.filter(F.col("section") == pool.section)
    if pool.mode == "case":
        return q.filter(F.col("caseId").isin(list(pool.cases))).select("id", "caseId", "qno")
    if pool.mode == "session":
        return q.filter(F.col("sessionId").isin(list(pool.sessions))).select("id", "caseId", "qno")
    if pool.sessions:
        q = q.filter(F.col("sessionId").isin(list(pool.sessions)))
    if pool.tags:
        q = q.filter(F.arrays_overlap("tags", F.array(*map(F.lit, pool.tags))))
    if pool.cases:
        q = q.filter(F.col("caseId").isin(list(pool.cases)))
    states = table(spark, folder, "states").select(F.col("question_id").alias("id"), "attempts", "last_result", "due_at")
    q = q.join(states, "id", "left")
    if pool.mode == "review":
        q = q.filter((F.col("attempts") > 0) & (F.coalesce("due_at", F.lit(0)) <= F.lit(pool.now or 0)))
    else:
        if pool.unseen:
            q = q.filter(F.coalesce("attempts", F.lit(0)) == 0)
        if pool.wrong:
            q = q.filter("last_result = 'false'")
        if pool.reused:
            sizes = group_size(corpus).select("id", "size")
            q = q.join(sizes, "id").filter("size > 1").drop("size")
    if pool.merge and pool.mode != "exam":
        # one of each group: the corpus's first, even where a filter left it out
        q = q.join(heads(corpus), "duplicateGroupId", "left").select(F.coalesce("head", "id").alias("id")).distinct().join(corpus.select("id", "caseId", "qno"), "id")
    out = q.select("id", "caseId", "qno")
    if pool.count:
        out = out.orderBy(draw_order(F.col("id"), pool.seed), "id").limit(pool.count)
    return out


def whole_groups(q: DataFrame, group: str, seed: int, wanted: int) -> DataFrame:
    """The rows of `wanted` groups drawn at random, with place (of the group) and their number in it."""
    drawn = q.filter(F.col(group).isNotNull()).select(group).distinct().orderBy(draw_order(F.col(group), seed), group).limit(wanted)
    placed = drawn.withColumn("place", F.row_number().over(Window.orderBy(draw_order(F.col(group), seed), group)))  # no more than `wanted` rows
    return q.join(F.broadcast(placed), group)


@F.pandas_udf(ArrayType(IntegerType()))
def lcg_shuffle(size, seed):  # noqa: ANN001, ANN202
    """A seeded permutation of 0..size-1: swaps from the end by a linear congruential generator modulo 2**32; seed 0 is 1."""
    import pandas as pd

    out = []
    for n, s in zip(size, seed):
        order, state = list(range(int(n))), (int(s) % 2**32) or 1
        for i in range(len(order) - 1, 0, -1):
            state = (state * 1664525 + 1013904223) % 2**32
            j = state * (i + 1) // 2**32
            order[i], order[j] = order[j], order[i]
        out.append(order)
    return pd.Series(out)


@F.pandas_udf(LongType())
def fnv1a(text):  # noqa: ANN001, ANN202
    """FNV-1a, 32 bits, over UTF-16 units."""
    import pandas as pd

    def one(s: str | None) -> int | None:
        if s is None:
            return None
        h, raw = 2166136261, s.encode("utf-16-le")
        for k in range(0, len(raw), 2):
            h = ((h ^ (raw[k] | raw[k + 1] << 8)) * 16777619) % 2**32
        return h

    return pd.Series([one(s) for s in text], dtype="Int64")


_NOW = 1_717_200_000_000


def q_pool_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return build(spark, folder, Pool("am2", sessions=("Q05haru", "Q14haru", "Q10haru"), tags=("暗号技術", "認証方式"))).select("id")


def q_pool_unseen(spark: SparkSession, folder: str) -> DataFrame:
    return build(spark, folder, Pool("am1", unseen=True)).select("id")


def q_pool_wrong(spark: SparkSession, folder: str) -> DataFrame:
    return build(spark, folder, Pool("am2", wrong=True)).select("id")


def q_pool_reused(spark: SparkSession, folder: str) -> DataFrame:
    return build(spark, folder, Pool("am2", reused=True)).select("id")


def q_pool_review(spark: SparkSession, folder: str) -> DataFrame:
    return build(spark, folder, Pool("am1", mode="review", now=_NOW)).select("id")


def q_pool_merged(spark: SparkSession, folder: str) -> DataFrame:
    return build(spark, folder, Pool("am2", tags=("運用管理",), merge=True)).select("id")


def q_pool_case_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Written questions of the two first cases, in the booklet's order."""
    first = [r[0] for r in table(spark, folder, "cases").select("id").orderBy("id").limit(2).collect()]  # the two cases asked for
    return build(spark, folder, Pool("pm", mode="case", cases=tuple(first))).withColumn("place", F.row_number().over(Window.partitionBy("caseId").orderBy("qno", "id")).cast("long"))


def q_exam_draw(spark: SparkSession, folder: str) -> DataFrame:
    """An exam's draw: 25 questions from all sessions of the section."""
    return build(spark, folder, Pool("am2", mode="exam", count=25, seed=7)).select("id")


def q_sample_whole_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Three cases drawn at random with all their questions."""
    return whole_groups(build(spark, folder, Pool("pm")), "caseId", 3, 3).select(F.col("place").cast("long").alias("place"), "caseId", "qno", "id")


def q_availability(spark: SparkSession, folder: str) -> DataFrame:
    """Size of each section's pool and of what a draw of 25 would give; written sections count cases too."""
    q = questions(spark, folder)
    return q.groupBy("section").agg(F.count("*").alias("pool"), F.least(F.lit(25), F.count("*")).alias("drawn"), F.count_distinct("caseId").alias("cases"))


def q_distinct_tags(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("section", F.explode("tags").alias("tag")).distinct()


def q_sessions_in_section(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that have questions of a section."""
    q = questions(spark, folder).select("section", F.col("sessionId").alias("id")).distinct()
    return table(spark, folder, "sessions").join(q, "id").select("section", "id", "label", "exam_year")


def q_case_setup(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with their number of questions, by session."""
    q = questions(spark, folder).filter("caseId is not null").groupBy(F.trim("caseId").alias("id")).agg(F.count("*").alias("items"))
    return table(spark, folder, "cases").join(q, "id", "left").select("sessionId", "paper", "id", F.coalesce("items", F.lit(0)).alias("items"))


def q_exam_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers present in the last session (by year, spring before autumn) that has cases."""
    s = table(spark, folder, "sessions").withColumn("rank", F.col("exam_year") * 2 + F.when(F.col("term") == "aki", 1).otherwise(0))
    c = table(spark, folder, "cases").join(F.broadcast(s.select(F.col("id").alias("sessionId"), "rank")), "sessionId")
    last = c.agg(F.max("rank").alias("rank"))
    return c.join(F.broadcast(last), "rank").groupBy("sessionId", "paper").agg(F.count("*").alias("cases"))


def q_choice_order(spark: SparkSession, folder: str) -> DataFrame:
    """The options of each choice question in the order its id gives."""
    q = questions(spark, folder).filter("size(choices) > 1")
    order = lcg_shuffle(F.size("choices"), fnv1a(F.col("id")))
    return q.withColumn("order", order).select("id", F.transform("order", lambda i: F.get(F.col("choices.key"), i)).alias("shown"))


def q_case_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Written questions of a session in order, marked where the case changes."""
    q = questions(spark, folder).filter("section = 'pm'").select("sessionId", "id", "qno", "caseId")
    placed = place(q, ["sessionId"], ["qno", "id"])
    before = placed.select("sessionId", (F.col("place") + 1).alias("place"), F.col("caseId").alias("before"))
    return placed.join(before, ["sessionId", "place"], "left").select("sessionId", "id", (~F.col("before").eqNullSafe(F.col("caseId"))).alias("changes"), "place")


_Q = "q AS (SELECT id, any_value(coalesce(section, 'am2')) AS section, any_value(sessionId) AS sessionId, any_value(tags) AS tags, any_value(caseId) AS caseId, any_value(qno) AS qno, any_value(duplicateGroupId) AS g FROM questions WHERE id IS NOT NULL GROUP BY id)"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "pool_filtered": f"WITH {_Q} SELECT id FROM q WHERE section = 'am2' AND sessionId IN ('Q05haru', 'Q14haru', 'Q10haru') AND list_has_any(tags, ['暗号技術', '認証方式'])",
    "pool_unseen": f"WITH {_Q} SELECT id FROM q LEFT JOIN states s ON s.question_id = q.id WHERE section = 'am1' AND coalesce(attempts, 0) = 0",
    "pool_wrong": f"WITH {_Q} SELECT id FROM q JOIN states s ON s.question_id = q.id WHERE section = 'am2' AND last_result = 'false'",
    "pool_reused": f"WITH {_Q} SELECT id FROM q WHERE section = 'am2' AND g IN (SELECT g FROM q WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1)",
    "pool_review": f"WITH {_Q} SELECT id FROM q JOIN states s ON s.question_id = q.id WHERE section = 'am1' AND attempts > 0 AND coalesce(due_at, 0) <= {_NOW}",
    "pool_merged": f"WITH {_Q}, h AS (SELECT g, min(id) AS head FROM q WHERE g IS NOT NULL GROUP BY g) SELECT DISTINCT coalesce(head, id) AS id FROM q LEFT JOIN h ON h.g = q.g WHERE section = 'am2' AND list_contains(tags, '運用管理')",
    "pool_case_mode": f"WITH {_Q} SELECT id, caseId, qno, row_number() OVER (PARTITION BY caseId ORDER BY qno, id) AS place FROM q WHERE section = 'pm' AND caseId IN (SELECT id FROM cases ORDER BY id LIMIT 2)",
    "exam_draw": f"WITH {_Q} SELECT id FROM q WHERE section = 'am2' ORDER BY md5(id || '#7'), id LIMIT 25",
    "sample_whole_cases": f"WITH {_Q}, d AS (SELECT caseId, row_number() OVER (ORDER BY md5(caseId || '#3'), caseId) AS place FROM (SELECT DISTINCT caseId FROM q WHERE section = 'pm' AND caseId IS NOT NULL)) SELECT place, caseId, qno, id FROM q JOIN d USING (caseId) WHERE section = 'pm' AND place <= 3",
    "availability": f"WITH {_Q} SELECT section, count(*) AS pool, least(25, count(*)) AS drawn, count(DISTINCT caseId) AS cases FROM q GROUP BY section",
    "distinct_tags": f"WITH {_Q} SELECT DISTINCT section, unnest(tags) AS tag FROM q",
    "sessions_in_section": f"WITH {_Q} SELECT DISTINCT section, s.id, label, exam_year FROM q JOIN sessions s ON s.id = q.sessionId",
    "case_setup": f"WITH {_Q}, n AS (SELECT trim(caseId) AS id, count(*) AS items FROM q WHERE caseId IS NOT NULL GROUP BY 1) SELECT sessionId, paper, c.id, coalesce(items, 0) AS items FROM cases c LEFT JOIN n ON n.id = c.id",
    "exam_papers": "WITH s AS (SELECT id, exam_year * 2 + (term = 'aki')::INT AS r FROM sessions), c AS (SELECT sessionId, paper, r FROM cases JOIN s ON s.id = sessionId) SELECT sessionId, paper, count(*) AS cases FROM c WHERE r = (SELECT max(r) FROM c) GROUP BY ALL",
    "case_changes": f"WITH {_Q} SELECT sessionId, id, lag(caseId) OVER w IS DISTINCT FROM caseId AS changes, row_number() OVER w AS place FROM q WHERE section = 'pm' WINDOW w AS (PARTITION BY sessionId ORDER BY qno, id)",
}
