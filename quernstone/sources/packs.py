"""Packs of questions: import checks, replacement by section, registry, orphan assets, offsets and progress files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.study import log, questions, section
from quernstone.plans.ordered import prefix_sum
from quernstone.session import table

#: What a progress file calls itself.
PROGRESS = "sc-am2-progress"
PROGRESS_SCHEMA = "kind string, version int, exportedAt string, answers array<struct<questionId:string,answeredAt:bigint,selected:string,correct:boolean,result:string,mode:string,elapsedMs:bigint>>, states array<struct<questionId:string,attempts:int,corrects:int,partials:int,lastResult:string,leitnerBox:int,dueAt:bigint,lastAnsweredAt:bigint>>"
PACK_SCHEMA = "meta map<string,string>, sessions array<struct<id:string,label:string>>, questions array<struct<id:string,sessionId:string,section:string,no:int,text:string,answer:string>>"


def read_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, sessions) of JSON packs; a pack without questions or sessions is an error when read."""
    raw = spark.read.schema(PACK_SCHEMA).json(path, multiLine=True)
    whole = raw.withColumn("questions", F.when(F.size("questions") > 0, F.col("questions")).otherwise(F.raise_error(F.lit("a pack has no questions")))).withColumn("sessions", F.when(F.size("sessions") > 0, F.col("sessions")).otherwise(F.raise_error(F.lit("a pack has no sessions"))))
    q = whole.select(F.explode("questions").alias("q")).select("q.*").withColumn("section", section(F.col("section")))
    return q, whole.select(F.explode("sessions").alias("s")).select("s.*").distinct()


def read_progress(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(answers, states) of progress files; a file of another kind is an error when read."""
    raw = spark.read.schema(PROGRESS_SCHEMA).json(path, multiLine=True)
    checked = raw.withColumn("answers", F.when(F.col("kind") == PROGRESS, F.col("answers")).otherwise(F.raise_error(F.lit("no progress file"))))
    return checked.select(F.explode("answers").alias("a")).select("a.*"), checked.filter(F.col("kind") == PROGRESS).select(F.explode("states").alias("s")).select("s.*")


def replace_by_section(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of `held` but for the sections that `incoming` brings, and all of `incoming`."""
    brought = incoming.select(section(F.col("section")).alias("_s")).distinct()
    kept = held.join(brought, section(F.col("section")) == F.col("_s"), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def upsert(held: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """`held` with the rows of `incoming` in place of those with the same keys."""
    return held.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def write_sessions(df: DataFrame, path: str) -> None:
    """Replace only the sessions of `df` in a table partitioned by section and session."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section", "sessionId").parquet(path)


def retire(registry: DataFrame, pack_id: str, sections: list[str]) -> DataFrame:
    """The registry (pack_id, sections) with a new pack, without older ones that share a section with it."""
    new = registry.sparkSession.createDataFrame([(pack_id, sections)], "pack_id string, sections array<string>")
    return registry.filter(~F.arrays_overlap("sections", F.array(*map(F.lit, sections)))).unionByName(new)


def offsets(entries: DataFrame, group: str, path: str, size: str) -> DataFrame:
    """`entries` with the sum of the sizes before each in its group, by path."""
    return prefix_sum(entries, [group], [path], size, "offset")


def figures(spark: SparkSession, folder: str) -> DataFrame:
    """Figures (path, section, id) that questions name."""
    return questions(spark, folder).select("section", "id", F.explode("figures").alias("path"))


def q_pack_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets of each section's figures, were each as long as its path."""
    f = figures(spark, folder).select("section", "path").distinct().withColumn("size", F.length("path"))
    return offsets(f, "section", "path", "size")


def q_pack_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """What a pack of each section would hold."""
    q = questions(spark, folder)
    counts = q.groupBy("section").agg(F.count("*").alias("questions"), F.count_distinct("sessionId").alias("sessions"))
    figs = figures(spark, folder).groupBy("section").agg(F.count_distinct("path").alias("figures"))
    return counts.join(figs, "section", "left").select("section", "questions", "sessions", F.coalesce("figures", F.lit(0)).alias("figures"))


def q_replace_by_section(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus after a pack of one section with the first session's questions only."""
    q = questions(spark, folder).select("id", "section", "sessionId")
    return replace_by_section(q, q.filter("section = 'am1' and sessionId = 'Q05haru'"))


def q_orphan_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Figures that only questions of the section replaced name."""
    f = figures(spark, folder)
    gone, kept = f.filter("section = 'am1'").select("path").distinct(), f.filter("section <> 'am1'").select("path").distinct()
    return gone.join(kept, "path", "left_anti")


def q_sessions_upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with a new label for those of spring."""
    s = table(spark, folder, "sessions").select("id", "label")
    return upsert(s, table(spark, folder, "sessions").filter("term = 'haru'").select("id", F.concat(F.col("label"), F.lit("*")).alias("label")), ["id"])


def q_sections_union(spark: SparkSession, folder: str) -> DataFrame:
    """Sections present, in the fixed order."""
    order = F.array_position(F.array(F.lit("am1"), F.lit("am2"), F.lit("pm")), F.col("section"))
    return questions(spark, folder).select("section").distinct().select("section", order.alias("place"))


def q_merged_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The log with its export merged in: answers are appended, here counted per mode."""
    e = log(spark, folder).select("question_id", "answered_at", "result", "mode")
    return e.unionAll(e).groupBy("mode").agg(F.count("*").alias("n"))


def q_corpus_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object per choice question, as the corpus document holds it."""
    q = questions(spark, folder).filter("choices is not null")
    return q.select("id", F.to_json(F.struct("id", "sessionId", "section", F.col("qno").alias("no"), "text", "choices", "answer")).alias("json"))


def q_point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A state by its key (the smallest)."""
    s = table(spark, folder, "states")
    first = s.agg(F.min("question_id").alias("question_id"))
    return s.join(F.broadcast(first), "question_id").select("question_id", "attempts", "leitner_box")


_Q = "q AS (SELECT id, any_value(coalesce(section, 'am2')) AS section, any_value(sessionId) AS sessionId, any_value(figures) AS figures FROM questions WHERE id IS NOT NULL GROUP BY id), f AS (SELECT section, id, unnest(figures) AS path FROM q)"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "pack_offsets": f"WITH {_Q}, d AS (SELECT DISTINCT section, path, CAST(length(path) AS INT) AS size FROM f) SELECT section, path, size, CAST(coalesce(sum(size) OVER (PARTITION BY section ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d",
    "pack_descriptors": f"WITH {_Q}, c AS (SELECT section, count(*) AS questions, count(DISTINCT sessionId) AS sessions FROM q GROUP BY section), g AS (SELECT section, count(DISTINCT path) AS figures FROM f GROUP BY section) SELECT c.section, questions, sessions, coalesce(figures, 0) AS figures FROM c LEFT JOIN g ON c.section = g.section",
    "replace_by_section": f"WITH {_Q} SELECT id, section, sessionId FROM q WHERE section <> 'am1' OR sessionId = 'Q05haru' OR NOT EXISTS (SELECT 1 FROM q WHERE section = 'am1' AND sessionId = 'Q05haru')",
    "orphan_assets": f"WITH {_Q} SELECT DISTINCT path FROM f WHERE section = 'am1' AND path NOT IN (SELECT path FROM f WHERE section <> 'am1')",
    "sessions_upserted": "SELECT id, CASE WHEN term = 'haru' THEN label || '*' ELSE label END AS label FROM sessions",
    "sections_union": f"WITH {_Q} SELECT DISTINCT section, CAST(list_position(['am1', 'am2', 'pm'], section) AS BIGINT) AS place FROM q",
    "merged_answers": "SELECT mode, 2 * count(*) AS n FROM (SELECT DISTINCT * FROM answer_log) GROUP BY mode",
    "point_lookup": "SELECT question_id, attempts, leitner_box FROM states WHERE question_id = (SELECT min(question_id) FROM states)",
}
