"""Streams of answers: learning state kept per question, sittings, windows with late rows, and repeated rows dropped.

Queries read a table's files as a stream, run until all is read, and return what the sink holds. Sinks and checkpoints are in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.operators import study as batch
from quernstone.operators.study import DAY_MS, DAYS, LAST_DAYS
from quernstone.session import shared_dir, table

STATE = "attempts long, corrects long, partials long, last_result string, leitner_box long, due_at long, last_answered_at long"


def advance(state: tuple | None, at: int, result: str) -> tuple:
    """A question's state after one more answer."""
    attempts, corrects, partials, _, box, _, _ = state or (0, 0, 0, None, 1, 0, 0)
    days = 0
    if result == "true":
        days = LAST_DAYS if box >= 5 else DAYS[box + 1]
        box = min(5, box + 1)
    elif result == "partial":
        days = DAYS[box]
    else:
        box = 1
    due = at if days == 0 else (at // DAY_MS + days) * DAY_MS
    return attempts + 1, corrects + (result == "true"), partials + (result == "partial"), result, box, due, at


HELD = f"{STATE}, answers array<struct<at:long,seq:long,result:string>>"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = [tuple(a) for a in state.get[-1]] if state.exists else []
    rows = pd.concat(list(batches))
    new = sorted((int(at), int(seq), result) for at, seq, result in zip(rows["answered_at"], rows["seq"], rows["result"]))
    if held and new[0] < held[-1]:  # an answer older than one folded already: all are folded again in order
        now, todo = None, sorted(held + new)
    else:
        now, todo = state.get[:-1] if state.exists else None, new
    for at, _, result in todo:
        now = advance(now, at, result)
    state.update((*now, sorted(held + new)))
    yield pd.DataFrame([(key[0], *now)], columns=["question_id", *(c.split()[0] for c in STATE.split(", "))])


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answer log as a stream."""
    held = table(spark, folder, "answer_log")
    path = f"{folder}/answer_log.parquet"
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 64).parquet(path if not path.endswith(".parquet") or _is_folder(spark, path) else f"{folder}/answer_log*.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """What a stream gives once all that is there has been read."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{base}/out").awaitTermination()
    else:
        # the last batch of an updating or complete stream replaces what it has of the same keys
        def keep(df: DataFrame, epoch: int) -> None:
            df.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")

        writer.foreachBatch(keep).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    if mode == "complete":  # each batch wrote the whole result; the last one counts
        last = out.agg(F.max("_epoch").alias("_epoch"))
        out = out.join(F.broadcast(last), "_epoch").drop("_epoch")
    return out


def leitner_stream(spark: SparkSession, folder: str) -> DataFrame:
    """State of each question, folded in order of time in whatever order answers arrive; of each question the state of its last batch."""
    events = answers(spark, folder).filter("question_id is not null and answered_at is not null and result is not null").select("question_id", "answered_at", "seq", "result")
    distinct = events.dropDuplicates(["seq"])
    states = distinct.groupBy("question_id").applyInPandasWithState(_fold, f"question_id string, {STATE}", HELD, "update", GroupStateTimeout.NoTimeout)
    out = drained(states, "leitner", "update")
    rest = [c for c in out.columns if c not in ("question_id", "_epoch")]
    return out.groupBy("question_id").agg(F.max_by(F.struct(*rest), "_epoch").alias("s")).select("question_id", "s.*")


def sittings_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Sittings of each device: session windows of twenty minutes over event time."""
    e = answers(spark, folder).filter("answered_at >= 0 and device is not null").select("device", "result", "seq", F.timestamp_millis("answered_at").alias("ts"))
    s = e.dropDuplicates(["seq"]).groupBy("device", F.session_window("ts", "20 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("result") == "true").alias("correct"))
    return drained(s.select("device", F.col("w.start").alias("opened"), "n", "correct"), "sittings", "complete")


def daily_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Answers per day and mode, rows that come late included."""
    e = answers(spark, folder).filter("answered_at >= 0").select("mode", "seq", F.timestamp_millis("answered_at").alias("ts"))
    s = e.dropDuplicates(["seq"]).groupBy(F.window("ts", "1 day").alias("w"), "mode").agg(F.count("*").alias("n"))
    return drained(s.select(F.unix_millis("w.start").alias("day_ms"), "mode", "n"), "daily", "complete")


QUERIES = {"leitner_stream": leitner_stream, "sittings_stream": sittings_stream, "daily_stream": daily_stream}
ORACLE = {
    "daily_stream": "SELECT CAST(floor(answered_at / 86400000.0) AS BIGINT) * 86400000 AS day_ms, mode, count(*) AS n FROM (SELECT DISTINCT * FROM answer_log) WHERE answered_at >= 0 GROUP BY ALL",
    "leitner_stream": batch.ORACLE["leitner_state"],
    "sittings_stream": "WITH e AS (SELECT device, result, seq, answered_at AS ms FROM (SELECT DISTINCT * FROM answer_log) WHERE answered_at >= 0 AND device IS NOT NULL), o AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY device ORDER BY ms, seq) < 1200000 THEN 0 ELSE 1 END AS opens FROM e), s AS (SELECT *, sum(opens) OVER (PARTITION BY device ORDER BY ms, seq) AS k FROM o)"
    " SELECT device, make_timestamp(min(ms) * 1000) AS opened, count(*) AS n, count(*) FILTER (result = 'true') AS correct FROM s GROUP BY device, k",
}
