"""Frequency of every distinct term (problem 3) by recursive radix spilling and DuckDB.

Terms are cut from the records in the JVM; Arrow batches are pre-aggregated where they are read, so a term that fills a third of the
corpus sends one row per batch. The partial counts are spilled to the shared folder, partitioned by the leading bits of their 64-bit hashes.
A partition that holds more rows than one task should is rewritten, and only it, by the next bits, recursively; equal terms
that are counted in several batches are added up on the way. Each leaf is aggregated by a DuckDB that reads its files, whose memory is limited and which
spills into the shared folder.

Defined results: null and empty fields hold no terms; rows that repeat an id are one record (the smallest by text and
explanation); with no records there is no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import discard, materialize, plain_path, shared_dir, table

#: ASCII words, katakana words and kanji words of two or more characters.
TERM = r"[A-Za-z][A-Za-z0-9]+|[ァ-ヺー]{2,}|[一-鿿]{2,}"
#: Leading bits taken at each level, and the partial rows that one leaf may hold.
LEVEL_BITS, LEAF_ROWS = 4, 2_000_000


def question_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per question id: (id, parts), the stored text and explanation."""
    q = table(spark, folder, "questions").filter("id is not null").select("id", "text", "explanation")
    return q.groupBy("id").agg(F.min(F.struct("text", "explanation")).alias("r")).select("id", F.array("r.text", "r.explanation").alias("parts"))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, occurrences, records) of some thousands of records at a time."""
    held: list[pa.Table] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")]).rename_columns(["term", "occurrences", "records"])
        yield from t.to_batches()

    for b in batches:
        lists = b["terms"]
        flat = pa.table({"row": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
        per = flat.group_by(["row", "term"]).aggregate([([], "count_all")])
        one = per.group_by("term").aggregate([("count_all", "sum"), ([], "count_all")]).rename_columns(["term", "occurrences", "records"])
        held.append(one)
        size += one.num_rows
        if size > 400_000:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _parts(spark: SparkSession, path: str) -> dict[int, str]:
    """Partitions of a spilled level: bits to folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    return {int(n[5:]): f"{path}/{n}" for n in names if n.startswith("part=")}


SPILLED = "term string, occurrences long, records long, h long"


def spill(partial: DataFrame, level_bits: int, leaf_rows: int, bits: int = 0) -> list[str]:
    """Folders of leaves (term, occurrences, records, h) that together hold `partial`, each of few rows or of one term."""
    spark = partial.sparkSession
    part = F.shiftrightunsigned(F.shiftleft("h", bits), 64 - level_bits).alias("part")
    _, path = materialize(partial.select("*", part), "p3-spill", by="part")
    leaves = []
    for folder in _parts(spark, path).values():
        held = spark.read.schema(SPILLED).parquet(folder)
        if held.count() <= leaf_rows or bits + level_bits > 60:  # counted by the files' footers
            leaves.append(folder)
            continue
        # the oversized partition alone is read again; a term with many partial counts shrinks to one row
        leaves += spill(held.groupBy("term", "h").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).select("term", "occurrences", "records", "h"), level_bits, leaf_rows, bits + level_bits)
        discard(spark, folder)
    return leaves


def _aggregate(leaves: list[str], spill_to: str, memory: str):  # noqa: ANN202
    """Counts of the leaves whose numbers come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        import duckdb

        for b in batches:
            for leaf in b["id"].to_pylist():
                where = f"{spill_to}/duckdb-{uuid.uuid4().hex}"
                con = duckdb.connect()
                con.execute("SET threads = 1")
                con.execute("SET preserve_insertion_order = false")
                con.execute(f"SET memory_limit = '{memory}'")
                con.execute(f"SET temp_directory = '{where}'")
                reader = con.sql("SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM read_parquet($leaf) GROUP BY term", params={"leaf": f"{leaves[leaf]}/*.parquet"}).to_arrow_reader(50_000)
                for got in reader:
                    yield got.cast(pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]))
                con.close()
                if os.path.isdir(where):
                    os.rmdir(where)

    return run


def frequencies(records: DataFrame, *, parts: str = "parts", level_bits: int = LEVEL_BITS, leaf_rows: int = LEAF_ROWS, memory: str = "256MB") -> DataFrame:
    """(term, occurrences, records) over `records`, each of which holds an array of texts in `parts`.

    Where the shared folder is no file system that tasks can open, DuckDB cannot read the leaves, and Spark adds them up.
    """
    spark = records.sparkSession
    found = F.flatten(F.transform(F.array_compact(parts), lambda x: F.regexp_extract_all(x, F.lit(TERM), F.lit(0))))
    cut = records.select(F.transform(found, lambda t: F.lower(t)).alias("terms")).filter("size(terms) > 0")
    partial = cut.mapInArrow(_partial, "term string, occurrences long, records long").withColumn("h", F.xxhash64("term"))
    leaves = spill(partial, level_bits, leaf_rows)
    shared = [plain_path(x) for x in leaves]
    if any(x is None for x in shared):
        return spark.read.schema(SPILLED).parquet(*leaves).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    numbers = spark.range(0, len(leaves), 1, max(1, len(leaves)))  # a task for each leaf
    return numbers.mapInArrow(_aggregate(shared, plain_path(shared_dir(spark)), memory), "term string, occurrences long, records long")


def marks(spark: SparkSession, folder: str, *, rare: int = 2, common: float = 0.1) -> DataFrame:
    """(term, occurrences, records, mark): rare in at most `rare` records, common in more than that share of them, else null."""
    records, _ = materialize(question_records(spark, folder), "p3-records")
    total = records.count()
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > total * common, "common")
    return frequencies(records).withColumn("mark", mark)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return marks(spark, folder).filter("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences and records."""
    return marks(spark, folder)


_SQL = r"""
WITH r AS (SELECT id, min(struct_pack(t := text, e := explanation)) AS r FROM questions WHERE id IS NOT NULL GROUP BY id),
w AS (SELECT id, lower(unnest(regexp_extract_all(coalesce(r.t, '') || chr(10) || coalesce(r.e, ''), '[A-Za-z][A-Za-z0-9]+|[\x{30A1}-\x{30FA}\x{30FC}]{2,}|[\x{4E00}-\x{9FFF}]{2,}'))) AS term FROM r),
f AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM w GROUP BY term),
m AS (SELECT term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > (SELECT count(*) FROM r) * 0.1 THEN 'common' END AS mark FROM f)
"""
QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms}
ORACLE = {"p3_found": _SQL + "SELECT term, mark FROM m WHERE mark IS NOT NULL", "p3_terms": _SQL + "SELECT term, occurrences, records, mark FROM m"}
