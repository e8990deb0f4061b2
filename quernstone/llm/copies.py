"""Duplicates hidden by formatting differences (problem 6) by commutative multiset hashing.

A record becomes a multiset of (field, normalized value) pairs. Each pair is hashed and the hashes are added, so the
order of fields and of repeated values does not matter and nothing is sorted. Rows are grouped by the fingerprint; each row is
then held against the group's representative field by field, and rows of colliding fingerprints are regrouped by the values themselves.

Defined results: normalization keeps letters and digits (Unicode L and N) in lower case; a null text is no content, so
such a record has no copies, while empty texts equal each other; a null section is `am2`; records without four choices are not
compared; rows that repeat an id count once, by their smallest content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import materialize, table


def bare(value: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))


def fingerprint(pairs: Column, lane: int) -> Column:
    """Sum, in 64 bits, of the hashes of an array of (field, value) structs; two lanes make 128 bits."""
    # Halves are added apart, so that the sums cannot overflow whatever the number of pairs.
    def half(shift: int) -> Column:
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: acc + F.shiftrightunsigned(F.xxhash64(F.lit(lane), p["field"], p["value"]), shift).bitwiseAND(0xFFFFFFFF))

    return F.xxhash64(half(0), half(32))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often, without sorting."""
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: F.size(F.filter(a, lambda y: y.eqNullSafe(x))) == F.size(F.filter(b, lambda y: y.eqNullSafe(x))))


def copies(records: DataFrame, key: str, single: list[str], bag: str) -> DataFrame:
    """(keep_id, key) of the `records` that have copies: `single` are fields compared one by one, `bag` is an array compared as a multiset.

    Fingerprints alone are grouped, which aggregates before it shuffles, so a group of any share of the rows is no burden; only rows of groups of
    two and more are kept with their fields, and held against the row that represents the group.
    """
    pairs = F.concat(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in single]), F.transform(bag, lambda v: F.struct(F.lit(bag).alias("field"), v.alias("value"))))
    marked = records.select(key, *single, bag).withColumn("pairs", pairs).withColumn("f1", fingerprint(F.col("pairs"), 1)).withColumn("f2", fingerprint(F.col("pairs"), 2)).drop("pairs")
    heads = marked.groupBy("f1", "f2").agg(F.min(key).alias("keep_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    met, _ = materialize(marked.join(heads, ["f1", "f2"]), "p6-copies")
    head = met.filter(F.col(key) == F.col("keep_id")).select("f1", "f2", F.struct(*single, bag).alias("head"))
    held = met.join(head, ["f1", "f2"])
    equal = same_multiset(F.col(bag), F.col(f"head.{bag}"))
    for c in single:
        equal = equal & F.col(c).eqNullSafe(F.col(f"head.{c}"))
    agreed = held.filter(equal).select("keep_id", key)
    # colliding fingerprints: what is not equal to the head is grouped by its values
    rest = held.filter(~equal).withColumn("ordered", F.array_sort(bag))
    rest_heads = rest.groupBy("f1", "f2", *single, "ordered").agg(F.min(key).alias("own"))
    again = rest.drop("keep_id").join(rest_heads.withColumnsRenamed({c: f"_{c}" for c in [*single, "ordered", "f1", "f2"]}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*single, "ordered", "f1", "f2"]])
    return agreed.unionAll(again.select(F.col("own").alias("keep_id"), key))


def choice_records(spark: SparkSession, folder: str) -> DataFrame:
    """Choice questions, one row per id: (id, section, text, options) with bare text and choice texts."""
    q = table(spark, folder, "questions").filter("id is not null and text is not null and size(choices) = 4")
    return (
        q.select("id", F.coalesce("section", F.lit("am2")).alias("section"), bare(F.col("text")).alias("text"), F.transform("choices", lambda c: bare(F.coalesce(c["text"], F.lit("")))).alias("options"))
        .groupBy("id")
        .agg(F.min(F.struct("section", "text", "options")).alias("r"))
        .select("id", "r.section", "r.text", "r.options")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of choice questions: one row for each id other than the smallest of its copies."""
    return copies(choice_records(spark, folder), "id", ["section", "text"], "options").filter("keep_id <> id").select("keep_id", "id")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records that have copies, with their number (the record itself included)."""
    return p6_found(spark, folder).groupBy("keep_id").agg((F.count("*") + 1).alias("copies"))


_SQL = r"""
WITH c AS (
  SELECT id, min(struct_pack(s := coalesce(section, 'am2'), t := lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')),
    o := list_sort(list_transform(choices, lambda x: lower(regexp_replace(coalesce(x.text, ''), '[^\p{L}\p{N}]+', '', 'g')))))) AS r
  FROM questions WHERE id IS NOT NULL AND text IS NOT NULL AND len(choices) = 4 GROUP BY id
), g AS (SELECT id, min(id) OVER (PARTITION BY r.s, r.t, r.o) AS keep_id FROM c)
"""
QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}
ORACLE = {
    "p6_found": _SQL + "SELECT keep_id, id FROM g WHERE keep_id <> id",
    "p6_counts": _SQL + "SELECT keep_id, count(*) + 1 AS copies FROM g WHERE keep_id <> id GROUP BY keep_id",
}
