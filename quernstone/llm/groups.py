"""Consolidating pairwise matches into groups (problem 2) by hash-to-min.

Cluster sets are kept as rows (vertex, member), never as arrays, so a hub's set is spread over partitions like any other
rows. In each round a vertex's set goes to its smallest member and that member to all others of the set; the rounds
end when the sets no longer change, after about log2 of the longest chain.

Defined results: null ids and pairs of an id with itself link nothing; repeated pairs and either order count once; no
pairs give an empty result. An id in no pair has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import discard, materialize, table

#: Rows of a set beyond which its vertex is hot.
HOT = 1_000_000


def components(pairs: DataFrame, left: str = "a", right: str = "b", *, member: str = "id", group: str = "group_id", max_rounds: int = 200) -> DataFrame:
    """Group of each id of `pairs`: (id, group_id), where group_id is the smallest id linked directly or indirectly."""
    spark = pairs.sparkSession
    links = pairs.select(F.col(left).alias("v"), F.col(right).alias("u")).filter("v is not null and u is not null and v <> u")
    state = links.unionAll(links.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
    state, path = materialize(state, "groups")
    seen = _print(state)
    for _ in range(max_rounds):
        low = state.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("low"), F.count("*").alias("n"))
        sent = with_low(state, low, seen[0])
        # the set, with its own vertex, to the smallest member; the smallest member to all others
        to_low = sent.select(F.col("low").alias("v"), "u").unionAll(low.select(F.col("low").alias("v"), F.col("v").alias("u")))
        to_rest = sent.select(F.col("u").alias("v"), F.col("low").alias("u")).unionAll(low.select("v", F.col("low").alias("u")))
        following, new_path = materialize(to_low.unionAll(to_rest).filter("v <> u").distinct(), "groups")
        discard(spark, path)
        state, path, before = following, new_path, seen
        seen = _print(state)
        if seen == before:
            break
    else:
        raise RuntimeError(f"not stable after {max_rounds} rounds")
    # stable: a vertex below all its members heads its group, any other has only its head
    return state.groupBy(F.col("v").alias(member)).agg(F.least(F.min("u"), F.col("v")).alias(group))


def with_low(state: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """The sets (v, u) with the smallest member of each: sets of more than `HOT` rows stay where they are and get theirs sent.

    The smallest vertex of a component holds it whole, so its rows must not meet in one task. There are no more hot vertices than rows / HOT.
    """
    if rows <= HOT:
        return state.join(low.drop("n"), "v")
    hot = F.broadcast(low.filter(F.col("n") > HOT).select("v", "low"))
    cold = state.join(F.broadcast(low.filter(F.col("n") > HOT).select("v")), "v", "left_anti")
    return state.join(hot, "v").unionAll(cold.join(low.filter(F.col("n") <= HOT).drop("n"), "v"))


def _print(state: DataFrame) -> tuple:
    """Count and order-free fingerprint of the sets."""
    return tuple(state.select(F.xxhash64("v", "u").alias("h"), F.xxhash64("u", "v").alias("k")).agg(F.count("*"), F.expr("bit_xor(h)"), F.expr("bit_xor(k)")).first())


def question_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links (a, b) of questions: verdict match with both ids known, or an equal duplicateGroupId (as a star at the smallest id)."""
    questions = table(spark, folder, "questions").filter("id is not null").select("id", "duplicateGroupId").distinct()
    ids = questions.select("id").distinct()
    matches = table(spark, folder, "question_matches").filter("verdict = 'match' and id_a <> id_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    known = matches.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    grouped = questions.filter("duplicateGroupId is not null")
    heads = grouped.groupBy("duplicateGroupId").agg(F.min("id").alias("a"))
    stars = grouped.join(heads, "duplicateGroupId").select("a", F.col("id").alias("b")).filter("a <> b")
    return known.unionAll(stars)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each linked question, with the smallest id of its group."""
    return components(question_links(spark, folder))


QUERIES = {"p2_found": p2_found}
ORACLE = {
    "p2_found": """
WITH RECURSIVE q AS (SELECT DISTINCT id, duplicateGroupId AS g FROM questions WHERE id IS NOT NULL),
e0 AS (
  SELECT DISTINCT id_a AS a, id_b AS b FROM question_matches WHERE verdict = 'match' AND id_a <> id_b AND id_a IN (SELECT id FROM q) AND id_b IN (SELECT id FROM q)
  UNION SELECT h.a, q.id FROM q JOIN (SELECT g, min(id) AS a FROM q WHERE g IS NOT NULL GROUP BY g) h ON q.g = h.g WHERE q.id <> h.a
), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
r(id, o) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.id WHERE r.o < e.b)
SELECT e.a AS id, least(e.a, min(r.o)) AS group_id FROM (SELECT DISTINCT a FROM e) e JOIN r ON r.id = e.a GROUP BY e.a
"""
}
