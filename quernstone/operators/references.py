"""References to records that do not exist (problem 4).

Parents' keys are cut into ranges of about equal size at quantiles. Each range holds its keys as sorted arrays; batches of
references are probed by binary search. Ranges with more references than one task should hold are salted: the
references are spread, and the range's (bounded) key array goes to each salt.

Defined results: a null or blank key is no reference; blanks and tabs around the keys of a field declared `trim` do not
matter; a reference without a time can only be `missing`, with a null period; a parent without added_at is never late
and without removed_at never deleted; a late reference is not deleted too; parents that repeat count once, with their earliest added_at and latest end.
Empty parents make every reference missing. Columns of the inputs beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import materialize, table

OUT = "tbl string, fld string, row_key string, kind string, period string"
#: Keys in a range, and references that one group may hold.
RANGE_KEYS, GROUP_ROWS = 100_000, 200_000
#: Ranges at most: the driver holds a sample of some forty keys of each, and one bound and one count.
MOST_RANGES = 16_384


@dataclass(frozen=True)
class Reference:
    """One referencing field: where it is, what names the row, and the time at which it must hold."""

    tbl: str
    fld: str
    row_key: str
    time: str
    parent: str
    millis: bool = False
    trim: bool = False


#: The references of the project's tables.
REFERENCES = (
    Reference("questions", "caseId", "id", "added_at", "cases", trim=True),
    Reference("answer_log", "question_id", "seq", "answered_at", "questions", millis=True),
    Reference("states", "question_id", "question_id", "last_answered_at", "questions", millis=True),
    Reference("am_fixes", "id", "fix_key", "fixed_at", "questions"),
    Reference("question_matches", "id_a", "match_id", "matched_at", "questions"),
    Reference("question_matches", "id_b", "match_id", "matched_at", "questions"),
)


def _key(name: str, trim: bool) -> Column:
    key = F.regexp_replace(F.col(name), r"^[ \t　]+|[ \t　]+$", "") if trim else F.col(name)
    return F.when(F.regexp_replace(key, r"[ \t　]+", "") != "", key)


def references(spark: SparkSession, folder: str, declared: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """All references as (parent, key, tbl, fld, row_key, at in microseconds)."""
    parts = []
    for r in declared:
        at = F.col(r.time) * 1000 if r.millis else F.unix_micros(r.time)
        parts.append(
            table(spark, folder, r.tbl)
            .select(F.lit(r.parent).alias("parent"), _key(r.fld, r.trim).alias("key"), F.lit(r.tbl).alias("tbl"), F.lit(r.fld).alias("fld"), F.col(r.row_key).cast("string").alias("row_key"), at.alias("at"))
            .filter("key is not null")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def parents(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """All parents as (parent, key, added, gone in microseconds); gone is null for those still there."""
    out = None
    for name in names:
        one = (
            table(spark, folder, name)
            .filter("id is not null")
            .groupBy(F.col("id").alias("key"))
            .agg(F.min(F.unix_micros("added_at")).alias("added"), F.when(F.count("*") == F.count("removed_at"), F.max(F.unix_micros("removed_at"))).alias("gone"))
            .select(F.lit(name).alias("parent"), "key", "added", "gone")
        )
        out = one if out is None else out.unionAll(one)
    return out


def _bounds(parents_df: DataFrame, range_keys: int) -> list[tuple[str, str]]:
    """Lower bounds of the ranges: quantiles of a sample of some keys a range. Beyond `MOST_RANGES` ranges grow in size and not in number."""
    total = parents_df.count()
    ranges = max(1, min(MOST_RANGES, -(-total // range_keys)))
    if ranges == 1:
        return []
    seen = parents_df.sample(min(1.0, 40.0 * ranges / total), seed=7).select("parent", "key").collect()
    keys = sorted((r[0], r[1]) for r in seen)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _sorted_keys(values: list[str]) -> np.ndarray:
    """Keys as bytes that compare like code points; the last byte keeps trailing NULs."""
    return np.array([v.encode() + b"\x01" for v in values], dtype=bytes) if values else np.array([], dtype="S1")


#: The result as Arrow holds it.
_SCHEMA = pa.schema([(n, pa.string()) for n in ("tbl", "fld", "row_key", "kind", "period")])


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """The misses among the references of one range and salt."""
    return pa.Table.from_batches(list(_misses(left, right.combine_chunks().to_batches())), _SCHEMA)


def _misses(t: pa.Table, right: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Binary search of reference batches in the sorted key arrays of one range."""
    held = t.num_rows > 0
    if held:
        keys = _sorted_keys([p + "\x00" + k for p, k in zip(t["parent"].to_pylist(), t["key"].to_pylist())])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        added = t["added"].fill_null(low).to_numpy()[order]
        gone = t["gone"].fill_null(high).to_numpy()[order]
    for b in right:
        if not b.num_rows:
            continue
        joined = pc.binary_join_element_wise(b["parent"].cast(pa.string()), b["key"].cast(pa.string()), pa.scalar("\x00"))
        coded = joined.dictionary_encode()
        which = coded.indices.to_numpy()
        at = b["at"].to_numpy(zero_copy_only=False)
        timed = np.asarray(b["at"].is_valid())
        at = np.where(timed, np.nan_to_num(at.astype("float64")), 0).astype("int64") if at.dtype.kind == "f" else at
        if held:
            probes = _sorted_keys(coded.dictionary.to_pylist())
            width = max(keys.dtype.itemsize, probes.dtype.itemsize)
            wide = keys.astype(f"S{width}")
            place = np.searchsorted(wide, probes.astype(f"S{width}"))
            hit = (place < len(wide)) & (wide[np.minimum(place, len(wide) - 1)] == probes.astype(f"S{width}"))
            place, hit = np.minimum(place, len(wide) - 1)[which], hit[which]
            late = hit & timed & (added[place] > at)
            deleted = hit & timed & ~late & (gone[place] <= at)
        else:
            hit = late = deleted = np.zeros(b.num_rows, dtype=bool)
        for kind, mask in (("missing", ~hit), ("late", late), ("deleted", deleted)):
            if mask.any():
                kept = b.filter(pa.array(mask))
                times = pa.array(np.where(timed[mask], at[mask], 0), pa.timestamp("us"), mask=~timed[mask])
                yield pa.RecordBatch.from_arrays(
                    [kept["tbl"].cast(pa.string()), kept["fld"].cast(pa.string()), kept["row_key"].cast(pa.string()), pa.array([kind] * kept.num_rows), pc.strftime(times, "%Y-%m")], schema=_SCHEMA
                )


def orphans(refs: DataFrame, parents_df: DataFrame, *, range_keys: int = RANGE_KEYS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """References that lead nowhere: (tbl, fld, row_key, kind missing | late | deleted, period), distinct."""
    spark = refs.sparkSession
    kept_parents, _ = materialize(parents_df, "p4-parents")
    bounds = _bounds(kept_parents, range_keys)
    lows = [f"{p}\x00{k}" for p, k in bounds]

    def ranged(df: DataFrame) -> DataFrame:
        if not lows:
            return df.withColumn("rng", F.lit(0))
        return df.withColumn("rng", _range_of(lows)(F.concat_ws("\x00", "parent", "key")))

    kept_refs, _ = materialize(ranged(refs), "p4-refs")
    hot = [(r["rng"], -(-r["count"] // group_rows)) for r in kept_refs.groupBy("rng").count().collect()]
    salts = spark.createDataFrame(hot or [(0, 1)], "rng int, salts long")
    split = kept_refs.join(F.broadcast(salts), "rng").withColumn("salt", F.pmod(F.xxhash64("tbl", "row_key"), "salts")).drop("salts")
    copied = ranged(kept_parents).join(F.broadcast(salts), "rng").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    # as many partitions as groups, so that no task's share grows with the input
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(s for _, s in hot))
    copied, split = copied.repartition(n, "rng", "salt"), split.repartition(n, "rng", "salt")
    return copied.groupBy("rng", "salt").cogroup(split.groupBy("rng", "salt")).applyInArrow(_probe, OUT).distinct()


def _range_of(lows: list[str]):  # noqa: ANN202
    held = np.sort(_sorted_keys(lows))

    @F.pandas_udf("int")
    def rng(keys):  # noqa: ANN001, ANN202
        import pandas as pd

        probes = _sorted_keys(keys.tolist())
        width = max(held.dtype.itemsize, probes.dtype.itemsize)
        return pd.Series(np.searchsorted(held.astype(f"S{width}"), probes.astype(f"S{width}"), side="right").astype("int32"))

    return rng


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references of all tables."""
    return orphans(references(spark, folder), parents(spark, folder, ["questions", "cases"]))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, field, period and kind."""
    return p4_found(spark, folder).groupBy("tbl", "fld", "period", "kind").agg(F.count("*").alias("orphans"))


_REFS_SQL = """
refs AS (
  SELECT 'cases' AS parent, regexp_replace(caseId, '^[ \t　]+|[ \t　]+$', '', 'g') AS key, 'questions' AS tbl, 'caseId' AS fld, id AS row_key, epoch_us(added_at) AS at FROM questions
  UNION ALL SELECT 'questions', question_id, 'answer_log', 'question_id', CAST(seq AS VARCHAR), answered_at * 1000 FROM answer_log
  UNION ALL SELECT 'questions', question_id, 'states', 'question_id', question_id, last_answered_at * 1000 FROM states
  UNION ALL SELECT 'questions', id, 'am_fixes', 'id', fix_key, epoch_us(fixed_at) FROM am_fixes
  UNION ALL SELECT 'questions', id_a, 'question_matches', 'id_a', match_id, epoch_us(matched_at) FROM question_matches
  UNION ALL SELECT 'questions', id_b, 'question_matches', 'id_b', match_id, epoch_us(matched_at) FROM question_matches
), parents AS (
  SELECT parent, key, min(added) AS added, CASE WHEN count(*) = count(gone) THEN max(gone) END AS gone FROM (
    SELECT 'questions' AS parent, id AS key, epoch_us(added_at) AS added, epoch_us(removed_at) AS gone FROM questions
    UNION ALL SELECT 'cases', id, epoch_us(added_at), epoch_us(removed_at) FROM cases) GROUP BY ALL
), found AS (
  SELECT DISTINCT r.tbl, r.fld, r.row_key, CASE WHEN p.key IS NULL THEN 'missing' WHEN p.added > r.at THEN 'late' WHEN p.gone <= r.at THEN 'deleted' END AS kind,
    strftime(make_timestamp(r.at), '%Y-%m') AS period
  FROM refs r LEFT JOIN parents p ON p.parent = r.parent AND p.key = r.key
  WHERE regexp_replace(r.key, '[ \t　]+', '', 'g') <> ''
)
"""
ORACLE = {
    "p4_found": f"WITH {_REFS_SQL} SELECT tbl, fld, row_key, kind, period FROM found WHERE kind IS NOT NULL",
    "p4_report": f"WITH {_REFS_SQL} SELECT tbl, fld, period, kind, count(*) AS orphans FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
