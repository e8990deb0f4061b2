"""Near-duplicate records with small edits (problem 7) by ProbMinHash, banding and verification.

Shingles are three-character sequences. ProbMinHash lets every shingle arrive as a Poisson process whose rate is its weight; a
register keeps the shingle of its first arrival, and a document stops drawing once no later arrival can win. Registers agree with the
probability Jaccard similarity. All weights are equal here, since the similarity asked for is that of sets: weights by rarity would make
registers of rows that share a template agree far less than their sets do. Bands of registers propose pairs, which size and a parity
bitmap of the shingles thin out and the sets themselves verify.

Copies are never expanded: only one row for each distinct (section, content, formatting class) takes part. Buckets of up to
`SMALL_BUCKET` rows give all their pairs, larger ones link every row to the smallest, batch by batch where they are read, so that no bucket goes
to a task as a whole.

The bands find most links cheaply. What they may miss is found exactly: two alike sets share two of the rarest sequences of both
in one of some groups of sequences (`plans.alike`), so all pairs that do and are not in one group of rows yet are compared, by size, place, bitmap and at last
the sets themselves. Keys of many rows are split into pairs of blocks. Pairs inside a group need no comparison.

Texts travel, not their shingles, which are many times larger and cut again where they are needed.

Defined results: a null text or choice is empty; contents of fewer than three characters have no sequences and are
alike to nothing but an equal non-empty content of another formatting class; a null section is `am2`; written questions
take no part; rows that repeat an id count once.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.copies import bare
from quernstone.llm.groups import components
from quernstone.plans.alike import BITS, BLOCK, FILED, PART, POSTED, _bitmaps, _filed, _filed_links, _mix, _parted, _Part, _slices, missed_pairs, shingles, tokens
from quernstone.session import materialize, shared_file, table

#: Similarity that makes two records alike.
ALIKE = 0.60
#: Bands of registers, registers in a band (a pair of similarity 0.6 meets with 0.994, one of 0.65 with 0.9996), and the rows of a bucket
#: whose pairs are all proposed.
BANDS, BAND_ROWS, SMALL_BUCKET = 64, 5, 40
#: Candidates sent to every task for verification (a checked bound, 16 bytes each); beyond it they are shuffled.
SENT = 200_000
_BARE = regex.compile(r"[^\p{L}\p{N}]+")


def content(text: str) -> str:
    """Letters and digits, with width and case evened out."""
    return _BARE.sub("", unicodedata.normalize("NFKC", text).lower())


def prob_min_hash(flat: np.ndarray, owner: np.ndarray, weights: np.ndarray, rows: int, registers: int, draws: int = 6) -> np.ndarray:
    """Registers of `rows` documents from their shingles: 24 bits of the winner's hash of every register.

    flat, owner, weights: one entry per shingle of a document. Each entry draws exponential gaps in its own pseudo-random
    stream, `draws` at a time; a draw goes to a register of that stream. An entry leaves once its next arrival is later than every
    register of its document. A register holds arrival and winner in one number, so that one minimum finds both.
    """
    low = np.uint64(0xFFFFFF)
    best = np.full(rows * registers, ~np.uint64(0))
    with np.errstate(over="ignore"):
        kinds = np.unique(flat)  # a shingle's stream is drawn once for all documents
        seed, which = _mix(kinds.astype(np.uint64)), np.searchsorted(kinds, flat)
        rate, even = np.asarray(weights, dtype=np.float64), bool((np.asarray(weights) == 1).all())
        arrival, first = np.zeros(len(seed)), 0
        while len(which):
            steps = np.arange(first, first + draws, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
            h = _mix(seed[:, None] + steps[None, :])
            gone = np.cumsum(-np.log(((h >> np.uint64(24)) + np.uint64(1)).astype(np.float64) * 2.0**-40), axis=1) + arrival[:, None]
            to = (((h & low) * np.uint64(registers)) >> np.uint64(24)).astype(np.int64)
            winner = seed >> np.uint64(40)
            slot = to[which]
            slot += (owner * registers)[:, None]
            if even:
                value = ((gone.view(np.uint64) & ~low) | winner[:, None])[which]
            else:
                value = ((gone[which] / rate[:, None]).view(np.uint64) & ~low) | winner[which][:, None]
            np.minimum.at(best, slot.ravel(), value.ravel())
            latest = best.reshape(rows, registers).max(axis=1)
            arrival, first = gone[:, -1], first + draws
            alive = (value[:, -1] & ~low) < latest[owner]
            left, owner, rate = which[alive], owner[alive], rate[alive]
            still = np.zeros(len(seed), dtype=bool)
            still[left] = True
            which = (np.cumsum(still) - 1)[left]
            seed, arrival = seed[still], arrival[still]
    return (best & low).reshape(rows, registers)


def _content_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["section"], b["kind"], b["id"], pa.array([content(t) for t in b["raw"].to_pylist()], pa.string())], ["section", "kind", "id", "text"])


def _band_keys(b: pa.RecordBatch, bands: int, band_rows: int) -> tuple[np.ndarray, ...]:
    """(row, key) of the bands of all rows that have sequences, and (owner, token) of these."""
    owner, token = tokens(b["text"].to_pylist())
    regs = prob_min_hash(token, owner, np.ones(len(token)), b.num_rows, bands * band_rows).reshape(b.num_rows, bands, band_rows)
    sec = b["sec"].to_numpy(zero_copy_only=False).view(np.uint64)
    with np.errstate(over="ignore"):
        keys = _mix(sec[:, None] ^ (np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40))[None, :])  # a band's keys are its own, and a section's
        for r in range(band_rows):
            keys = _mix(keys ^ regs[:, :, r])
    some = np.unique(owner)
    return np.repeat(some, bands), keys[some].ravel(), owner, token


def _band_postings(parts: int, threshold: float, bands: int, band_rows: int, folder: str | None = None):  # noqa: ANN001, ANN202
    """Each row's bands by part, with its bitmap.

    A bucket that is crowded within one batch sends its smallest node only; the others of the batch are linked to it there and then, as rows
    (node, comp) without keys, so that no bucket reaches a task as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, base = f"{folder}/{uuid.uuid4().hex}", 0
        for whole in _slices(batches, 1 << 14):
            made = [(b.num_rows, *_band_keys(b, bands, band_rows)) for b in _slices(iter([whole]), 500)]
            if not made:
                continue
            starts = np.cumsum([0, *(m[0] for m in made)])
            row = np.concatenate([m[1] + k for m, k in zip(made, starts)])
            key = np.concatenate([m[2] for m in made])
            sizes = np.concatenate([np.bincount(m[3], minlength=m[0]) for m in made])
            bits = np.concatenate([_bitmaps(m[3], m[4], m[0]) for m in made])
            node = whole["node"].to_numpy()
            order = np.lexsort((node[row], key))
            row, key = row[order], key[order]
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
            number = np.diff(np.r_[head, len(key)])
            first = np.repeat(row[head], number)
            crowded = np.repeat(number > SMALL_BUCKET, number) & (row != first)
            links = np.unique(np.column_stack([first[crowded], row[crowded]]), axis=0)
            if len(links):
                x, y = links.T
                both = sizes[x] + sizes[y]
                least = np.ceil(threshold / (1 + threshold) * both - 1e-9)
                near = (np.minimum(sizes[x], sizes[y]) >= least) & (np.bitwise_count(bits[x].view(np.uint64) ^ bits[y].view(np.uint64)).sum(axis=1, dtype=np.int64) <= both - 2 * least)
                links = links[near]
                n = len(links)
            if len(links) and folder is not None:
                yield _filed_links(node[links], parts)
            elif len(links):
                zero = pa.array(np.zeros(n + 1, dtype=np.int32))
                empty = pa.ListArray.from_arrays(zero, pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[links[:, 0]] % parts), pa.array(node[links[:, 0]]), pa.array(node[links[:, 1]]), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, dtype=np.int32)), pa.array([bytes(BITS // 8)] * n, pa.binary()), empty, empty],
                    ["part", "node", "comp", "kind", "size", "bits", "keys", "places"],
                )
            row, key = row[~crowded], key[~crowded]
            place = np.zeros(len(row), dtype=np.int64)
            if folder is None:
                yield _parted(whole, row, key, place, parts, sizes, bits)
            else:
                yield _filed(whole, row, key, place, parts, sizes, bits, path, base)
                base += whole.num_rows

    return run


def _buckets(threshold: float):  # noqa: ANN202
    """Pairs of the buckets of a part: all of small ones, links to the smallest node of larger ones."""

    def run(t: pa.Table) -> pa.Table:
        p = _Part.of(t, threshold)
        order = np.lexsort((p.node[p.row], p.key))
        key = p.key[order]
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, dtype=bool)
        head = np.flatnonzero(fresh)
        number = np.diff(np.r_[head, len(key)])
        run_of = np.cumsum(fresh) - 1
        here = np.arange(len(key))
        little = number[run_of] <= SMALL_BUCKET
        inner = np.flatnonzero(little & (here + 1 < (head + number)[run_of]))
        p.ranges(order[inner], inner + 1, (head + number)[run_of[inner]] - inner - 1, order)
        outer = np.flatnonzero(~little & ~fresh)
        p.ranges(order[outer], head[run_of[outer]], np.ones(len(outer), dtype=np.int64), order)
        return p.pairs()

    return run


def band_pairs(nodes: DataFrame, total: int, *, threshold: float, bands: int, band_rows: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket of some band and may be alike, a < b, distinct; nodes: (node, sec, comp, kind, text)."""
    parts = max(1, total * bands // PART)
    folder = shared_file(nodes.sparkSession, "p7-bands", released=True)
    return nodes.mapInArrow(_band_postings(parts, threshold, bands, band_rows, folder), FILED if folder else POSTED).groupBy("part").applyInArrow(_buckets(threshold), "a long, b long").distinct()


def alike_nodes(nodes: DataFrame, *, threshold: float = ALIKE, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Pairs (a, b) of distinct contents whose shingle sets are alike, all that join groups; nodes: (node long, section, kind, text), kind null if several."""
    total = nodes.count()
    keyed = nodes.select("node", F.xxhash64("section").alias("sec"), F.col("node").alias("comp"), "kind", "text")
    pairs, _ = materialize(band_pairs(keyed, total, threshold=threshold, bands=bands, band_rows=band_rows), "p7-candidates")
    near, _ = materialize(verified(pairs, nodes, threshold), "p7-near")
    # nodes of one kind only that they share are no link, so their pairs join no groups
    groups = components(near.filter("ka is null or kb is null or ka <> kb").select("a", "b"), member="node", group="comp")
    grouped, _ = materialize(keyed.drop("comp").join(groups, "node", "left").select("node", "sec", F.coalesce("comp", "node").alias("comp"), "kind", "text"), "p7-grouped")
    rest, _ = materialize(missed_pairs(grouped, threshold=threshold, block=BLOCK, part=PART), "p7-rest")
    return near.select("a", "b").unionAll(verified(rest, nodes, threshold).select("a", "b"))


def _alike(threshold: float):  # noqa: ANN202
    """The rows whose texts (ta, tb) have alike sets, compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["ta"].to_pylist(), b["tb"].to_pylist()):
                x, y = shingles(x), shingles(y)  # noqa: PLW2901
                shared = len(x) + len(y) - len(np.union1d(x, y))
                # compared as whole numbers of a fraction: shared / union >= threshold
                keep.append(shared >= threshold * (len(x) + len(y) - shared) - 1e-9 and shared > 0)
            yield b.filter(pa.array(keep, pa.bool_())).drop_columns(["ta", "tb"]) if b.num_rows else b.drop_columns(["ta", "tb"])

    return run


def verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ka, kb): the pairs whose sets are alike, with the kinds of both."""
    few = pairs.count() <= SENT
    side = nodes.select("node", "section", "kind", "text")
    met = side.withColumnsRenamed({"node": "a", "text": "ta", "section": "sa", "kind": "ka"}).join(F.broadcast(pairs) if few else pairs, "a")
    met = side.withColumnsRenamed({"node": "b", "text": "tb", "section": "sb", "kind": "kb"}).join(met, "b").filter("sa = sb")
    return met.select("a", "b", "ka", "kb", "ta", "tb").mapInArrow(_alike(threshold), "a long, b long, ka long, kb long")


def choice_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Choice questions, one row per id: (section, kind, id, raw); kind is the formatting class within which rows are copies."""
    q = table(spark, folder, "questions").filter("id is not null and choices is not null")
    texts = F.transform("choices", lambda c: F.coalesce(c["text"], F.lit("")))
    copied = F.when(F.col("text").isNotNull() & (F.size("choices") == 4), F.xxhash64(bare(F.col("text")), F.array_sort(F.transform(texts, bare)))).otherwise(F.xxhash64("id"))
    raw = F.concat(F.coalesce("text", F.lit("")), F.array_join(texts, ""))
    return q.select("id", F.struct(F.coalesce("section", F.lit("am2")).alias("section"), copied.alias("kind"), raw.alias("raw")).alias("r")).groupBy("id").agg(F.min("r").alias("r")).select("r.section", "r.kind", "id", "r.raw")


def alike_groups(rows: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """(id, group_id) of the rows (section, kind, id, raw) alike to another one of another kind."""
    made = rows.select("section", "kind", "id", "raw").mapInArrow(_content_rows, "section string, kind long, id string, text string").filter("text <> ''")
    made, _ = materialize(made.withColumn("c", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))), "p7-rows")
    # one numbered node per distinct content of a section
    named, _ = materialize(made.groupBy("section", "c").agg(F.first("text").alias("text"), F.when(F.min("kind") == F.max("kind"), F.min("kind")).alias("kind")).withColumn("node", F.monotonically_increasing_id()), "p7-nodes")
    nodes, keyed = named.select("node", "section", "kind", "text"), made
    pairs, _ = materialize(alike_nodes(nodes, **how), "p7-pairs")
    # a member of the graph is a (node, kind); rows of one member are copies of each other
    placed_ids, _ = materialize(keyed.select("section", "c", "kind", "id").join(named.select("section", "c", "node"), ["section", "c"]).select("node", "kind", "id"), "p7-ids")
    members, _ = materialize(placed_ids.groupBy("node", "kind").agg(F.min("id").alias("m")), "p7-members")
    w = members.groupBy("node").agg(F.count("*").alias("kinds"), F.min_by("m", "m").alias("first"), F.min("kind").alias("k_low"), F.max("kind").alias("k_high"))
    inner = members.join(w.filter("kinds > 1").select("node", "first"), "node").filter("m <> first").select(F.col("first").alias("a"), F.col("m").alias("b"))
    left = members.withColumnsRenamed({"node": "a", "m": "ma", "kind": "ka"})
    right = members.withColumnsRenamed({"node": "b", "m": "mb", "kind": "kb"})
    # nodes of several kinds are linked inside already, so the smallest member of another kind is enough
    heads_l = left.groupBy("a").agg(F.min(F.struct("ma", "ka")).alias("l"))
    heads_r = right.groupBy("b").agg(F.min(F.struct("mb", "kb")).alias("r"))
    outer1 = pairs.join(heads_l, "a").join(right, "b").filter("l.ka <> kb").select(F.col("l.ma").alias("a"), F.col("mb").alias("b"))
    outer2 = pairs.join(heads_r, "b").join(left, "a").filter("r.kb <> ka").select(F.col("ma").alias("a"), F.col("r.mb").alias("b"))
    groups = components(inner.unionAll(outer1).unionAll(outer2), member="m", group="g")
    placed = groups.join(members, "m").select("node", "kind", "g")
    return placed_ids.join(placed, ["node", "kind"]).select("id", F.col("g").alias("group_id"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Choice questions alike to others, with the smallest id of their group."""
    return alike_groups(choice_contents(spark, folder))


QUERIES = {"p7_found": p7_found}


def _even_width() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and these."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1 and a != "'" and b != "'"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_BARE_SQL = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_TEXTS = "list_transform(choices, lambda x: coalesce(x.text, ''))"
ORACLE = {
    "p7_found": (
        "WITH RECURSIVE c AS (SELECT id, min(struct_pack(s := coalesce(section, 'am2'), k := CASE WHEN text IS NOT NULL AND len(choices) = 4 THEN " + _BARE_SQL.format("text") + " || chr(1) || array_to_string(list_sort(list_transform(" + _TEXTS + ", lambda x: " + _BARE_SQL.format("x") + ")), chr(1)) ELSE chr(2) || id END,"
        " raw := coalesce(text, '') || array_to_string(" + _TEXTS + ", ''))) AS r FROM questions WHERE id IS NOT NULL AND choices IS NOT NULL GROUP BY id),"
        " t AS (SELECT id, r.s AS s, r.k AS k, " + _BARE_SQL.format("nfc_normalize(translate(r.raw, '{}', '{}'))".format(*_even_width())) + " AS x FROM c),"
        " g AS (SELECT DISTINCT id, s, substr(x, i, 3) AS g FROM (SELECT id, s, x, unnest(range(1, len(x) - 1)) AS i FROM t WHERE len(x) > 2)),"
        " n AS (SELECT id, count(*) AS n FROM g GROUP BY id),"
        " m AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),"
        " l AS (SELECT a, b FROM m JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE m >= 0.6 * (p.n + q.n - m) UNION SELECT a.id, b.id FROM t a JOIN t b ON a.s = b.s AND a.x = b.x AND a.id < b.id WHERE a.x <> ''),"
        " k AS (SELECT a, b FROM l JOIN t p ON p.id = a JOIN t q ON q.id = b WHERE p.k <> q.k),"
        " e AS (SELECT a, b FROM k UNION SELECT b, a FROM k),"
        " r(id, o) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.id WHERE r.o < e.b)"
        " SELECT e.a AS id, least(e.a, min(r.o)) AS group_id FROM (SELECT DISTINCT a FROM e) e JOIN r ON r.id = e.a GROUP BY e.a"
    )
}
