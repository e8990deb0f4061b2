"""Filling fixed-capacity containers with items (problem 9) by a configuration linear program.

Sizes are the texts' tokens. Their histogram (never longer than the capacity) decides everything; items stay distributed:
1. Texts over the capacity are cut into full containers and a rest; no other text is split.
2. All but the smallest sizes are grouped into classes of neighbouring sizes. The linear program over configurations (multisets of classes that
   fit) is solved by multiplicative weights: a class's dual is its size times a weight that falls with its coverage, and each round prices by
   knapsack dynamic programming.
3. Each round's configuration is rounded down to whole containers, a small share of what the scarcest class in it has left; slots
   take exact sizes, run by run, so the space left is known exactly. Rounds go on until few items are left.
4. What remains, and all smallest sizes, go by decreasing size into the fullest container that has room, whole runs at a time.
5. Best fit alone is tried as well and kept only where it needs fewer containers. The duals give a lower bound for any packing.
The plan is a list of runs: of the items of one size, ranks from..to go to consecutive containers at one place. Ranks come from
counts per (size, hash slice), so one size may hold any share of the rows.

Defined results: null and empty texts take no room and are spread over the containers after their other places; without any
other item they get container 0. container and place count from 0 within a pack; chunk counts the cuts of an oversize text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.lexicon import Counts, pieces, tokenizer_folder
from quernstone.session import materialize, table

#: Classes of sizes, rounds, share of the scarcest class that a round takes, fall of a weight with coverage, cells of the knapsack, slices for ranks at least.
CLASSES, ROUNDS, SHARE, FALL, CELLS, SLICES = 128, 400, 0.5, 0.5, 2048, 64
#: Documents for each further slice, so that the most frequent size never fills one task.
SLICE_ROWS = 1_000_000
#: Sizes up to this share of the capacity are smallest ones, and the share of the others at which the rounds end.
SMALL, ENOUGH = 1 / 12, 0.08


def price(need: np.ndarray, value: np.ndarray, cells: int) -> tuple[float, np.ndarray]:
    """(value, count of each class) of the most valuable configuration: an unbounded knapsack over `cells` cells."""
    order = np.argsort(need, kind="stable")
    need, value = need[order], value[order]
    upto = np.searchsorted(need, np.arange(cells + 1), side="right")
    best, pick = np.zeros(cells + 1), np.full(cells + 1, -1)
    for c in range(int(need[0]), cells + 1):
        k = upto[c]
        gains = best[c - need[:k]] + value[:k]
        j = int(gains.argmax())
        best[c], pick[c] = gains[j], j
    taken, c = np.zeros(len(need), dtype=np.int64), cells
    while c > 0 and pick[c] >= 0:
        taken[order[pick[c]]] += 1
        c -= int(need[pick[c]])
    return float(best[cells]), taken


def bound(sizes: np.ndarray, demand: np.ndarray, value: np.ndarray, capacity: int) -> float:
    """Containers that any packing of the items needs at least: by weak duality, with sizes rounded down to cells."""
    cells = min(CELLS, capacity)
    need = np.maximum(1, sizes * cells // capacity).astype(np.int64)
    return float((value * demand).sum()) / max(price(need, value, cells)[0], 1e-300)


class Stock:
    """Items left by size, in classes of neighbouring sizes of about equal numbers of items."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = dict(histogram)
        self.sizes = sorted(histogram)
        per, held, self.tops = sum(histogram.values()) / CLASSES, 0.0, []
        for size in self.sizes:
            held += histogram[size]
            if held >= per or len(self.sizes) <= CLASSES:
                self.tops.append(size)
                held = 0.0
        if held:
            self.tops.append(self.sizes[-1])
        self.number = np.zeros(len(self.tops), dtype=np.int64)
        for size in self.sizes:
            self.number[bisect_left(self.tops, size)] += histogram[size]

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        self.number[bisect_left(self.tops, size)] -= n
        if not self.left[size]:
            self.sizes.pop(bisect_left(self.sizes, size))

    def fitting(self, room: int) -> int | None:
        """The largest size that fits."""
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else None

    def paired(self, cls: int, room: int) -> tuple[int | None, int]:
        """(size, items): a size of a class with another one that fills `room` up exactly, else the largest of the class."""
        high = self.largest(cls)
        if high is None:
            return None, 0
        low = self.tops[cls - 1] if cls else 0
        for at in range(bisect_right(self.sizes, high) - 1, -1, -1):
            size = self.sizes[at]
            if size <= low:
                break
            if other := self.left.get(room - size, 0):
                if room - size != size:
                    return size, other
                if other > 1:
                    return size, other // 2
        return high, self.left[high]

    def largest(self, cls: int) -> int | None:
        """The largest size left in a class."""
        size = self.fitting(self.tops[cls])
        return size if size is not None and (cls == 0 or size > self.tops[cls - 1]) else None


class Plan:
    """Runs of items laid into runs of containers."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.used = capacity, 0
        self.bound, self.left = 0.0, 0.0  # lower bound, share of the classes' items that best fit placed
        self.next_rank: dict[int, int] = {}
        self.runs: list[tuple[int, int, int, int, int]] = []  # size, first rank, items, first container, place
        self.free: dict[int, list[tuple[int, int, int]]] = {}  # free space: (first container, containers, places)
        self.spaces: list[int] = []
        self.ends: list[tuple[int, int, int]] = []

    def _give(self, space: int, run: tuple[int, int, int]) -> None:
        if space not in self.free:
            insort(self.spaces, space)
            self.free[space] = []
        self.free[space].append(run)

    def _place(self, size: int, count: int, first: int, place: int) -> None:
        rank = self.next_rank.get(size, 0)
        self.runs.append((size, rank, count, first, place))
        self.next_rank[size] = rank + count

    def configured(self, slots: list[int], number: int, stock: Stock) -> None:
        """`number` containers of one configuration; `slots`: a class per place, the smallest last.

        A slot takes the largest size left in its class. The last but one takes a size that another one fills up exactly, if its class has one, and
        the last one the largest size of any class that still fits, which makes up for the rounding of sizes to classes.
        """
        runs = [(self.used, number, 0, 0)]  # first container, containers, filled, places
        self.used += number
        for k, cls in enumerate(slots):
            following = []
            for first, count, filled, places in runs:
                while count:
                    room = self.capacity - filled
                    size, most = (stock.fitting(room), count) if k and k == len(slots) - 1 else stock.paired(cls, room) if k == len(slots) - 2 else (stock.largest(cls), count)
                    if size is None or size > room:
                        break
                    n = min(count, most, stock.left[size])
                    stock.take(size, n)
                    self._place(size, n, first, places)
                    following.append((first, n, filled + size, places + 1))
                    first, count = first + n, count - n  # noqa: PLW2901
                if count:
                    following.append((first, count, filled, places))
            runs = following
        for first, count, filled, places in runs:
            self._give(self.capacity - filled, (first, count, places))

    def decreasing(self, sizes: list[tuple[int, int]]) -> None:
        """Best fit by decreasing size, a run of equal containers at a time."""
        for size, count in sorted(sizes, reverse=True):
            while count:
                at = bisect_left(self.spaces, size)
                if at == len(self.spaces):
                    # as many new containers as these items fill
                    per = self.capacity // size
                    number = max(1, count // per)
                    self._give(self.capacity, (self.used, number, 0))
                    self.used += number
                    continue
                space = self.spaces[at]
                first, number, places = self.free[space].pop()
                n = min(number, count)
                if n < number:
                    self.free[space].append((first + n, number - n, places))
                if not self.free[space]:
                    del self.free[space]
                    self.spaces.pop(at)
                self._place(size, n, first, places)
                count -= n
                self._give(space - size, (first, n, places + 1))

    def close(self) -> None:
        self.ends = sorted(run for runs in self.free.values() for run in runs)


def configured(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan by the configuration program, its rest by best fit."""
    out = Plan(capacity)
    small = int(capacity * SMALL)
    rest = {s: n for s, n in histogram.items() if s <= small}
    out.bound = sum(s * n for s, n in histogram.items()) / capacity
    stock = Stock({s: n for s, n in histogram.items() if s > small})
    if stock.sizes:
        cells = min(CELLS, capacity)
        tops = np.array(stock.tops, dtype=np.int64)
        lows = np.array([stock.sizes[bisect_right(stock.sizes, t)] for t in [0, *stock.tops[:-1]]])
        need = -(-tops * cells // capacity)
        demand = stock.number.copy()
        total = int(demand.sum())
        out.bound = max(out.bound, bound(lows, demand, tops.astype(np.float64), capacity))
        for _ in range(ROUNDS):
            left = stock.number
            if left.sum() <= ENOUGH * total:
                break
            # weights of the classes fall with coverage; dual values are weighted sizes
            some = np.flatnonzero(left)
            value = tops[some] * np.exp(-FALL * (1 - left[some] / demand[some]))
            _, chosen = price(need[some], value, cells)
            taken = np.zeros(len(tops), dtype=np.int64)
            taken[some] = np.minimum(chosen, left[some])
            used = np.flatnonzero(taken)
            number = max(1, int(SHARE * (left[used] // taken[used]).min()))
            out.configured([c for c in used[::-1].tolist() for _ in range(int(taken[c]))], number, stock)
        out.left = float(stock.number.sum() / total)
        for size in stock.sizes:
            rest[size] = rest.get(size, 0) + stock.left[size]
    out.decreasing(list(rest.items()))
    return out


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Lay out items given only as {size: items}, 1 <= size <= capacity; bound: containers that any packing needs at least."""
    made, plain = configured(histogram, capacity), Plan(capacity)
    plain.decreasing(list(histogram.items()))
    plain.bound = made.bound
    out = made if made.used <= plain.used else plain
    out.close()
    return out


def _sizes(tokenizers: list[str], folder: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counts(t, folder) for t in tokenizers]
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                texts = b["text"].to_pylist()
                cuts = [pieces(t) if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c.counts(texts, cuts)) for c in counters)], ["doc_id", *(f"n{i}" for i in range(len(counters)))])

    return run


def _placed(plans: dict[int, tuple]):  # noqa: ANN202
    """Items (pack_id, doc_id, chunk, size, rank) with container and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pack, size, rank = (b[c].to_numpy() for c in ("pack_id", "size", "rank"))
            container, place = np.zeros(len(pack), dtype=np.int64), np.zeros(len(pack), dtype=np.int64)
            for p in np.unique(pack):
                keys, firsts, containers, places, starts, end_places, used = plans[int(p)]
                at = np.flatnonzero((pack == p) & (size > 0))
                if len(at):
                    k = np.searchsorted(keys, (size[at] << 44) | rank[at], side="right") - 1
                    container[at], place[at] = containers[k] + rank[at] - firsts[k], places[k]
                none = np.flatnonzero((pack == p) & (size == 0))
                if len(none) and used:
                    container[none] = rank[none] % used
                    place[none] = end_places[np.searchsorted(starts, container[none], side="right") - 1] + rank[none] // used
                elif len(none):
                    place[none] = rank[none]
            yield pa.RecordBatch.from_arrays([b["pack_id"], b["doc_id"], b["chunk"], b["size"], pa.array(container), pa.array(place)], ["pack_id", "doc_id", "chunk", "n_tokens", "container", "place"])

    return run


def packed(documents: DataFrame, specs: list[tuple[int, str, int]]) -> DataFrame:
    """(pack_id, doc_id, chunk, n_tokens, container, place) of every document in every pack of `specs` (pack_id, tokenizer, capacity)."""
    spark = documents.sparkSession
    if not specs:
        return spark.createDataFrame([], "pack_id int, doc_id long, chunk long, n_tokens long, container long, place long")
    names = sorted({t for _, t, _ in specs})
    sized = documents.select("doc_id", "text").mapInArrow(_sizes(names, tokenizer_folder(spark)), "doc_id long, " + ", ".join(f"n{i} long" for i in range(len(names))))
    sized, _ = materialize(sized, "p9-sizes")
    slices = max(SLICES, sized.count() // SLICE_ROWS)
    every = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("long").alias("capacity"), F.col(f"n{names.index(t)}").alias("n")) for p, t, c in specs]))
    items = sized.select("doc_id", every.alias("s")).select("doc_id", "s.*")
    # cuts of an oversize text: full containers, then the rest if there is one
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / F.col("capacity")) - 1)
    items = items.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    items = items.withColumn("size", F.least("capacity", F.col("n") - F.col("chunk") * F.col("capacity"))).withColumn("slice", F.pmod(F.xxhash64("doc_id", "chunk"), F.lit(slices)))
    items = items.select("pack_id", "doc_id", "chunk", "size", "slice")
    # counts by size and slice: ranks build on them; only the sizes' totals go to the driver
    counts = items.groupBy("pack_id", "size", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pack_id", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("pack_id", "size", "slice", before.alias("before"))
    ranked = items.withColumn("own", F.row_number().over(Window.partitionBy("pack_id", "size", "slice").orderBy("doc_id", "chunk"))).join(offsets, ["pack_id", "size", "slice"])
    ranked = ranked.select("pack_id", "doc_id", "chunk", "size", (F.col("before") + F.col("own") - 1).alias("rank"))
    histograms: dict[int, dict[int, int]] = {p: {} for p, _, _ in specs}
    for r in counts.groupBy("pack_id", "size").agg(F.sum("n").alias("n")).collect():  # at most packs x capacity rows
        if r["size"]:
            histograms[r["pack_id"]][r["size"]] = r["n"]
    plans = {}
    for p, _, capacity in specs:
        made = plan(histograms[p], capacity)
        runs = np.array(sorted((s << 44 | r, r, c, q) for s, r, _, c, q in made.runs), dtype=np.int64).reshape(-1, 4)
        ends = np.array(made.ends, dtype=np.int64).reshape(-1, 3)
        plans[p] = (runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3], ends[:, 0], ends[:, 2], made.used)
    return ranked.mapInArrow(_placed(plans), "pack_id int, doc_id long, chunk long, n_tokens long, container long, place long")


def p9_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Container and place of every document for every row of pack_specs."""
    specs = [(r["pack_id"], r["tokenizer"], r["capacity"]) for r in table(spark, folder, "pack_specs").select("pack_id", "tokenizer", "capacity").distinct().collect()]  # a table that does not grow
    return packed(table(spark, folder, "documents"), sorted(specs))


QUERIES = {"p9_packs": p9_packs}
ORACLE: dict[str, str] = {}
