"""Pairs of rows whose sets of three-character sequences are alike, exactly: a prefix filter over pairs of the rarest sequences.

Two alike sets share so many of the rarest sequences of both that two of these fall in one of fewer groups. All rows that share such a pair of
sequences are compared, by size, place, parity bitmap and at last the sets themselves; far fewer share two than one. Small sets meet on single
sequences. Keys of many rows are split into pairs of blocks. Texts travel, not their sequences; keys travel without their rows' bitmaps where
the shared folder is a file system, from which these are then mapped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import shared_file

#: Cells of the tables of counts (fixed size, whatever the corpus).
DF_BITS = 17
#: Rarest sequences that two alike rows share at least, of which two fall in one of SHARED - 1 groups: pairs within a group are the keys.
SHARED = 32
#: Rows of a key from which on all its pairs are compared by a product of matrices, and rows of a factor.
DENSE, TILE = 128, 1024
#: Keys in a part, rows of a key in a block, bits of the parity bitmap, and pairs compared at a time.
PART, BLOCK, BITS, AT_ONCE = 1_000_000, 20_000, 512, 1 << 20


def shingles(text: str) -> np.ndarray:
    """Distinct three-character sequences as sorted integers."""
    if len(text) < 3:
        return np.empty(0, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: list[str], rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash of 52 bits) of the distinct three-character sequences of up to 4096 texts, sorted; the hash's cell is replaced by its rank."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), length)
    with np.errstate(over="ignore"):
        h = _mix((points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:])
    keep = owner[:-2] == owner[2:]
    h = h[keep] >> np.uint64(12)
    if rank is not None:
        h = (rank[_cell(h)] << np.uint64(52 - DF_BITS)) | (h & np.uint64((1 << (52 - DF_BITS)) - 1))
    both = np.sort((owner[:-2][keep] << np.uint64(52)) | h)
    if len(both):
        both = both[np.r_[True, both[1:] != both[:-1]]]
    return (both >> np.uint64(52)).astype(np.int64), both & np.uint64((1 << 52) - 1)


def _cell(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(52 - DF_BITS)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, size):
            yield whole.slice(start, size)


def _df_counts(threshold: float):  # noqa: ANN202
    """(cell, n) of a task's rows; in the cell after the last, the keys to expect of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 << DF_BITS) + 1, dtype=np.int64)
        for b in _slices(batches, 2000):
            owner, token = tokens(b["text"].to_pylist())
            counts[:-1] += np.bincount(_cell(token), minlength=1 << DF_BITS)
            prefix = (1 - threshold) * np.bincount(owner) + SHARED
            counts[-1] += int((prefix * (prefix - 1) / 2 / (SHARED - 1)).sum())
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["cell", "n"])

    return run


def _bitmaps(owner: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
    """Parity bitmaps: each sequence flips one bit of its row, so unlike bits of two rows are sequences of one of them only."""
    bit = (token & np.uint64(BITS - 1)).astype(np.int64)  # tokens are hashes
    return np.packbits((np.bincount(owner * BITS + bit, minlength=rows * BITS) & 1).astype(np.uint8).reshape(rows, BITS), axis=1)


class _Order:
    """One order of sequences for all rows, rare ones first: ranks of the cells, and their counts by rank."""

    def __init__(self, counts: np.ndarray) -> None:
        by = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(counts), dtype=np.uint64)
        self.rank[by] = np.arange(len(counts), dtype=np.uint64)
        self.counts = counts[by]


def _least(threshold: float) -> int:
    """Size from which on two alike rows share SHARED sequences."""
    return int(np.ceil(SHARED * (1 + threshold) / (2 * threshold)))


def _prefixes(counts: _Order, b: pa.RecordBatch, threshold: float, above: int = -1) -> tuple[np.ndarray, ...]:
    """(row, place, key) of each row, (owner, token) of all its sequences, and sizes.

    Of two alike rows of `_least` sequences or more, the first SHARED common sequences are among the rarest of both: a row's prefix has SHARED - 1 more
    of them than one common sequence would need. Sequences fall in SHARED - 1 groups, so two of the common ones are in one group, and pairs
    of a group are the keys, a section's own. Rows that are, or may be alike to, smaller ones have single sequences as keys. place: of the
    later sequence, less SHARED - 1, so that it bounds what two rows have in common as that of a first common sequence does. Keys whose sequences' cells
    say that they have no more than `above` rows are left out.
    """
    owner, token = tokens(b["text"].to_pylist(), counts.rank)
    sec = b["sec"].to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = np.bincount(owner, minlength=b.num_rows)
    place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    last = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    least, extra = _least(threshold), SHARED - 1
    full = counts.counts[_cell(token)] > above
    single = full & (place <= last[owner]) & (sizes[owner] <= least / threshold + 1)
    among = np.flatnonzero(full & (place <= last[owner] + extra) & (sizes[owner] >= least))
    group = owner[among] * extra + ((token[among] >> np.uint64(9)) & np.uint64((1 << 26) - 1)).astype(np.int64) % extra
    order = np.argsort(group.astype(np.uint16) if b.num_rows * extra < 1 << 16 else group, kind="stable")
    among, group = among[order], group[order]
    with np.errstate(over="ignore"):
        own = _mix(token ^ sec[owner])
        rows, places, keys = [owner[single]], [place[single]], [own[single]]
        for d in range(1, len(among)):
            at = np.flatnonzero(group[d:] == group[:-d])
            if not len(at):
                break
            x, y = among[at], among[at + d]
            rows.append(owner[y])
            places.append(np.maximum(place[y] - extra, 0))
            keys.append(_mix(own[x] + token[y]))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(keys), owner, token, sizes


def _crowded(counts, block: int, threshold: float):  # noqa: ANN001, ANN202
    """(key, n) of keys in cells so full that they may need blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 500):
            _, _, key, *_ = _prefixes(counts.value, b, threshold, block)
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _parted(b: pa.RecordBatch, row: np.ndarray, key: np.ndarray, place: np.ndarray, parts: int, sizes: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """Keys and places of each row by part, with what thins out its pairs."""
    with np.errstate(over="ignore"):
        part = (key % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((part, row))
    row, place, key, part = row[order], place[order], key[order], part[order]
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(row) else np.empty(0, dtype=np.int64)
    ends, at = pa.array(np.r_[head, len(row)].astype(np.int32)), pa.array(row[head])
    width = pa.array(np.arange(0, (len(head) + 1) * (BITS // 8), BITS // 8, dtype=np.int32))
    bitmaps = pa.Array.from_buffers(pa.binary(), len(head), [None, width.buffers()[1], pa.py_buffer(bits[row[head]].tobytes())])
    short = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)  # equal halves of unlike keys bring some more pairs to compare
    return pa.RecordBatch.from_arrays(
        [pa.array(part[head]), b["node"].take(at), b["comp"].take(at), b["kind"].take(at), pa.array(sizes[row[head]].astype(np.int32)), bitmaps, pa.ListArray.from_arrays(ends, pa.array(short)), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int16 if place.max(initial=0) < 32768 else np.int32)).cast(pa.int32()))],
        ["part", "node", "comp", "kind", "size", "bits", "keys", "places"],
    )


POSTED = "part long, node long, comp long, kind long, size int, bits binary, keys array<int>, places array<int>"


#: A row of the shared files: what thins out its pairs.
HELD = np.dtype([("node", "<i8"), ("comp", "<i8"), ("kind", "<i8"), ("size", "<i4"), ("single", "<i4"), ("bits", "<u8", BITS // 64)])
#: A key of a row in a posting: row in its batch, equal halves of unlike keys bring some more pairs to compare.
KEY = np.dtype([("key", "<i4"), ("row", "<u2"), ("place", "u1")])
FILED = "part long, file string, base long, keys binary"


def _spread(b: pa.RecordBatch, row: np.ndarray, place: np.ndarray, key: np.ndarray, hot: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place, key), where a crowded key goes to all pairs of its blocks that the row's own block is in."""
    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    n = np.where(hot[at] == key, blocks[at], 1)
    with np.errstate(over="ignore"):
        own = (_mix(b["node"].to_numpy().view(np.uint64))[row] % n.astype(np.uint64)).astype(np.int64)
        times = np.maximum(n - 1, 1)
        at = np.repeat(np.arange(len(key)), times)
        other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        other += (other >= own[at]) & (n[at] > 1)
        pair = np.minimum(own[at], other) * n[at] + np.maximum(own[at], other)
        return row[at], place[at], np.where(n[at] > 1, _mix(key[at] ^ _mix(pair.astype(np.uint64))), key[at])


def _filed(b: pa.RecordBatch, row: np.ndarray, key: np.ndarray, place: np.ndarray, parts: int, sizes: np.ndarray, bits: np.ndarray, path: str, base: int) -> pa.RecordBatch:
    """The rows of a batch go to the end of a file, their keys to the parts."""
    held = np.zeros(b.num_rows, dtype=HELD)
    held["node"], held["comp"], held["size"] = b["node"].to_numpy(), b["comp"].to_numpy(), sizes
    held["kind"], held["single"] = b["kind"].fill_null(0).to_numpy(), b["kind"].is_valid().to_numpy(zero_copy_only=False)
    held["bits"] = bits.view(np.uint64)
    with open(path, "ab") as f:
        f.write(held.tobytes())
    with np.errstate(over="ignore"):
        part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    posted = np.empty(len(key), dtype=KEY)
    posted["key"], posted["row"], posted["place"] = (key[order] >> np.uint64(32)).astype(np.uint32).view(np.int32), row[order], np.minimum(place[order], 255)  # a smaller place only lets more pairs through
    part = part[order]
    head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, dtype=np.int64)
    ends = pa.array((np.r_[head, len(part)] * KEY.itemsize).astype(np.int32))
    blobs = pa.Array.from_buffers(pa.binary(), len(head), [None, ends.buffers()[1], pa.py_buffer(posted.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[head]), pa.array([path] * len(head), pa.string()), pa.array(np.full(len(head), base)), blobs], ["part", "file", "base", "keys"])


def _filed_links(links: np.ndarray, parts: int) -> pa.RecordBatch:
    """Links (a, b) that hold already, as postings without a file."""
    part = links[:, 0] % parts
    links = links[order := np.argsort(part, kind="stable")].astype(np.int64)
    part = part[order]
    head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    blobs = pa.array([x.tobytes() for x in np.split(links, head[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(part[head]), pa.array([""] * len(head), pa.string()), pa.array(np.zeros(len(head), dtype=np.int64)), blobs], ["part", "file", "base", "keys"])


def _prefix_postings(counts, crowded, parts: int, threshold: float, folder: str | None):  # noqa: ANN001, ANN202
    """Each row's keys by part; its bitmap goes along, or to a file of the shared folder where that can be mapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, blocks = crowded.value
        path, base = f"{folder}/{uuid.uuid4().hex}", 0
        for b in _slices(batches, 2000):
            row, place, key, owner, token, sizes = _prefixes(counts.value, b, threshold)
            if len(hot):
                row, place, key = _spread(b, row, place, key, hot, blocks)
            bits = _bitmaps(owner, token, b.num_rows)
            if folder is None:
                yield _parted(b, row, key, place, parts, sizes, bits)
            else:
                yield _filed(b, row, key, place, parts, sizes, bits, path, base)
                base += b.num_rows

    return run


class _Part:
    """The rows of a part and the tests that thin out their pairs."""

    def __init__(self, t: pa.Table, threshold: float) -> None:
        t = t.combine_chunks()
        self.threshold = threshold
        self.node, self.comp, self.size = t["node"].to_numpy(), t["comp"].to_numpy(), t["size"].to_numpy().astype(np.int64)
        self.single = t["kind"].is_valid().to_numpy()
        self.kind = t["kind"].fill_null(0).to_numpy()
        self.bits = np.frombuffer(b"".join(t["bits"].to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
        lists = t["keys"].combine_chunks()
        self.key = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        self.row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.place = pc.list_flatten(t["places"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        self.found = [np.empty((0, 2), dtype=np.int64)]

    @classmethod
    def of(cls, t: pa.Table, threshold: float) -> _Part:
        """The part from its postings, whose rows may be in files; postings without keys, or without a file, are links that hold already."""
        if "file" not in t.column_names:
            linked = pc.equal(pc.list_value_length(t["keys"]), 0)
            links = t.filter(linked)
            p = cls(t.filter(pc.invert(linked)), threshold)
            if links.num_rows:
                p.found.append(np.column_stack([links["node"].to_numpy(), links["comp"].to_numpy()]))
            return p
        p = cls.__new__(cls)
        p.threshold, p.found = threshold, [np.empty((0, 2), dtype=np.int64)]
        linked = pc.equal(t["file"], "")
        p.found += [np.frombuffer(blob, dtype=np.int64).reshape(-1, 2) for blob in t.filter(linked)["keys"].to_pylist()]
        t = t.filter(pc.invert(linked))
        by: dict[str, list[np.ndarray]] = {}
        for file, base, blob in zip(t["file"].to_pylist(), t["base"].to_pylist(), t["keys"].to_pylist()):
            got = np.frombuffer(blob, dtype=KEY)
            by.setdefault(file, []).append(np.column_stack([got["row"] + np.int64(base), got["key"], got["place"]]))
        held, entries, first = [np.empty(0, dtype=HELD)], [np.empty((0, 3), dtype=np.int64)], 0
        for file, some in by.items():
            some = np.concatenate(some)  # noqa: PLW2901
            rows, some[:, 0] = np.unique(some[:, 0], return_inverse=True)
            some[:, 0] += first
            first += len(rows)
            held.append(np.memmap(file, dtype=HELD, mode="r")[rows])
            entries.append(some)
        h, entries = np.concatenate(held), np.concatenate(entries)
        p.node, p.comp, p.kind, p.size, p.single, p.bits = h["node"].copy(), h["comp"].copy(), h["kind"].copy(), h["size"].astype(np.int64), h["single"] != 0, h["bits"].copy()
        p.row, p.key, p.place = entries[:, 0].copy(), entries[:, 1].astype(np.int32), entries[:, 2].copy()
        return p

    def ranges(self, x: np.ndarray, begin: np.ndarray, many: np.ndarray, entries: np.ndarray) -> None:
        """Compare each entry x with entries[begin : begin + many], so many pairs at a time, and keep the pairs that may be alike."""
        size = self.size[self.row].astype(np.float32)
        rest = size - self.place.astype(np.float32)  # sequences of a row from an entry on
        size_y, rest_y = size[entries], rest[entries]
        share = np.float32(self.threshold / (1 + self.threshold))  # of both sizes that alike rows have in common at least
        done, i, split = np.cumsum(many), 0, 0  # split: partners of entry i that are compared already
        while i < len(x):
            base = (done[i - 1] if i else 0) + split
            last = int(np.searchsorted(done, base + AT_ONCE, side="right"))
            if last <= i:  # the partners of one entry in pieces
                some, n, first = x[i : i + 1], np.array([AT_ONCE]), begin[i : i + 1] + split
                split += AT_ONCE
            else:
                some, n, first = x[i:last], many[i:last].copy(), begin[i:last].copy()
                n[0], first[0] = n[0] - split, first[0] + split
                i, split = last, 0
            upto = np.cumsum(n)
            y = np.repeat(first - (upto - n), n) + np.arange(upto[-1])
            need = share * (np.repeat(size[some], n) + size_y[y]) - np.float32(1e-3)
            ok = np.flatnonzero((np.repeat(rest[some], n) >= need) & (rest_y[y] >= need))
            if len(ok):
                self.compare(self.row[some[np.searchsorted(upto, ok, side="right")]], self.row[entries[y[ok]]])

    def _signs(self, rows: np.ndarray, first: bool) -> np.ndarray:
        """Bitmaps as rows of 1 and -1, followed by sizes so that a product holds the equal bits, less the unlike, and what the sizes allow for."""
        out = np.ones((len(rows), BITS + 2), dtype=np.float32)
        out[:, :BITS] -= 2 * np.unpackbits(self.bits[rows].view(np.uint8), axis=1)
        out[:, BITS + (not first)] = 2 * (1 - 2 * self.threshold / (1 + self.threshold)) * self.size[rows]
        return out

    def block(self, rows: np.ndarray) -> None:
        """Compare all rows, sorted by size, with each other: a product of matrices counts the unlike bits of all pairs."""
        for i in range(0, len(rows), TILE):
            left = self._signs(some := rows[i : i + TILE], True)
            for j in range(i, len(rows), TILE):
                others = rows[j : j + TILE]
                if self.size[others[0]] * self.threshold > self.size[some[-1]] + 1e-6:
                    break
                near = np.flatnonzero(left @ self._signs(others, False).T >= BITS - 0.25)
                a, b = near // len(others), near % len(others)
                ahead = (a < b) | (i < j)
                self.compare(some[a[ahead]], others[b[ahead]])

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Keep the pairs of rows that may be alike by group, size and bitmap."""
        both = self.size[a] + self.size[b]
        least = np.ceil(self.threshold / (1 + self.threshold) * both - 1e-9)
        ok = np.flatnonzero((self.comp[a] != self.comp[b]) & (np.minimum(self.size[a], self.size[b]) >= least))
        a, b, both, least = a[ok], b[ok], both[ok], least[ok]
        ok = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64) <= both - 2 * least
        ok &= ~(self.single[a] & self.single[b] & (self.kind[a] == self.kind[b]))
        if ok.any():
            self.found.append(np.unique(np.sort(np.column_stack([self.node[a[ok]], self.node[b[ok]]]), axis=1), axis=0))

    def pairs(self) -> pa.Table:
        out = np.unique(np.concatenate(self.found), axis=0)
        return pa.table({"a": pa.array(np.ascontiguousarray(out[:, 0])), "b": pa.array(np.ascontiguousarray(out[:, 1]))})


def _meet(threshold: float):  # noqa: ANN202
    """Pairs of a part that share a rare sequence, are of several groups and may be alike by size, place and bitmap.

    A row meets the rows of its sequence that are no larger, and only those of sizes, and with the sequence at such a place, that allow for the
    similarity. Where few rows of a sequence are outside one group, they meet the rows of other groups instead.
    """
    share = 1 - 2 * threshold / (1 + threshold)  # of a row's sequences that it can share first with a larger one

    def run(t: pa.Table) -> pa.Table:
        p = _Part.of(t, threshold)
        n = len(p.key)
        size = p.size[p.row]
        wide = p.key.astype(np.int64) << 32
        order = np.argsort(wide | size)
        key = p.key[order]
        fresh = np.r_[True, key[1:] != key[:-1], True] if n else np.zeros(1, dtype=bool)
        order = order[~(fresh[:-1] & fresh[1:])]  # keys of one row are no meeting
        n, key = len(order), p.key[order]
        fresh = np.r_[True, key[1:] != key[:-1]] if n else np.empty(0, dtype=bool)
        runs = np.cumsum(fresh) - 1
        size, place = size[order], p.place[order]
        span = np.int64(size.max(initial=0) + 2)
        held = np.flatnonzero(place <= share * size + 1e-9)  # entries that a larger row may share first
        sorted_held = runs[held] * span + size[held]
        top = np.minimum(size, np.floor((size - place) * (1 + threshold) / threshold + 1e-9) - size).astype(np.int64)
        low = np.ceil(threshold * size - 1e-9).astype(np.int64)
        begin = np.searchsorted(sorted_held, runs * span + np.minimum(low, span - 1), side="left")
        end = np.searchsorted(sorted_held, runs * span + np.clip(top, -1, span - 1), side="right")
        many = np.where(top >= low, np.maximum(end - begin, 0), 0)
        # the other way: by group
        _, rank = np.unique(p.comp, return_inverse=True)
        by_comp = order[np.argsort((wide | rank[p.row])[order])]
        comp = p.comp[p.row[by_comp]]
        change = fresh | np.r_[True, comp[1:] != comp[:-1]] if n else fresh
        own_end = np.r_[np.flatnonzero(change), n][np.cumsum(change)] if n else change
        run_end = np.r_[np.flatnonzero(fresh), n][np.cumsum(fresh)] if n else change
        other = run_end - own_end
        fewer = np.bincount(runs, weights=other) < np.bincount(runs, weights=many) if n else np.empty(0, dtype=bool)
        head = np.r_[np.flatnonzero(fresh), n]
        rows = np.diff(head)
        dense = ~fewer & (rows >= DENSE) & (np.bincount(runs, weights=many) * 20 > rows.astype(np.float64) ** 2) if n else fewer
        for r in np.flatnonzero(dense):
            p.block(p.row[order[head[r] : head[r + 1]]])
        x = np.flatnonzero(~(fewer | dense)[runs] & (many > 0)) if n else np.empty(0, dtype=np.int64)
        p.ranges(order[x], begin[x], many[x], order[held])
        x = np.flatnonzero(fewer[runs] & (other > 0)) if n else x
        p.ranges(by_comp[x], own_end[x], other[x], by_comp)
        return p.pairs()

    return run


def _cells(df: DataFrame) -> np.ndarray:
    """Sums of (cell, n) as a table of fixed size, after its cells the keys to expect."""
    counts = np.zeros((1 << DF_BITS) + 1)
    got = df.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** DF_BITS + 1 rows
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return counts


def missed_pairs(nodes: DataFrame, *, threshold: float, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Pairs (a, b), a < b, distinct, among which is every alike pair of different groups; nodes: (node, sec, comp, kind, text).

    kind: the formatting class if the node has one only, else null; nodes of one class are no links.
    """
    spark = nodes.sparkSession
    sc = spark.sparkContext
    counts = _cells(nodes.select("text").mapInArrow(_df_counts(threshold), "cell long, n long"))
    parts, counts = max(1, int(counts[-1] // part)), counts[:-1]
    held = sc.broadcast(_Order(counts))
    hot = {}
    if counts.max(initial=0) > block:
        # no more keys than rows' keys divided by the block
        full = nodes.mapInArrow(_crowded(held, block, threshold), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > block)
        hot = {r["key"]: max(2, -(-r["n"] // block)) for r in full.toLocalIterator()}
    keys = np.sort(np.array(list(hot), dtype=np.int64).view(np.uint64))
    blocks = np.array([hot[int(k)] for k in keys.view(np.int64)], dtype=np.int64)
    folder = shared_file(spark, "alike-rows", released=True)
    posted = nodes.mapInArrow(_prefix_postings(held, sc.broadcast((keys, blocks)), parts, threshold, folder), FILED if folder else POSTED)
    # a task for each part, however few bytes it has: its time is in comparing
    return posted.repartition(min(parts, 10_000), "part").groupBy("part").applyInArrow(_meet(threshold), "a long, b long").distinct()


def _jaccard(threshold: float):  # noqa: ANN202
    """The pairs whose texts (ta, tb) have alike sets, with the similarity of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [(shingles(x), shingles(y)) for x, y in zip(b["ta"].to_pylist(), b["tb"].to_pylist())]
            union = np.array([len(np.union1d(x, y)) for x, y in both], dtype=np.float64)
            shared = np.array([len(x) + len(y) for x, y in both], dtype=np.float64) - union
            found = shared / np.maximum(union, 1)
            ok = pa.array(found >= threshold)
            yield pa.RecordBatch.from_arrays([b["a"].filter(ok), b["b"].filter(ok), pa.array(found).filter(ok)], ["a", "b", "jaccard"])

    return run


def alike_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of one section whose sets reach a Jaccard similarity; nodes: (node long, section, text)."""
    keyed = nodes.select("node", F.xxhash64("section").alias("sec"), F.col("node").alias("comp"), F.lit(None).cast("long").alias("kind"), "text")
    pairs = missed_pairs(keyed, threshold=threshold)
    # texts are wide and their files small: joined by sorting, not sent to the driver
    side = nodes.select("node", "section", "text").hint("merge")
    met = pairs.join(side.withColumnsRenamed({"node": "a", "section": "sa", "text": "ta"}), "a").join(side.withColumnsRenamed({"node": "b", "section": "sb", "text": "tb"}), "b").filter("sa = sb")
    return met.select("a", "b", "ta", "tb").mapInArrow(_jaccard(threshold), "a long, b long, jaccard double")
