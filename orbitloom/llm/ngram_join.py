"""Operator 1: n-gram Jaccard join by an R-tree over count vectors, tiled by rare shingles.

A document's shingles are hashed into groups; the counts of the groups are its point. The overlap of two sets is at most the
sum of the smaller of their two counts over all groups, so a pair (or two nodes of a tree with largest counts) whose sum
cannot reach the overlap that the threshold needs is dropped. Four levels use that:

1. Root level (tiles). Shingles are ordered by how often they occur (counted for all rows in a table of fixed size, whose
   collisions only spoil the order, never the result), rare ones first. A set of n shingles that must share m with any
   partner shares one of its first n - m + 1 with it; each of those is a tile. What many documents repeat comes last in
   that order and gives no tiles. Sizes are cut into bands as wide as the threshold, so linked sets are in the same or in
   neighbouring bands; where a tile's rows are all of different bands, those without a neighbour go.
2. Tiles of more than HUB_ABOVE members: each set is tried against the hub (smallest set_id) with which it shares most
   tiles, if their points allow it. So a large group of near copies is mostly one component before pairs are looked for.
3. Tiles with members of several components get an R-tree, packed by size and leading counts: pairs of nodes are opened
   only if the summed minima of COARSE groups can reach the overlap and the nodes hold several components. A first descent
   carries the COARSE counts alone and leaves the members that have any partner; most share their tile by chance and go.
   The others bring their whole points: pairs that survive a second descent are bounded again over MIDDLE and FINE groups, likely
   ones first, until they are a spanning forest of each tile's components: a group gives about as many pairs as it has members.
4. Surviving pairs are verified on whole sets of 64-bit shingle hashes. Where one fails, its tiles are searched again
   without it, until no pair fails; then no link can be missing between two components.

Equal sets are one class from the start, so copies are never paired. A tile of many members is taken in pairs of blocks of
at most BLOCK members; blocks of one component are not paired with each other. Cases: null or empty text and text without
words have no shingles, are linked with nothing and are their own component; repeated rows fall into one class; a null doc_id
is ignored when the smallest id of a component is taken (null if all are); other columns of the input are not looked at;
an empty table gives an empty table. Hashes of 64 bits stand for shingles and for sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Groups of a point, in the tree, for a bound on its pairs and for the last bound before verification.
COARSE, MIDDLE, FINE = 64, 1 << 10, 1 << 14
#: Counters of shingle frequencies, in two rows, and how many are shipped at a time.
COUNTERS, SLICE = 1 << 18, 4096
#: Members of an R-tree leaf, of a block of a tile, and of one side of a descent.
LEAF, BLOCK, SIDE = 16, 1024, 256
#: Tiles with more members get hubs first.
HUB_ABOVE = 64
#: Bytes of packed points, or of tokens, that one numpy step takes.
POINT_BYTES, TOKENS = 1 << 19, 1 << 19
#: Rows of coarse counts that one numpy step takes.
COUNT_ROWS = 1 << 14


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n shingles with any set that is linked to it."""
    return -(-percent * n // 100)


def _runs(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element between bounds: its list, and its place there."""
    size = np.diff(bounds)
    return np.repeat(np.arange(len(size)), size), np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], size)


def _ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ids of sets: a hash of their shingles' sum."""
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix(values), dtype=np.uint64)))
    return common.mix(running[bounds[1:]] - running[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def packed_points(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Fine points of sets: the ascending groups of their shingles as differences, a byte each (255 adds on to the next)."""
    of, _ = _runs(bounds)
    group = ((values >> np.uint64(20)) & np.uint64(FINE - 1)).astype(np.int64)
    group = np.sort(of * FINE + group) - of * FINE
    step = np.diff(group, prepend=0)
    heads = bounds[:-1][np.diff(bounds) > 0]
    step[heads] = group[heads]
    ends = np.cumsum(step // 255 + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = step % 255
    cuts = np.concatenate(([0], ends))[bounds]
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def packed_counts(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Counts of COARSE groups of sets, a byte each after two bytes of the unit that they are rounded up to (1 unless a count is over 255)."""
    of, _ = _runs(bounds)
    counts = np.bincount(of * COARSE + ((values >> np.uint64(20)) & np.uint64(COARSE - 1)).astype(np.int64), minlength=(len(bounds) - 1) * COARSE).reshape(-1, COARSE)
    unit = np.maximum(-(-counts.max(1, initial=0) // 255), 1)
    raw = np.concatenate([unit.astype("<u2").view(np.uint8).reshape(-1, 2), (-(-counts // unit[:, None])).astype(np.uint8)], axis=1)
    return [row.tobytes() for row in raw]


def _minima(counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Summed minima of pairs of rows of counts."""
    most, step = np.empty(len(i), np.int64), (1 << 20) // counts.shape[1]
    for s in range(0, len(i), step):
        most[s : s + step] = np.minimum(counts[i[s : s + step]], counts[j[s : s + step]]).sum(1, dtype=np.int64)
    return most


class Counts:
    """Points known by their size and the counts of COARSE groups, rounded up, so that bounds stay bounds."""

    def __init__(self, column: pa.Array, size: np.ndarray):
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 + COARSE)
        unit = raw[:, :2].copy().view("<u2").astype(np.int32)
        self.coarse, self.size = raw[:, 2:].astype(np.int32) * unit, size

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Summed minima over COARSE groups of pairs of points."""
        return _minima(self.coarse, i, j)

    def fits(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Coarse bound on pairs of points."""
        return (100 + percent) * self.shared(i, j) >= percent * (self.size[i] + self.size[j])


class Points(Counts):
    """Points unpacked: counts of COARSE groups, and FINE groups as sorted tokens (a group's repeats are told apart)."""

    def __init__(self, column: pa.Array):
        data, offsets = common.utf8(column)
        running = np.cumsum(data, dtype=np.int64)
        at = np.flatnonzero(data != 255)
        self.bounds = np.searchsorted(at, offsets)
        self.of, _ = _runs(self.bounds)
        before = np.concatenate(([0], running))[offsets[:-1]]
        group = running[at] - before[self.of]
        fresh = np.ones(len(group), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (self.of[1:] != self.of[:-1])
        heads = np.flatnonzero(fresh)
        repeat = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
        self.token = group << 20 | repeat
        self.size = np.diff(self.bounds)
        middle = np.bincount(self.of * MIDDLE + group % MIDDLE, minlength=len(self.size) * MIDDLE).reshape(-1, MIDDLE)
        self.middle = middle.astype(np.min_scalar_type(int(middle.max(initial=0))))
        self.coarse = middle.reshape(-1, MIDDLE // COARSE, COARSE).sum(1).astype(np.int32)

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Summed minima over MIDDLE groups of pairs of points."""
        return _minima(self.middle, i, j)

    def _keys(self, which: np.ndarray) -> np.ndarray:
        size = self.size[which]
        pair = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(pair)) + np.repeat(self.bounds[which] - np.cumsum(size) + size, size)
        return pair << 35 | self.token[at]

    def fine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Summed minima over FINE groups of pairs of points."""
        most = np.zeros(len(i), np.int64)
        ends = np.cumsum(self.size[i] + self.size[j])
        lo = 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS, "right")))
            keys = np.sort(np.concatenate([self._keys(i[lo:hi]), self._keys(j[lo:hi])]), kind="stable")
            most[lo:hi] = np.bincount(keys[1:][keys[1:] == keys[:-1]] >> 35, minlength=hi - lo)
            lo = hi
        return most


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, data, offsets in common.steps(batches):
        words, _, _, first = common.word_hashes(data, offsets)
        yield part, *common.shingles(words, first, k)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_id"), F.col("text").cast("string").alias("text"))


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each shingle."""
    return (values & np.uint64(COUNTERS - 1)).astype(np.int64), COUNTERS + ((values >> np.uint64(40)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _slices(total: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for s in range(0, len(total), SLICE):
        part = total[s : s + SLICE]
        if part.any():
            yield s // SLICE, part.tobytes()


def rows_and_counters(docs: DataFrame, k: int) -> DataFrame:
    """One pass: doc_id, row_id, number of shingles, id of the set (null if empty), its point and its coarse counts, with slice -1; and slices of each task's counters."""

    def run(batches):
        total = np.zeros(2 * COUNTERS, np.int32)
        for part, values, bounds in _sets(batches, k):
            for place in _places(values):
                total += np.bincount(place, minlength=2 * COUNTERS).astype(np.int32) if len(place) > COUNTERS // 4 else 0
                if len(place) <= COUNTERS // 4:
                    np.add.at(total, place, 1)
            size = np.diff(bounds)
            ids = pa.array(_ids(values, bounds), mask=size == 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), -1, np.int32)), part.column("doc_id"), part.column("row_id"), pa.array(size.astype(np.int64)), ids, pa.array(packed_points(values, bounds), pa.binary()), pa.array(packed_counts(values, bounds), pa.binary())], names)
        for at, raw in _slices(total):
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), none, none, none, none, pa.array([raw], pa.binary()), pa.nulls(1, pa.binary())], names)

    names = ["slice", "doc_id", "row_id", "n_shingles", "set_id", "point", "counts"]
    return _texts(docs).mapInArrow(run, "slice int, doc_id long, row_id long, n_shingles long, set_id long, point binary, counts binary")


def frequencies(counted: DataFrame) -> np.ndarray:
    """The counters summed over all tasks: a table of fixed size; sums run as batches pass, first per reader, then per slice."""

    def add(kind):
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, raw in zip(batch.column("slice").to_pylist(), batch.column("point"), strict=True):
                    own = np.frombuffer(raw.as_buffer(), kind)
                    sums[at] = sums[at] + own if at in sums else own.astype(np.int64)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "point"])

        return run

    parts = counted.filter("slice >= 0").select("slice", "point").mapInArrow(add(np.int32), "slice int, point binary").repartition("slice").mapInArrow(add(np.int64), "slice int, point binary")
    out = np.zeros(2 * COUNTERS, np.int64)
    for at, raw in parts.collect():
        out[at * SLICE : (at + 1) * SLICE] = np.frombuffer(raw, np.int64)
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def bands(size: np.ndarray, percent: int) -> np.ndarray:
    """Band of each set's size, modulo 64: linked sets differ by one at most."""
    return (np.log(np.maximum(size, 1)) / (np.log(100 / percent) * 1.0001 if percent < 100 else 1)).astype(np.int64) % 64


def first_shingles(values: np.ndarray, bounds: np.ndarray, percent: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tiles of sets, and the set of each: as many of their rarest shingles as a linked set cannot miss."""
    of, place = _runs(bounds)
    one, two = _places(values)
    order = np.argsort(of << 32 | np.minimum(counts[one], counts[two]).astype(np.int64), kind="stable")  # equal counts by value, as they come
    size = np.diff(bounds)
    keep = place < (size - needed(size, percent) + 1)[of]  # place counts up within each set, in any order of its shingles
    return values[order][keep], of[keep]


def rows_with_tiles(docs: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """tile, set_id and band (of the size) of every set; a set that a task has seen before gives none again."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        seen: set[int] = set()
        for _, values, bounds in _sets(batches, k):
            ids = _ids(values, bounds)
            tile, of = first_shingles(values, bounds, percent, shared.value)
            fresh = np.zeros(len(ids), bool)
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                own = int(ids[i])
                if own not in seen:
                    seen.add(own)
                    fresh[i] = True
            keep = fresh[of]
            band = bands(np.diff(bounds), percent)[of[keep]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tile[keep].view(np.int64)), pa.array(ids[of[keep]]), pa.array(band)], ["tile", "set_id", "band"])

    return _texts(docs).select("text").mapInArrow(run, "tile long, set_id long, band int")


def tile_members(tiled: DataFrame, scratch: common.Scratch) -> DataFrame:
    """tile, set_id, hub (smallest set_id) and n (members, a set counted again for each task that has it) of the tiles with several members.

    Most tiles have one row and go after a count by tile, with those whose rows are of bands that cannot be linked. Of tiles with the same members one stands for all: its members'
    ids, hashed, agree in number, ends, parity and sum."""
    seen = tiled.groupBy("tile").agg(F.count("*").alias("rows"), F.expr("bit_or(shiftleft(1L, band))").alias("seen")).filter("rows > 1")
    beside = F.expr("seen & (shiftleft(seen, 1) | shiftrightunsigned(seen, 63) | shiftrightunsigned(seen, 1) | shiftleft(seen, 63))")
    able = seen.select("tile", F.when(F.bit_count("seen") < F.col("rows"), F.lit(-1).cast("long")).otherwise(beside).alias("able")).filter("able <> 0")
    shared = common.saved(tiled.join(able, "tile").filter("shiftrightunsigned(able, band) & 1 = 1").select("tile", "set_id"), scratch)
    hashed = F.xxhash64("set_id")
    several = shared.groupBy("tile").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("last"), F.count("*").alias("n"), F.bit_xor(hashed).alias("parity"), F.sum(hashed.bitwiseAND(0xFFFFFFFF)).alias("total")).filter("hub <> last")
    once = several.groupBy("hub", "last", "n", "parity", "total").agg(F.min("tile").alias("tile"), F.count("*").alias("tiles"))
    return shared.join(once.select("tile", "hub", "n", "tiles"), "tile")


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose points allow a link, with a row that holds either set."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = np.arange(batch.num_rows)
                both = Points(pa.concat_arrays([batch.column("point_a"), batch.column("point_b")]))
                keep = (100 + percent) * both.fine(n, n + len(n)) >= percent * (both.size[: len(n)] + both.size[len(n) :])
                yield batch.select(["a", "b", "row_a", "row_b"]).filter(pa.array(keep))

    side = {c: classes.select(F.col("set_id").alias(c), F.col("point").alias(f"point_{c}"), F.col("row_id").alias(f"row_{c}")) for c in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").mapInArrow(run, "a long, b long, row_a long, row_b long")


def _located(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with a row that holds either set."""
    side = {c: classes.select(F.col("set_id").alias(c), F.col("row_id").alias(f"row_{c}")) for c in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "row_a", "row_b")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """Pairs whose whole sets are similar enough."""

    def sets_of(batches):
        for _, values, bounds in _sets(batches, k):
            at = np.flatnonzero(np.diff(bounds))
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(_ids(values, bounds)[at]), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[at].tolist(), bounds[at + 1].tolist(), strict=True)], pa.binary())], ["set_id", "values"])

    def compare(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("values_a"), batch.column("values_b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = common.saved(pairs.select(F.explode(F.array("row_a", "row_b")).alias("row_id")).distinct(), scratch)
    sets = _texts(docs).join(wanted, "row_id", "left_semi").select("text").mapInArrow(sets_of, "set_id long, values binary").dropDuplicates(["set_id"])
    with_a = pairs.select("a", "b").join(sets.select(F.col("set_id").alias("a"), F.col("values").alias("values_a")), "a")
    both = with_a.join(sets.select(F.col("set_id").alias("b"), F.col("values").alias("values_b")), "b")
    return both.mapInArrow(compare, "a long, b long")


def components(links: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """set_id and the smallest set_id reachable from it, for every end of a link; rounds of joins with pointer jumping.

    Each round takes the least label over a node's links, then the label of that label; the work of a round is in
    proportion to the links whose ends still have different labels."""
    edges = common.saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), scratch)
    labels = common.saved(edges.groupBy(F.col("a").alias("set_id")).agg(F.least("set_id", F.min("b")).alias("label")), scratch)
    while True:
        near = edges.join(labels.select(F.col("set_id").alias("b"), "label"), "b").groupBy(F.col("a").alias("set_id")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "set_id").select("set_id", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("set_id").alias("new"), F.col("label").alias("up"))
        fresh = common.saved(stepped.join(up, "new", "left").select("set_id", F.least("new", F.coalesce("up", "new")).alias("label"), (F.least("new", F.coalesce("up", "new")) < F.col("label")).alias("moved")), scratch)
        labels = fresh.select("set_id", "label")
        if not fresh.filter("moved").limit(1).count():
            return labels


def _labelled(df: DataFrame, labels: list[DataFrame], column: str, name: str = "label") -> DataFrame:
    """df with the component so far of a column of set ids: each table of labels maps what the one before gave; without a label, itself."""
    df = df.withColumn(name, F.col(column))
    for table in labels:
        known = table.select(F.col("set_id").alias(name), F.col("label").alias("known"))
        df = df.join(known, name, "left").withColumn(name, F.coalesce("known", name)).drop("known")
    return df


def _merged(links: DataFrame, labels: list[DataFrame], scratch: common.Scratch) -> list[DataFrame]:
    """One table of the labels after further links; only links between components are looked at. Rows meet this one table, however many rounds there were."""
    ends = _labelled(_labelled(links, labels, "a", "label_a"), labels, "b", "label_b").filter("label_a <> label_b")
    fresh = components(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), scratch)
    if not labels:
        return [fresh]
    (known,) = labels
    moved = _labelled(known.select("set_id", F.col("label").alias("was")), [fresh], "was").select("set_id", "label")
    return [common.saved(moved.unionByName(fresh.join(known, "set_id", "left_anti").select("set_id", "label")), scratch)]


class Tree:
    """R-tree by packing: points in the order of size and leading counts, cut into leaves; nodes hold largest counts, least sizes and their labels' range."""

    def __init__(self, points: Points, which: np.ndarray, label: np.ndarray):
        self.at = which[np.lexsort((*points.coarse[which, :4].T, points.size[which]))]
        self.levels = [(points.coarse[self.at], points.size[self.at], label[self.at], label[self.at])]
        while len(self.levels[-1][0]) > 1:
            most, least, low, high = self.levels[-1]
            cuts = np.arange(0, len(most), LEAF)
            self.levels.append((np.maximum.reduceat(most, cuts), np.minimum.reduceat(least, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))


def tree_pairs(one: Tree, two: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of different labels whose summed coordinate minima can reach the needed overlap, found by descending both trees.

    Linked sets of sizes m and n overlap in at least percent/(100+percent) * (m+n)."""
    trees, at = (one, two), [len(one.levels) - 1, len(two.levels) - 1]
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        a, b = trees[0].levels[at[0]], trees[1].levels[at[1]]
        open_ = ~((a[2][i] == a[3][i]) & (b[2][j] == b[3][j]) & (a[2][i] == b[2][j]))
        i, j = i[open_], j[open_]
        most = np.empty(len(i), np.int64)
        for s in range(0, len(i), 1 << 14):
            x, y = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            most[s : s + (1 << 14)] = np.minimum(a[0][x], b[0][y]).sum(1, dtype=np.int64)
        keep = (100 + percent) * most >= percent * (a[1][i] + b[1][j])
        i, j = i[keep], j[keep]
        if at == [0, 0] or not len(i):
            return one.at[i], two.at[j]
        side = 0 if at[0] >= at[1] else 1
        parent, other = (i, j) if side == 0 else (j, i)
        child = (parent[:, None] * LEAF + np.arange(LEAF)).ravel()
        other = np.repeat(other, LEAF)
        at[side] -= 1
        there = child < len(trees[side].levels[at[side]][0])
        child, other = child[there], other[there]
        i, j = (child, other) if side == 0 else (other, child)


def _joined(part: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The part of each node after parts one and two are joined, pair by pair."""
    above = np.arange(len(part))
    for a, b in zip(one.tolist(), two.tolist(), strict=True):
        while above[a] != a:
            a = above[a]
        while above[b] != b:
            b = above[b]
        above[max(a, b)] = min(a, b)
    while (above[above] != above).any():
        above = above[above]
    return above[part]


def _leading(part: np.ndarray, some: int) -> np.ndarray:
    """Whether each element is among the first of its part."""
    at = np.argsort(part, kind="stable")
    heads = np.flatnonzero(np.diff(part[at], prepend=-1))
    out = np.empty(len(part), bool)
    out[at] = np.arange(len(part)) - np.repeat(heads, np.diff(np.append(heads, len(part)))) < some
    return out


def _forest(x: np.ndarray, y: np.ndarray, likeness: np.ndarray) -> np.ndarray:
    """Indices of the edges (x, y) of a spanning forest that prefers likely edges: each part takes its best edge out, until none is left."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    order = np.argsort(-likeness, kind="stable")
    x, y = ends[: len(order)][order], ends[len(order) :][order]
    part, left, chosen = np.arange(len(nodes)), np.arange(len(order)), []
    while len(left):
        best = np.full(len(nodes), len(order))
        for end in (x, y):
            np.minimum.at(best, part[end[left]], left)
        picked = np.unique(best[best < len(order)])
        chosen.append(picked)
        part = _joined(part, part[x[picked]], part[y[picked]])
        left = left[part[x[left]] != part[y[left]]]
    return order[np.concatenate(chosen)] if chosen else order


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that come sorted by the keys, with the bounds of the groups."""

    def bounds(table: pa.Table) -> np.ndarray:
        fresh = np.zeros(table.num_rows, bool)
        fresh[:1] = True
        for k in keys:
            values = np.asarray(table.column(k))
            fresh[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(fresh), table.num_rows)

    rest = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            cuts = bounds(table)
            if len(cuts) > 2:
                yield table.slice(0, cuts[-2]), cuts[:-1]
            rest = table.slice(cuts[-2])
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _leaf_pairs(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside groups of at most LEAF rows."""
    i, j = [], []
    size = np.diff(cuts)
    for n in range(2, LEAF + 1):
        x, y = np.triu_indices(n, 1)
        heads = cuts[:-1][size == n]
        i.append((heads[:, None] + x).ravel())
        j.append((heads[:, None] + y).ravel())
    return np.concatenate(i), np.concatenate(j)


def _forest_of(points: Points, i: np.ndarray, j: np.ndarray, node: np.ndarray, own: np.ndarray, failed: set, percent: int) -> tuple[np.ndarray, ...]:
    """Of the pairs (i, j): a spanning forest of their nodes by those that the fine bound allows and that have not failed, and their likeness.

    Each part's likeliest pairs, by the bound of MIDDLE groups, are looked at first, twice as many each time; pairs inside a part are not looked at,
    so a group of near copies costs about as many fine bounds as it has members."""
    size, most = points.size[i] + points.size[j], points.likely(i, j)
    order = np.argsort(-most / np.maximum(size, 1), kind="stable")
    order = order[((100 + percent) * most >= percent * size)[order]]
    i, j, size = i[order], j[order], size[order]
    nodes, ends = np.unique(np.concatenate([node[i], node[j]]), return_inverse=True)
    x, y = ends[: len(i)], ends[len(i) :]
    part, left, some = np.arange(len(nodes)), np.arange(len(i)), 1
    taken, like = [left[:0]], [np.zeros(0)]
    while len(left):
        now = _leading(part[x[left]], some) | _leading(part[y[left]], some)
        at = left[now]
        most = points.fine(i[at], j[at])
        keep = (100 + percent) * most >= percent * size[at]
        if failed:
            keep &= np.fromiter(((a, b) not in failed and (b, a) not in failed for a, b in zip(own[i[at]].tolist(), own[j[at]].tolist(), strict=True)), bool, len(at))
        at, most = at[keep], most[keep]
        likely = most / np.maximum(size[at] - most, 1)
        chosen = _forest(part[x[at]], part[y[at]], likely) if len(at) else at
        taken.append(at[chosen])
        like.append(likely[chosen])
        part = _joined(part, part[x[at[chosen]]], part[y[at[chosen]]])
        left = left[~now]
        left = left[part[x[left]] != part[y[left]]]
        some *= 2
    at = np.concatenate(taken)
    return i[at], j[at], np.concatenate(like)


def _dealt(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (tile, set_id, label) of tiles with several components, once for each pair of blocks (one, two) that their own (side) is in, with the columns of classes."""
    sizes = members.groupBy("tile", "label").agg(F.count("*").alias("n")).groupBy("tile").agg(F.count("*").alias("labels"), F.max_by("label", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).filter("labels > 1")
    of_main = F.ceil(F.col("most") / BLOCK)
    blocks = F.when(F.col("n") <= BLOCK, F.struct(F.lit(0).cast("long").alias("main"), F.lit(1).cast("long").alias("all"))).otherwise(F.struct(of_main.alias("main"), (of_main + F.ceil((F.col("n") - F.col("most")) / BLOCK)).alias("all")))
    dealt = members.join(sizes.select("tile", F.col("main").alias("main_label"), blocks.alias("blocks")), "tile").join(classes, "set_id")
    mine = F.pmod(F.xxhash64("set_id"), F.col("blocks.main"))
    other = F.col("blocks.main") + F.pmod(F.xxhash64("set_id"), F.col("blocks.all") - F.col("blocks.main"))
    dealt = dealt.withColumn("side", F.when((F.col("blocks.main") > 0) & (F.col("label") == F.col("main_label")), mine).otherwise(other))
    # members of the main component meet only the others' blocks
    first = F.when(F.col("side") < F.col("blocks.main"), F.col("blocks.main")).otherwise(F.lit(0).cast("long"))
    return dealt.withColumn("other", F.explode(F.sequence(first, F.col("blocks.all") - 1))).withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other")})


def with_partners(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The members (tile, set_id, label) that have a member of another component in their tile within reach of their coarse counts."""

    def run(batches):
        for table, cuts in _whole_groups(batches, ["tile", "one", "two"]):
            at = 0
            while at < len(cuts) - 1:  # whole groups of about COUNT_ROWS
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + COUNT_ROWS, "right")) - 1)
                yield search(table.slice(cuts[at], cuts[to] - cuts[at]).combine_chunks().to_batches()[0], cuts[at : to + 1] - cuts[at])
                at = to

    def search(part: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        points = Counts(part.column("counts"), np.asarray(part.column("n_shingles")))
        one, two, side, label = (np.asarray(part.column(c)) for c in ("one", "two", "side", "label"))
        label = np.unique(label, return_inverse=True)[1]
        met = np.zeros(len(label), bool)
        i, j = _leaf_pairs(cuts)
        keep = (label[i] != label[j]) & ((one[i] == two[i]) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        fit = points.fits(i, j, percent)
        met[i[fit]] = met[j[fit]] = True
        for left, right in _sides(cuts, one, two, side):
            whole = Tree(points, right, label)
            for s in range(0, len(left), SIDE):
                i, j = tree_pairs(Tree(points, left[s : s + SIDE], label), whole, percent)
                met[i] = met[j] = True
        return part.select(["tile", "set_id", "label"]).filter(pa.array(met))

    dealt = _dealt(members, classes.select("set_id", "counts", "n_shingles")).select("tile", "one", "two", "side", "set_id", "label", "counts", "n_shingles")
    return dealt.repartition("tile", "one", "two").sortWithinPartitions("tile", "one", "two").mapInArrow(run, "tile long, set_id long, label long").distinct()


def _sides(cuts: np.ndarray, one: np.ndarray, two: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the two blocks of each group of more than LEAF rows; the same rows twice where a block meets itself."""
    for g in np.flatnonzero(np.diff(cuts) > LEAF).tolist():
        rows = np.arange(cuts[g], cuts[g + 1])
        left = rows[side[rows] == one[rows[0]]]
        right = left if one[rows[0]] == two[rows[0]] else rows[side[rows] == two[rows[0]]]
        if len(left) and len(right):
            yield left, right


def open_pairs(members: DataFrame, classes: DataFrame, percent: int, failed: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) that join components inside the tiles (tile, set_id, label) which hold several: a spanning forest of each pair of blocks."""

    def run(batches):
        for table, cuts in _whole_groups(batches, ["tile", "one", "two"]):
            weight = np.cumsum(np.asarray(pc.binary_length(table.column("point").combine_chunks())).astype(np.int64))
            at = 0
            while at < len(cuts) - 1:  # whole groups of about POINT_BYTES
                lo = cuts[at]
                to = max(at + 1, int(np.searchsorted(weight[cuts[1:] - 1], (weight[lo - 1] if lo else 0) + POINT_BYTES, "right")))
                yield search(table.slice(lo, cuts[to] - lo).combine_chunks().to_batches()[0], cuts[at : to + 1] - lo)
                at = to

    def search(part: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        points = Points(part.column("point"))
        one, two, side, own, label = (np.asarray(part.column(c)) for c in ("one", "two", "side", "set_id", "label"))
        label = np.unique(label, return_inverse=True)[1]
        failed = {(a, b) for a, list_ in zip(own.tolist(), part.column("failed").to_pylist(), strict=True) for b in list_ or ()} if part.column("failed").null_count < part.num_rows else set()
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        node = np.unique(group * (int(label.max()) + 1) + label, return_inverse=True)[1]
        i, j = _leaf_pairs(cuts)
        keep = (label[i] != label[j]) & ((one[i] == two[i]) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        fit = points.fits(i, j, percent)
        found = [_forest_of(points, i[fit], j[fit], node, own, failed, percent)]
        for left, right in _sides(cuts, one, two, side):
            whole, parts = Tree(points, right, label), []
            for s in range(0, len(left), SIDE):
                i, j = tree_pairs(Tree(points, left[s : s + SIDE], label), whole, percent)
                if left is right:
                    i, j = i[i < j], j[i < j]
                parts.append(_forest_of(points, i, j, node, own, failed, percent))
            i, j, like = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(i):  # the forest of all is that of the parts' forests
                taken = _forest(node[i], node[j], like)
                found.append((i[taken], j[taken], like[taken]))
        i, j, _ = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(np.stack([np.minimum(own[i], own[j]), np.maximum(own[i], own[j])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    pairs = _dealt(members, classes.select("set_id", "point"))
    if failed is None:
        pairs = pairs.withColumn("failed", F.lit(None).cast("array<bigint>"))
    else:
        pairs = pairs.join(failed.groupBy(F.col("a").alias("set_id")).agg(F.collect_set("b").alias("failed")), "set_id", "left")
    ordered = pairs.select("tile", "one", "two", "side", "set_id", "label", "point", "failed").repartition("tile", "one", "two").sortWithinPartitions("tile", "one", "two")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def labelled_rows(docs: DataFrame, k: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """doc_id, row_id, n_shingles, set_id and label (one of each component; null without shingles) of every row of docs (doc_id, text, ...)."""
    docs = docs.select("doc_id", "text")
    counted = common.saved(rows_and_counters(docs, k), scratch)
    rows = counted.filter("slice < 0").drop("slice")
    worded = rows.filter("set_id is not null")
    members = common.saved(tile_members(common.saved(rows_with_tiles(docs, k, percent, frequencies(counted)), scratch), scratch), scratch)
    classes = common.saved(worded.select("set_id", "row_id", "n_shingles", "point", "counts").join(members.select("set_id").distinct(), "set_id", "left_semi").dropDuplicates(["set_id"]), scratch)

    hubs = members.filter((F.col("n") > HUB_ABOVE) & (F.col("set_id") != F.col("hub"))).groupBy("set_id", "hub").agg(F.sum("tiles").alias("n"))
    near = hubs.groupBy(F.col("set_id").alias("b")).agg(F.max_by("hub", F.struct("n", "hub")).alias("a")).select("a", "b")
    labels = _merged(common.saved(_verified(common.saved(_bounded(near, classes, percent), scratch), docs, k, percent, scratch), scratch), [], scratch)

    open_ = members.select("tile", "set_id").distinct()
    failed = None
    while True:
        reached = common.saved(with_partners(common.saved(_labelled(open_, labels, "set_id"), scratch), classes, percent), scratch)
        pairs = common.saved(_located(open_pairs(reached, classes, percent, failed), classes), scratch)
        links = common.saved(_verified(pairs, docs, k, percent, scratch), scratch)
        labels = _merged(links, labels, scratch)
        fresh = common.saved(pairs.select("a", "b").join(links, ["a", "b"], "left_anti"), scratch)
        if not fresh.limit(1).count():
            break
        failed = fresh if failed is None else failed.union(fresh)
        again = members.select("tile", "set_id").join(fresh.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id", "left_semi").select("tile").distinct()
        open_ = members.select("tile", "set_id").distinct().join(again, "tile", "left_semi")
    done = _labelled(worded.select("doc_id", "row_id", "n_shingles", "set_id"), labels, "set_id")
    return done.unionByName(rows.filter("set_id is null").select("doc_id", "row_id", "n_shingles", "set_id", F.lit(None).cast("long").alias("label")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text, ...); links at percent/100 or more."""
    scratch = common.Scratch()
    rows = common.saved(labelled_rows(docs, k, percent, scratch), scratch)
    worded = rows.filter("label is not null")
    least = worded.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    done = worded.join(least, "label").select("doc_id", "n_shingles", "component_id")
    out = common.saved(done.union(rows.filter("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))
    scratch.clear(docs.sparkSession)
    return out


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, one of each component: that of the smallest doc_id (nulls last, then the smallest hash of the row), repeated rows of it once.

    Rows without words all stay."""
    scratch = common.Scratch()
    rows = common.saved(labelled_rows(docs, k, percent, scratch).filter("label is not null"), scratch)
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_id")
    best = rows.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1")
    among = common.saved(rows.join(best, "label").select("row_id", (F.col("row_id") == F.col("best.row_id")).alias("stays")).groupBy("row_id").agg(F.max("stays").alias("stays"), F.count("*").alias("n")), scratch)
    dropped = common.saved(among.filter("not stays").select(F.col("row_id").alias("_row_id")))
    repeated = common.saved(among.filter("stays and n > 1").select(F.col("row_id").alias("_row_id")))
    scratch.clear(docs.sparkSession)
    own = F.xxhash64("doc_id", "text")
    single = docs.join(dropped.union(repeated), own == F.col("_row_id"), "left_anti")
    once = docs.withColumn("_row_id", own).join(repeated, "_row_id", "left_semi").dropDuplicates(["_row_id"]).select(docs.columns)
    return single.unionAll(once)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 0.9 on 3-word shingles."""
    return jaccard_components(common.table(spark, sf_dir, "documents"), 3, 90)
