"""Operator 12: ranked lexical search over a K2-treap of the term-document grid.

build() cuts the rows into shards of about SHARD_POSTINGS postings and writes one K2-treap a shard: a quadtree over the
grid of the shard's terms (rows, in the order of their hashes) and documents (columns, by doc_id), without empty cells,
whose every cell keeps the largest impact below it, as its distance from the cell above (three bytes; none is kept for an
only child, whose distance is 0); leaves are the impacts themselves. All rows are indexed, and all their terms. search() takes items in blocks of ITEM_BYTES; within a shard the
paths of an item's terms go down together, best document range first: a range's bound is the sum of weight times maximum
over the terms' cells, so a range whose bound cannot reach the 50th score found so far is left, and every score returned
is exact. A task carries the 50 best of an item from shard to shard; what tasks return is cut to 50 an item twice, first
by parts of the shards. A term's weight needs its document frequency in all shards, which the shards' lists of terms give;
the number of documents and of terms come from one count before.

64-bit hashes stand for terms. Cases: a null text or one without terms is not counted and never returned; an item without
terms (null too) has no rows; repeated rows of documents are ranked each for itself, equal scores by ascending doc_id with a
null last; repeated items get the same rows each; empty tables give no rows; other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP = 50
#: Postings (different terms of documents) of a shard at which it is closed; one longer document still goes into one shard.
SHARD_POSTINGS = 1 << 18
#: Bytes of items' texts that one search carries to all shards.
ITEM_BYTES = 4 << 20
#: Ranges that are opened at a time.
WIDTH = 256
#: Parts of the shards whose results are cut to the best before they meet.
PARTS = 64
#: Items whose results go back in one Arrow batch.
OUT_ITEMS = 1000
SHARD = "ids binary, missing binary, terms binary, df binary, levels int, columns int, masks binary, drops binary"
_LAST = np.iinfo(np.int64).max

#: Bytes of terms, with A-Z lower-cased; all others become spaces.
_TERM = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _TERM[_b] = _b
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)
#: Children of a mask that stand before each of the four.
_BEFORE = np.array([[bin(m & ((1 << b) - 1)).count("1") for b in range(4)] for m in range(16)], np.int64)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = every = 0
        for _, data, offsets in common.steps(batches):
            n = np.diff(common.word_bounds(_TERM[data], offsets)[2])
            some, every = some + int((n > 0).sum()), every + int(n.sum())
        yield pa.RecordBatch.from_pydict({"some": [some], "every": [every]})

    row = docs.select("text").mapInArrow(count, "some long, every long").agg(F.sum("some"), F.sum("every")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _spread(x: np.ndarray) -> np.ndarray:
    """The low 32 bits with a gap after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def treap(rows: np.ndarray, columns: np.ndarray, impact: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The children masks of all inner cells and the drops, against the cell above, of all cells that are no only child, both from the root down."""
    code = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(code)
    code, best = code[order], impact[order].astype(np.int32)
    masks, maxima, parents = [], [best], []
    for _ in range(levels):
        above = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.int64)), first).astype(np.uint8))
        parents.append(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code)))))
        code, best = above[first], np.maximum.reduceat(best, first)
        maxima.append(best)
    drops = [maxima[-1]]
    for i in range(levels - 1, -1, -1):
        shared = np.bincount(parents[i])[parents[i]] > 1
        drops.append((maxima[i + 1][parents[i]] - maxima[i])[shared])
    return np.concatenate(masks[::-1]) if masks else np.zeros(0, np.uint8), np.concatenate(drops)


def _narrow(drops: np.ndarray) -> np.ndarray:
    """Three bytes of each drop, the lowest of all first; impacts are below 10^6."""
    return np.ascontiguousarray(drops.astype("<i4").view(np.uint8).reshape(-1, 4).T[:3])


def _wide(packed: np.ndarray) -> np.ndarray:
    parts = packed.reshape(3, -1).astype(np.int32)
    return parts[0] | (parts[1] << 8) | (parts[2] << 16)


def build(docs: DataFrame, some: int, every: int) -> DataFrame:
    """The shards of docs (doc_id, text), given their statistics()."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows = size = 0
        for piece, data, offsets in common.steps(batches):
            h, _, _, first = common.word_hashes(_TERM[data], offsets)
            n = np.diff(first)
            names, inverse = np.unique(h, return_inverse=True)
            key, tf = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(names)) + inverse, return_counts=True)
            held.append((piece.column("doc_id"), n, names, (key // max(1, len(names)) + rows).astype(np.int32), (key % max(1, len(names))).astype(np.int32), tf.astype(np.int32)))
            rows, size = rows + len(n), size + len(key)
            if size >= SHARD_POSTINGS:
                yield shard(held)
                held, rows, size = [], 0, 0
        if size:
            yield shard(held)

    def shard(held: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0].cast(pa.int64()) for x in held])
        missing = np.asarray(ids.is_null())
        ids, n = np.asarray(ids.fill_null(_LAST)), np.concatenate([x[1] for x in held])
        order = np.lexsort((missing, ids))
        order = order[n[order] > 0]
        column = np.zeros(len(n), np.int64)
        column[order] = np.arange(len(order))
        terms = np.unique(np.concatenate([x[2] for x in held]))
        row = np.concatenate([np.searchsorted(terms, x[2])[x[4]] for x in held])
        of, tf = np.concatenate([x[3] for x in held]), np.concatenate([x[5] for x in held]).astype(np.int64)
        m = np.array([50 + 50 * int(k) * some // every for k in n], np.int64)
        wide, high = max(0, len(order) - 1).bit_length(), max(0, len(terms) - 1).bit_length()
        masks, drops = treap(row, column[of], 1_000_000_000 * tf // (1000 * tf + 20 * m[of]), max(wide, high))
        found = {"ids": ids[order], "missing": missing[order], "terms": terms, "df": np.bincount(row, minlength=len(terms)).astype(np.int32)}
        even = np.append(masks, np.zeros(len(masks) % 2, np.uint8))
        packed = {"masks": even[::2] | (even[1::2] << 4), "drops": _narrow(drops)}
        done = {k: [v.tobytes()] for k, v in (found | packed).items()} | {"levels": pa.array([max(wide, high)], pa.int32()), "columns": pa.array([len(order)], pa.int32())}
        return pa.RecordBatch.from_pydict({name: done[name] for name in ("ids", "missing", "terms", "df", "levels", "columns", "masks", "drops")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shards, SHARD)


class Tree:
    """A shard as it is searched."""

    def __init__(self, row: dict[str, pa.Scalar]):
        held = {name: np.frombuffer(x.as_buffer(), np.uint8) if pa.types.is_binary(x.type) else x.as_py() for name, x in row.items()}
        self.ids, self.missing = held["ids"].view(np.int64), held["missing"].view(bool)
        self.terms, self.levels, self.columns = held["terms"].view(np.uint64), held["levels"], held["columns"]
        packed, drops = held["masks"], _wide(held["drops"])
        masks = np.empty(2 * len(packed), np.uint8)
        masks[::2], masks[1::2] = packed & 15, packed >> 4
        sizes, at = [1], 0  # cells of each level
        for _ in range(self.levels):
            sizes.append(int(_ONES[masks[at : at + sizes[-1]]].sum()))
            at += sizes[-2]
        inner = at
        self.mask = np.zeros(inner + 1, np.uint8)
        self.mask[:inner] = masks[:inner]
        ones = _ONES[self.mask[:inner]]
        self.first = np.concatenate((1 + np.cumsum(ones) - ones, [0])).astype(np.int32)
        self.none, self.inner = sum(sizes), inner
        self.best = np.empty(self.none + 1, np.int32)  # the last one is the empty cell
        self.best[0], self.best[-1] = drops[0], 0
        at, taken = 0, 1
        for size, below in zip(sizes, sizes[1:]):
            ones = _ONES[self.mask[at : at + size]]
            values, shared = np.repeat(self.best[at : at + size], ones), np.flatnonzero(np.repeat(ones > 1, ones))
            values[shared] -= drops[taken : taken + len(shared)]
            self.best[at + size : at + size + below] = values
            at, taken = at + size, taken + len(shared)

    def below(self, cells: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """The children of cells in a quarter (row bit, column bit), or none."""
        mask = self.mask[np.minimum(cells, self.inner)]
        child = self.first[np.minimum(cells, self.inner)] + _BEFORE[mask, quarter]
        return np.where((mask >> quarter) & 1 == 1, child, self.none)

    def search(self, terms: np.ndarray, weights: np.ndarray, kept: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
        """The best of kept (scores, ids, missing, in order) and of this shard's columns, in order."""
        row = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[row] == terms
        row, weights = row[here], weights[here]
        if not len(row):
            return kept
        cells, level = np.zeros((1, len(row)), np.int64), self.levels
        wide = max(0, self.columns - 1).bit_length()
        while level > wide:  # above, cells are divided by rows alone
            level -= 1
            cells = self.below(cells, ((row >> level) & 1)[None, :] << 1)
        at, levels, bound = np.zeros(1, np.int64), np.full(1, level), (self.best[cells] * weights).sum(1)
        if level == 0:  # one column only
            return self.kept(kept, bound, at)
        while True:
            if len(kept[0]) >= TOP:
                same = (self.ids[at] < kept[1][-1]) | ((self.ids[at] == kept[1][-1]) & ~self.missing[at] & kept[2][-1])
                go = (bound > kept[0][-1]) | ((bound == kept[0][-1]) & same)
                at, levels, cells, bound = at[go], levels[go], cells[go], bound[go]
            if not len(at):
                return kept
            take = np.zeros(len(at), bool)
            take[np.argpartition(-bound, WIDTH)[:WIDTH] if len(at) > WIDTH else slice(None)] = True
            down = levels[take] - 1
            bit = ((row[None, :] >> down[:, None]) & 1) << 1
            two = np.concatenate([self.below(cells[take], bit), self.below(cells[take], bit | 1)])
            start = np.concatenate([at[take], at[take] + (1 << down)])
            down, limit = np.concatenate([down, down]), (self.best[two] * weights).sum(1)
            fine = (limit > 0) & (start < self.columns)
            leaf = fine & (down == 0)
            kept = self.kept(kept, limit[leaf], start[leaf])
            fine &= ~leaf
            at, levels = np.concatenate([at[~take], start[fine]]), np.concatenate([levels[~take], down[fine]])
            cells, bound = np.concatenate([cells[~take], two[fine]]), np.concatenate([bound[~take], limit[fine]])

    def kept(self, kept: tuple, scores: np.ndarray, columns: np.ndarray) -> tuple:
        some = scores > 0
        score, ids, missing = (np.concatenate(x) for x in zip(kept, (scores[some], self.ids[columns[some]], self.missing[columns[some]])))
        order = np.lexsort((missing, ids, -score))[:TOP]
        return score[order], ids[order], missing[order]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with the hashes of their different terms."""
    for piece, data, offsets in common.steps(batches):
        h, _, _, first = common.word_hashes(_TERM[data], offsets)
        lists = [np.unique(h[a:b]).tobytes() for a, b in zip(first, first[1:])]
        yield pa.RecordBatch.from_pydict({"item_id": piece.column("item_id"), "hashes": pa.array(lists, pa.binary())})


def search(index: DataFrame, items: DataFrame, some: int) -> DataFrame:
    """item_id, rank, doc_id, score of the TOP best rows of an index of `some` documents for each item (item_id, text)."""
    spark = index.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // ITEM_BYTES))
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = [r for r in part.mapInArrow(_terms, "item_id long, hashes binary").collect() if r["hashes"]]
        ranked = _ranked(index, [r["item_id"] for r in rows], [np.frombuffer(r["hashes"], np.uint64) for r in rows], some)
        found = ranked if found is None else found.unionByName(ranked)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _ranked(index: DataFrame, names: list, hashes: list[np.ndarray], some: int) -> DataFrame:
    spark = index.sparkSession
    wanted = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    sent = spark.sparkContext.broadcast(wanted)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = sent.value, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                terms = np.frombuffer(row["terms"], np.uint64)
                at = np.minimum(np.searchsorted(terms, own), max(0, len(terms) - 1))
                sums += np.where(terms[at] == own, np.frombuffer(row["df"], np.int32)[at], 0)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"term": there, "df": sums[there]})

    df = np.zeros(len(wanted), np.int64)
    for term, n in index.select("terms", "df").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    asked = spark.sparkContext.broadcast([(h, weight[np.searchsorted(wanted, h)]) for h in hashes])
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [nothing] * len(asked.value)
        for batch in batches:
            for at in range(batch.num_rows):
                tree = Tree({name: batch.column(name)[at] for name in batch.schema.names})
                kept = [tree.search(*item, had) for item, had in zip(asked.value, kept)]
        for at in range(0, len(kept), OUT_ITEMS):
            some = kept[at : at + OUT_ITEMS]
            score, ids, missing = (np.concatenate(x) for x in zip(*some))
            item = np.repeat(np.arange(at, at + len(some)), [len(x[0]) for x in some])
            yield pa.RecordBatch.from_pydict({"item": item, "doc_id": pa.array(ids, mask=missing), "score": score})

    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = index.select("ids", "missing", "terms", "levels", "columns", "masks", "drops").mapInArrow(best, "item long, doc_id long, score long")
    parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= TOP)
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= TOP)
    called = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")
    return parts.join(F.broadcast(called), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for every benchmark item."""
    docs = common.table(spark, sf_dir, "documents")
    some, every = statistics(docs)
    scratch = common.Scratch()
    index = common.saved(build(docs, some, every), scratch)
    out = common.saved(search(index, common.table(spark, sf_dir, "benchmark"), some))
    scratch.clear(spark)
    return out


OP12_SQL = """with words as (select doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) as word from documents),
 terms as (select doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from words),
 asked as (select distinct item_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from (select item_id, unnest(regexp_extract_all(text, '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) as word from benchmark)),
 lengths as (select doc_id, count(*) as n from terms group by doc_id),
 whole as (select count(*) as docs, cast(sum(n) as bigint) as length from lengths),
 counts as (select doc_id, term, count(*) as tf from terms where term in (select term from asked) group by doc_id, term),
 weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from counts, whole group by term, docs),
 scores as (select item_id, c.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) as bigint) as score
  from asked join weights using (term) join counts c using (term) join lengths l on l.doc_id = c.doc_id, whole group by item_id, c.doc_id)
select item_id, cast(rank as int) as rank, doc_id, score
 from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 50"""
