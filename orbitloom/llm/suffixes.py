"""Operator 11: removal of repeated byte strings of WINDOW bytes, by suffix arrays of shards.

A shard must hold all windows of WINDOW bytes that can be equal. Every window has an anchor, the least hash of its GRAM-byte strings,
and equal windows have equal anchors; so a text is cut into pieces, runs of at most WINDOW - GRAM + 1 windows with one
anchor. Anchors that one piece alone has, once, cannot repeat and go no further; equal pieces become one with a count, and
where they are two or more, all their windows repeat. The other pieces are fetched from one text each and put into
shards of about SHARD_BYTES by their anchors. In a shard the suffix array of its pieces is built by induced sorting
(induced.py), and permuted common prefixes show which windows have an equal one next to them in order. If the pieces of one anchor
are more than a shard (a passage of very many texts, with other words around it), the windows of that anchor are compared by hash instead,
each its own row, so that no task takes them all. Repeated windows then go back to all texts that have the piece.

64-bit hashes stand for anchors, for pieces of one anchor, and, with their length, for texts. Cases: a null text counts as
empty; a text shorter than WINDOW has no windows and stays; repeated rows are repeats of each other, and all are removed; bytes of a
text that repeats within itself go too; cuts may fall within a character; empty tables give no rows; other columns are kept by
repeats() (names that begin with an underscore and a letter of its own, as _spans, are taken).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, induced

WINDOW, GRAM = 400, 32
SHARD_BYTES = 2 << 20
_KEY = ["_hash", "_bytes"]
_PIECE = "anchor long, piece long, start int, windows int, again boolean"


def _least(x: np.ndarray, w: int, pick=np.minimum, fill: int = (1 << 64) - 1) -> np.ndarray:
    """The least (or greatest) of x[i : i + w] for every i, as far as x goes."""
    n = len(x)
    whole = np.full(-(-(n + w) // w) * w, fill, np.uint64)
    whole[:n] = x
    blocks = whole.reshape(-1, w)
    ahead = pick.accumulate(blocks, 1).reshape(-1)
    back = pick.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return pick(back[:n], ahead[w - 1 : n + w - 1])


def _rolled(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of data."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    power, inverse = common._power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(common._BYTE[data] * power[: len(data)], out=running[1:])
    return common.mix((running[k:] - running[:-k]) * inverse[: len(data) - k + 1])


def cut(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The pieces of texts: text, anchor, first window, windows, and whether the anchor may stand in it twice."""
    w = window - gram + 1
    grams = _rolled(data, gram)
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    if not len(of):
        nothing = np.zeros(0, np.int64)
        return nothing, np.zeros(0, np.uint64), nothing, nothing, np.zeros(0, bool)
    at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[of]
    least = _least(grams, w)[at]
    change = np.concatenate(([True], (of[1:] != of[:-1]) | (least[1:] != least[:-1])))
    run = np.flatnonzero(change)
    long = np.diff(np.append(run, len(of)))
    pieces = -(-long // w)
    begin = np.repeat(run, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * w
    windows = np.diff(np.append(begin, len(of)))
    valid = np.zeros(len(grams), np.uint64)
    valid[at] = least
    above = np.zeros(len(grams) + w - 1, np.uint64)
    above[w - 1 :] = valid
    anchors = np.flatnonzero(grams == _least(above, w, np.maximum, 0)[: len(grams)])  # least of a window that holds them
    twice = np.concatenate(([0], np.cumsum(np.concatenate((grams[anchors][1:] == grams[anchors][:-1], [False])))))
    low, high = np.searchsorted(anchors, at[begin]), np.searchsorted(anchors, at[begin] + windows + w - 1)
    return of[begin], least[begin], at[begin], windows, twice[np.maximum(high - 1, low)] > twice[low]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in common.steps(batches, "_body"):
        of, anchor, at, windows, again = cut(data, offsets)
        view = memoryview(data)
        digest = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at.tolist(), (at + windows + WINDOW - 1).tolist())]
        rows = part.select([*_KEY, "_doc"]).take(pa.array(of))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(anchor.view(np.int64)), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array((at - offsets[of]).astype(np.int32)),
                                          pa.array(windows.astype(np.int32)), pa.array(again)], [*_KEY, "_doc", "anchor", "piece", "start", "windows", "again"])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces listed beside each text, as bytes."""
    for batch in batches:
        for row in range(batch.num_rows):
            body, listed = memoryview(batch.column("_body")[row].as_buffer()), batch.column("_listed")[row].as_py()
            for at in range(0, len(listed), 4096):
                some = listed[at : at + 4096]
                yield pa.RecordBatch.from_pydict({"anchor": [x["anchor"] for x in some], "piece": [x["piece"] for x in some], "single": [x["single"] for x in some],
                                                  "bytes": pa.array([bytes(body[x["start"] : x["start"] + x["windows"] + WINDOW - 1]) for x in some], pa.binary())})


def _runs(repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], repeated.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_RUNS = "anchor long, piece long, low int, high int"


def _sorted(table: pa.Table) -> pa.Table:
    """Runs of repeated windows of the single pieces of a shard."""
    rows = {}
    for anchor, piece, single, body in zip(*(table.column(c).to_pylist() for c in ("anchor", "piece", "single", "bytes"))):
        rows[anchor, piece] = (single, body)
    bodies = [b for _, b in rows.values()]
    symbols = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + 2
    sizes = np.array([len(b) + 1 for b in bodies])
    begins = np.cumsum(sizes) - sizes
    symbols[begins + sizes - 1] = 1  # after each piece
    symbols = np.append(symbols, 0)
    end = np.append(np.repeat(begins + sizes - 1, sizes), len(symbols) - 1)
    array = induced.suffix_array(symbols)
    before, shared = induced.permuted_prefixes(symbols, array, end, begins)
    found = np.flatnonzero(shared >= WINDOW)
    repeated = np.zeros(len(symbols), bool)
    repeated[found] = repeated[before[found]] = True
    out = []
    for (anchor, piece), (single, body), a in zip(rows, rows.values(), begins.tolist()):
        if single:
            out += [(anchor, piece, int(x), int(y)) for x, y in zip(*_runs(repeated[a : a + len(body) - WINDOW + 1]))]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["anchor", "piece", "low", "high"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the pieces with its hash."""
    for batch in batches:
        for row in range(batch.num_rows):
            h = _rolled(np.frombuffer(batch.column("bytes")[row].as_buffer(), np.uint8), WINDOW)
            fixed = {c: pa.array([batch.column(c)[row].as_py()] * len(h), kind) for c, kind in (("anchor", pa.int64()), ("piece", pa.int64()), ("single", pa.bool_()))}
            yield pa.RecordBatch.from_pydict(fixed | {"low": np.arange(len(h), dtype=np.int32), "h": h.view(np.int64)})


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, scratch: common.Scratch, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) with _spans: byte ranges {a, b} that repeated windows cover (overlapping, unordered), null for none."""
    spark = docs.sparkSession
    docs = docs.withColumns({"_hash": F.xxhash64("text"), "_bytes": F.coalesce(F.octet_length("text"), F.lit(0))})
    texts = docs.filter(F.col("_bytes") >= WINDOW).select(*_KEY, F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("binary").alias("_body"))
    every = common.saved(texts.mapInArrow(_pieces, f"_hash long, _bytes int, _doc long, {_PIECE}"), scratch)
    # the anchors that more than one piece has, or one twice
    twice = every.groupBy("anchor").agg(F.count("*").alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("anchor")
    places = common.saved(every.join(twice, "anchor").groupBy(*_KEY, "anchor", "piece", "start", "windows").agg(F.count("*").alias("n"), F.min("_doc").alias("_doc"), F.max("again").alias("again")), scratch)
    pieces = common.saved(places.groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.max("again").alias("again"), F.min(F.struct(*_KEY, "_doc", "start", "windows")).alias("of")), scratch)
    single = (F.col("n") == 1).alias("single")
    size = (F.col("of.windows") + WINDOW - 1).cast("long")
    groups = pieces.groupBy("anchor").agg(F.count("*").alias("variants"), F.max("again").alias("again"), F.max(single).alias("open"), F.sum(size).alias("size"))
    groups = groups.filter(F.col("open") & (F.col("again") | (F.col("variants") > 1))).select("anchor", (F.col("size") > shard_bytes).alias("large"))
    wanted = common.saved(pieces.join(groups, "anchor").select("anchor", "piece", single, "large", "of.*"), scratch)
    total = wanted.filter("not large").agg(F.sum(F.col("windows") + WINDOW - 1)).first()[0] or 0
    listed = wanted.groupBy(*_KEY, "_doc").agg(F.collect_list(F.struct("anchor", "piece", "single", "start", "windows")).alias("_listed"))
    both = texts.alias("t").join(listed.alias("l"), (F.col("t._hash") == F.col("l._hash")) & (F.col("t._bytes") == F.col("l._bytes")) & F.col("t._doc").eqNullSafe(F.col("l._doc")))
    fetched = both.select("_body", "_listed").mapInArrow(_fetched, "anchor long, piece long, single boolean, bytes binary")
    large = wanted.filter("large").select("anchor").distinct()
    some_large = not large.isEmpty()
    if some_large:
        fetched = common.saved(fetched, scratch)
    shards = max(1, total // shard_bytes)
    small = fetched.join(large, "anchor", "left_anti") if some_large else fetched
    runs = small.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(_sorted, _RUNS)
    if some_large:
        windows = common.saved(fetched.join(large, "anchor").dropDuplicates(["anchor", "piece"]).mapInArrow(_hashed, "anchor long, piece long, single boolean, low int, h long"), scratch)
        equal = windows.groupBy("anchor", "h").count().filter("count > 1").select("anchor", "h")
        runs = runs.unionByName(windows.filter("single").join(equal, ["anchor", "h"]).select("anchor", "piece", "low", (F.col("low") + 1).alias("high")))
    runs = runs.unionByName(pieces.filter("n > 1").select("anchor", "piece", F.lit(0).alias("low"), F.col("of.windows").alias("high")))
    spans = places.join(runs, ["anchor", "piece"]).select(*_KEY, F.struct((F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high") + (WINDOW - 1)).alias("b")).alias("span"))
    spans = common.saved(spans.groupBy(*_KEY).agg(F.collect_list("span").alias("_spans")), scratch)
    return docs.join(spans, _KEY, "left").select(*[c for c in docs.columns if c not in _KEY], "_spans")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, digest = [], [], []
        for body, listed, given in zip(batch.column("body"), batch.column("_spans").to_pylist(), batch.column("digest").to_pylist()):
            gone = _merged(listed or [])
            if gone:
                view, kept, at = memoryview(body.as_buffer()), hashlib.sha256(), 0
                for a, b in [*gone, (len(view), 0)]:
                    kept.update(view[at:a])
                    at = b
                given = kept.hexdigest()
            removed.append(sum(b - a for a, b in gone))
            spans.append(len(gone))
            digest.append(given)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_removed": removed, "n_spans": spans, "kept_sha256": pa.array(digest, pa.string())})


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated byte strings."""
    scratch = common.Scratch()
    found = repeats(common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    repeated = F.col("_spans").isNotNull()
    columns = found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "_spans", F.when(repeated, F.col("text").cast("binary")).alias("body"),
                           F.when(~repeated, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    out = common.saved(columns.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    scratch.clear(spark)
    return out
