"""Operator 13: alignment of two tokenizers' tokens over a corpus.

A text is cut where a blank or line feed follows a character that is no white space. Neither tokenizer has a token over such a
place (a byte-level BPE splits there before it merges, and no piece of the other vocabulary goes on over one, which is checked
when it is loaded), so a text's tokens are those of its stretches, and a worker remembers the aligned stretches, within
STRETCHES entries, of which those used least go first. Two tokens are linked where their byte ranges overlap; every place between two neighbouring ends of either
kind belongs to one link.

Counts: a first pass over the texts gives each task's pairs of ids with their links. The different pairs are dealt into buckets by
a hash, and each bucket gets a minimal perfect hash function (hash and displace: keys fall into small groups, and a group's
pilot sends its keys to slots that are still free; groups of one key are given a slot). Links are then summed as dense
vectors indexed by this hash, first over FAN parts of the first pass at a time, then FAN vectors at a time, up a tree. The
second pass aligns the texts again and looks the counts up by hash; the key kept in the slot is compared. The functions,
keys and counts go to all workers if the pairs are at most TABLE_PAIRS (some 20 bytes each); beyond that every document's pairs
meet their counts in a shuffle, with equal results (tested).

The vocabulary files are arguments; they must lie at the same path on all executors. Cases: a null or empty text, or one that the
tokens do not give back (such as one that holds U+2581), has no tokens: zeros and '' as digest, and counts nowhere; repeated
rows count each and get equal results; empty tables give no rows; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BYTE_FILE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Aligned stretches that a worker remembers, their characters, characters of texts and stretches of a long text that are taken at a time.
STRETCHES, STRETCH_CHARS, GROUP_CHARS, SLICE = 800_000, 16 << 20, 1 << 20, 50_000
#: Pairs of a bucket on average, vectors that are summed at a time, and the pairs whose counts are sent to all workers.
BUCKET, FAN, TABLE_PAIRS = 4096, 64, 1 << 22
_MARK = "▁"
#: Fixed value: where byte-level BPE splits a text before it merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_STRETCH = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")
_SECOND, _ODD = np.uint64(0x5851F42D4C957F2D), np.uint64(0xDA942042E4DD58B5)
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers and the stretches aligned so far, numbered as they came."""

    def __init__(self, byte_file: str, piece_file: str):
        with open(byte_file, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in name): i for name, i in model["vocab"].items() if all(c in letters for c in name)}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError(f"{byte_file} does not number its tokens in the order of merges")
        ranks = {name: i for name, i in ranks.items() if i < 256 + len(merged)}
        self.bpe = tiktoken.Encoding("bytes", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        texts = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any(re.search(rf"[^\s{_MARK}][ \n{_MARK}]", t) for t in texts):
            raise ValueError(f"{piece_file} has a piece that goes on over a blank or line feed")
        self.a_bytes = [b""] * (256 + len(merged))
        for name, i in ranks.items():
            self.a_bytes[i] = name
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.pieces.is_byte(i) else t.replace(_MARK, " ").encode() for i, t in enumerate(texts)]
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.dot = self.pieces.encode(".")
        self.known: dict[str, int] = {}
        self.chars = 0
        #: Of each stretch: its groups as text; tokens of both kinds, groups, links (-1 where the bytes differ); times used; scores.
        self.groups: list[bytes] = []
        self.sizes, self.used, self.scores = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        self.pairs, self.begins = np.zeros(0, np.uint64), np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.known) > STRETCHES or self.chars > STRETCH_CHARS

    def trim(self) -> None:
        """Forgets what was used least; the others are numbered anew."""
        least, size, texts = 2, np.fromiter(map(len, self.known), np.int64, len(self.known)), list(self.known)
        while (self.used >= least).sum() > STRETCHES // 2 or size[self.used >= least].sum() > STRETCH_CHARS // 2:
            least *= 2
        keep = np.flatnonzero(self.used >= least)
        links = np.diff(self.begins)
        self.pairs = self.pairs[np.repeat(self.used >= least, links)]
        self.begins = np.concatenate(([0], np.cumsum(links[keep])))
        self.scores = self.scores[keep[keep < len(self.scores)]]
        self.sizes, self.used, self.chars = self.sizes[keep], np.zeros(len(keep), np.int64), int(size[keep].sum())
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.known = {texts[i]: n for n, i in enumerate(keep.tolist())}

    def numbers(self, stretches: list[str]) -> np.ndarray:
        """The numbers of stretches, after aligning new ones."""
        known = self.known
        fresh = [s for s in dict.fromkeys(stretches) if s not in known]
        if fresh:
            self._align(fresh)
        of = np.fromiter(map(known.__getitem__, stretches), np.int64, len(stretches))
        self.used += np.bincount(of, minlength=len(self.used))
        return of

    def _align(self, fresh: list[str]) -> None:
        a = list(map(self.bpe.encode_ordinary, fresh))
        b = [x[len(self.dot) :] if x[: len(self.dot)] == self.dot else [] for x in self.pieces.encode(["." + s for s in fresh], num_threads=1)]
        self.known.update(zip(fresh, range(len(self.groups), len(self.groups) + len(fresh))))
        self.chars += sum(map(len, fresh))
        whole = "".join(fresh).encode()
        if any(b"".join(map(table.__getitem__, itertools.chain.from_iterable(ids))) != whole for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            for i, s in enumerate(fresh):
                if any(b"".join(map(table.__getitem__, ids)) != s.encode() for table, ids in ((self.a_bytes, a[i]), (self.b_bytes, b[i]))):
                    a[i] = b[i] = []
        ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.concatenate(([True], ends[1:] != ends[:-1]))] if len(ends) else ends  # one link each
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pairs = (ids_a[at_a].astype(np.uint64) << np.uint64(32)) | ids_b[at_b].astype(np.uint64)
        of = np.repeat(np.arange(len(fresh)), n_a)
        upto_b = np.searchsorted(end_b, end_a, "right")
        shared_a = end_b[np.maximum(upto_b - 1, 0)] == end_a if len(end_b) else np.zeros(0, bool)
        links = np.bincount(of[at_a], minlength=len(fresh))
        sizes = np.stack([n_a, n_b, np.bincount(of[shared_a], minlength=len(fresh)), np.where(n_a > 0, links, -1)], 1)
        self.groups += _written(ids_a, ids_b, of, np.repeat(np.arange(len(fresh)), n_b), shared_a, upto_b, len(fresh))
        self.sizes, self.used = np.concatenate([self.sizes, sizes]), np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        self.pairs, self.begins = np.concatenate([self.pairs, pairs]), np.concatenate([self.begins, self.begins[-1] + np.cumsum(links)])


def _written(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, shared: np.ndarray, upto_b: np.ndarray, count: int) -> list[bytes]:
    """The groups of each stretch as text: ids of one kind by commas, the kinds by a bar, groups by semicolons."""
    if not len(ids_a):
        return [b""] * count
    group_a = np.cumsum(shared) - shared
    last_b = np.zeros(len(ids_b), bool)
    last_b[upto_b[shared] - 1] = True
    group_b = np.cumsum(last_b) - last_b
    order = np.lexsort((np.repeat([0, 1], [len(ids_a), len(ids_b)]), np.concatenate([group_a, group_b])))
    ids, of = np.concatenate([ids_a, ids_b])[order], np.concatenate([of_a, of_b])[order]
    after = np.concatenate([np.where(shared, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))])[order]
    digits = 1 + (ids[:, None] >= 10 ** np.arange(1, 7)[None, :]).sum(1)
    stop = np.cumsum(digits + 1)  # behind the mark that follows the digits
    text = np.zeros(stop[-1], np.uint8)
    text[stop - 1] = after
    for j in range(int(digits.max())):
        some = digits > j
        text[stop[some] - 2 - j] = 0x30 + ids[some] // 10**j % 10
    text = text.tobytes()
    first = np.searchsorted(of, np.arange(count + 1)).tolist()
    stop = [0, *stop.tolist()]
    return [text[stop[p] : stop[q] - 1] if q > p else b"" for p, q in zip(first, first[1:])]


_held: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_file: str, piece_file: str) -> Aligner:
    """The worker's aligner: vocabularies are loaded once a process."""
    if (byte_file, piece_file) not in _held:
        _held[byte_file, piece_file] = Aligner(byte_file, piece_file)
    found = _held[byte_file, piece_file]
    found.scores = found.scores[:0]
    return found


def _aligned(aligner: Aligner, texts: list, forget) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Lists of (row, numbers of stretches), about GROUP_CHARS of text at a time; rows that the tokens do not give back are left
    out, and a text longer than that comes in several lists. forget() is called when the aligner is full; numbers change with it."""
    short: list[tuple[int, str]] = []
    size = 0

    def numbered() -> list[tuple[int, np.ndarray]]:
        lists = [_STRETCH.findall(" " + text) for _, text in short]
        of = aligner.numbers(list(itertools.chain.from_iterable(lists)))
        fine = aligner.sizes[of, 3] >= 0
        cut = np.cumsum([0, *map(len, lists)]).tolist()
        return [(row, of[a:b]) for (row, _), a, b in zip(short, cut, cut[1:]) if fine[a:b].all()]

    def long(row: int, text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
        def parts() -> Iterator[np.ndarray]:
            found = _STRETCH.finditer(" " + text)
            while part := [m.group() for m in itertools.islice(found, SLICE)]:
                if aligner.full():
                    forget()
                yield aligner.numbers(part)

        if all((aligner.sizes[of, 3] >= 0).all() for of in parts()):
            for of in parts():
                yield [(row, of)]

    for row, text in enumerate(texts):
        if not text:
            continue
        if len(text) > GROUP_CHARS:
            yield from long(row, text)
            continue
        if size + len(text) > GROUP_CHARS:
            yield numbered()
            short, size = [], 0
        if aligner.full():
            forget()
        short.append((row, text))
        size += len(text)
    if short:
        yield numbered()
    if aligner.full():
        forget()


def counted(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """First pass: pairs of ids with a hash and their links in texts of one part, and the part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = _aligner(byte_file, piece_file), TaskContext.get().partitionId()
        times, done = np.zeros(0, np.int64), []

        def flush() -> None:
            nonlocal times
            weights = np.repeat(times, np.diff(aligner.begins)[: len(times)])
            pairs, inverse = np.unique(aligner.pairs[: len(weights)], return_inverse=True)
            n = np.bincount(inverse, weights, len(pairs)).astype(np.int64)
            pairs, n = pairs[n > 0], n[n > 0]
            done.append(pa.RecordBatch.from_pydict({"pair": pairs.astype(np.int64), "h": _hash(pairs).astype(np.int64), "n": n, "part": np.full(len(n), part)}))
            times = np.zeros(0, np.int64)

        def forget() -> None:
            flush()
            aligner.trim()

        for batch in batches:
            for rows in _aligned(aligner, batch.column("text").to_pylist(), forget):
                found = np.bincount(np.concatenate([np.zeros(0, np.int64), *(of for _, of in rows)]), minlength=len(aligner.groups))
                found[: len(times)] += times
                times = found
                yield from done
                done.clear()
        flush()
        yield from done

    return docs.select("text").mapInArrow(count, "pair long, h long, n long, part long")


def _hash(pairs: np.ndarray) -> np.ndarray:
    """What deals pairs into buckets, within 63 bits."""
    return common.mix(pairs.astype(np.uint64)) >> np.uint64(1)


def perfect(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pilots of a minimal perfect hash of different keys (uint64), and the keys in the order of their slots."""
    n = len(keys)
    h = common.mix(keys ^ _SECOND)
    groups = n // 3 + 1
    of = (h % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=groups)
    begins = np.cumsum(sizes) - sizes
    pilots, slots, free = np.zeros(groups, np.int32), np.empty(n, np.int64), np.ones(n, bool)
    for g in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[g])
        own = order[begins[g] : begins[g] + size]
        if size == 1:
            break
        at = 0
        while size:
            tried = common.mix(h[own][None, :] + np.arange(at, at + 256, dtype=np.uint64)[:, None] * _ODD) % np.uint64(n)
            fits = free[tried.astype(np.int64)].all(1)
            spread = np.sort(tried[fits], 1)
            apart = (spread[:, 1:] != spread[:, :-1]).all(1)
            if apart.any():
                pilots[g] = at + int(np.flatnonzero(fits)[np.argmax(apart)])
                slots[own] = tried[pilots[g] - at].astype(np.int64)
                free[slots[own]] = False
                break
            at += 256
    alone = np.flatnonzero(sizes == 1)
    slots[order[begins[alone]]] = left = np.flatnonzero(free)
    pilots[alone] = -1 - left
    placed = np.empty(n, np.uint64)
    placed[slots] = keys
    return pilots, placed


def _slots(pairs: np.ndarray, pilots: np.ndarray, first: np.ndarray, groups: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The slots of pairs in their buckets, which have `groups` pilots from `first` on and n keys."""
    h = common.mix(pairs ^ _SECOND)
    pilot = pilots[first + (h % groups.astype(np.uint64)).astype(np.int64)].astype(np.int64)
    far = common.mix(h + np.maximum(pilot, 0).astype(np.uint64) * _ODD) % n.astype(np.uint64)
    return np.where(pilot < 0, -1 - pilot, far.astype(np.int64))


def counts(parts: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, int, int]:
    """The count vectors of counted() parts: a row for each bucket with its pilots, keys and counts; buckets and pairs."""
    different = common.saved(parts.select("pair", "h").distinct(), scratch)
    pairs = different.count()
    buckets = max(1, pairs // BUCKET)

    def functions(table: pa.Table) -> pa.Table:
        pilots, keys = perfect(np.sort(table.column("pair").to_numpy()).astype(np.uint64))
        return pa.table({"bucket": table.column("bucket")[:1], "pilots": [pilots.tobytes()], "keys": [keys.tobytes()]})

    bucket = (F.col("h") % buckets).alias("bucket")
    made = common.saved(different.select("pair", bucket).groupBy("bucket").applyInArrow(functions, "bucket long, pilots binary, keys binary"), scratch)
    wide = int(parts.agg(F.max("part")).first()[0] or 0) // FAN + 1

    def vector(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        pilots, keys = (np.frombuffer(right.column(c)[0].as_py(), kind) for c, kind in (("pilots", np.int32), ("keys", np.uint64)))
        pair = left.column("pair").to_numpy().astype(np.uint64)
        slot = _slots(pair, pilots, np.zeros(len(pair), np.int64), np.full(len(pair), len(pilots)), np.full(len(pair), len(keys)))
        if not (keys[slot] == pair).all():
            raise ValueError("a pair is not in the slot of its hash")
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, slot, left.column("n").to_numpy())
        return pa.table({"bucket": left.column("bucket")[:1], "part": left.column("part")[:1], "counts": [sums.tobytes()]})

    def added(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"bucket": table.column("bucket")[:1], "part": table.column("part")[:1], "counts": [sums.tobytes()]})

    part = F.floor(F.col("part") / FAN).cast("long").alias("part")
    each = made.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))))
    vectors = parts.select("pair", "n", bucket, part).groupBy("bucket", "part").cogroup(each.groupBy("bucket", "part")).applyInArrow(vector, "bucket long, part long, counts binary")
    while wide > 1:
        wide = (wide - 1) // FAN + 1
        vectors = vectors.select("bucket", "counts", part).groupBy("bucket", "part").applyInArrow(added, "bucket long, part long, counts binary")
    return common.saved(made.join(vectors.drop("part"), "bucket"), scratch), buckets, pairs


def _best(vectors: DataFrame) -> np.ndarray:
    """The highest count of each id of the second vocabulary; as many entries as it has."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys"), batch.column("counts")):
                b, n = (np.frombuffer(keys.as_py(), np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64), np.frombuffer(n.as_py(), np.int64)
                top = np.zeros(b.max() + 1, np.int64)
                np.maximum.at(top, b, n)
                there = np.flatnonzero(top)
                yield pa.RecordBatch.from_pydict({"b": there, "n": top[there]})

    rows = vectors.select("keys", "counts").mapInArrow(highest, "b long, n long").groupBy("b").agg(F.max("n")).collect()
    best = np.zeros(max([0, *(r[0] for r in rows)]) + 1, np.int64)
    for b, n in rows:
        best[b] = n
    return best


class Table:
    """All functions, keys and counts, as the workers look pairs up."""

    def __init__(self, rows: list, buckets: int, best: np.ndarray):
        by = {r["bucket"]: r for r in rows}
        at = {name: [np.frombuffer(by[i][name], kind) if i in by else np.zeros(0, kind) for i in range(buckets)] for name, kind in (("pilots", np.int32), ("keys", np.uint64), ("counts", np.int64))}
        self.pilots, self.keys, self.counts = (np.concatenate(at[name]) for name in ("pilots", "keys", "counts"))
        self.groups, self.n = (np.array([len(x) for x in at[name]]) for name in ("pilots", "keys"))
        self.first, self.begin, self.best = np.cumsum(self.groups) - self.groups, np.cumsum(self.n) - self.n, best

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        """The counts of pairs; 0 for those that are not in the corpus (a worker may remember stretches of others)."""
        bucket = (_hash(pairs) % np.uint64(len(self.n))).astype(np.int64)
        there = self.n[bucket] > 0
        found = np.zeros(len(pairs), np.int64)
        pairs, bucket = pairs[there], bucket[there]
        slot = self.begin[bucket] + _slots(pairs, self.pilots, self.first[bucket], self.groups[bucket], self.n[bucket])
        found[there] = np.where(self.keys[slot] == pairs, self.counts[slot], 0)
        return found


def _results(docs: DataFrame, byte_file: str, piece_file: str, table) -> DataFrame:
    """Second pass. With a broadcast Table its counts are looked up; without, each row carries its pairs and their links."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, found = _aligner(byte_file, piece_file), table and table.value
        for batch in batches:
            sums, digests, pairs = np.zeros((batch.num_rows, 6), np.int64), {}, {}
            for rows in _aligned(aligner, batch.column("text").to_pylist(), aligner.trim):
                if found and len(aligner.scores) < len(aligner.groups):  # links with the highest count, sum of counts
                    from_, upto = len(aligner.scores), len(aligner.groups)
                    fresh = aligner.pairs[aligner.begins[from_] :]
                    n = found(fresh)
                    of = np.repeat(np.arange(upto - from_), np.diff(aligner.begins[from_:]))
                    ids = (fresh & np.uint64(0xFFFFFFFF)).astype(np.int64)  # those beyond best are of other tables only
                    top = n == found.best[np.minimum(ids, len(found.best) - 1)]
                    total = np.zeros(upto - from_, np.int64)
                    np.add.at(total, of, n)
                    aligner.scores = np.concatenate([aligner.scores, np.stack([np.bincount(of, top, upto - from_).astype(np.int64), total], 1)])
                for row, of in rows:
                    sums[row, :4] += aligner.sizes[of].sum(0)
                    if row in digests:
                        digests[row].update(b";")
                    digests.setdefault(row, hashlib.sha256()).update(b";".join(map(aligner.groups.__getitem__, of.tolist())))
                    if found:
                        sums[row, 4:] += aligner.scores[of].sum(0)
                    else:
                        spans = [aligner.pairs[aligner.begins[i] : aligner.begins[i + 1]] for i in of.tolist()]
                        pairs.setdefault(row, []).append(np.concatenate(spans))
            if found and (sums[:, 5] < sums[:, 3]).any():
                raise ValueError("a pair was not counted in the first pass")
            out = {"doc_id": batch.column("doc_id")} | {name: sums[:, i] for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))}
            out["groups_sha256"] = [digests[i].hexdigest() if i in digests else "" for i in range(batch.num_rows)]
            if not found:
                each = [np.unique(np.concatenate(pairs[i]), return_counts=True) if i in pairs else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for i in range(batch.num_rows)]
                out["pairs"] = pa.array([x.astype(np.int64) for x, _ in each], pa.list_(pa.int64()))
                out["times"] = pa.array([x for _, x in each], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, COLUMNS if table else f"{COLUMNS}, pairs array<long>, times array<long>")


def _joined(rows: DataFrame, vectors: DataFrame, best: np.ndarray, scratch: common.Scratch) -> DataFrame:
    """The sums of rows that carry their pairs, by a join with the counts."""
    spark = rows.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys"), batch.column("counts")):
                yield pa.RecordBatch.from_pydict({"pair": np.frombuffer(keys.as_py(), np.int64), "n": np.frombuffer(n.as_py(), np.int64)})

    top = spark.createDataFrame([(i, int(n)) for i, n in enumerate(best)], "b long, most long")  # an entry for each id of the vocabulary
    known = vectors.select("keys", "counts").mapInArrow(spread, "pair long, n long").withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    rows = common.saved(rows.withColumn("row", F.monotonically_increasing_id()), scratch)  # written, so that a row keeps its number
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    joined = rows.drop("pairs", "times", "n_best", "count_sum").join(sums, "row", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """For each row of docs (doc_id, text) its tokens, groups and links, and how usual the links are in all of docs."""
    scratch = common.Scratch()
    parts = common.saved(counted(docs, byte_file, piece_file), scratch)
    vectors, buckets, pairs = counts(parts, scratch)
    best = _best(vectors)
    if pairs <= TABLE_PAIRS:
        table = docs.sparkSession.sparkContext.broadcast(Table(vectors.collect(), buckets, best))
        out = _results(docs, byte_file, piece_file, table)
    else:
        out = _joined(_results(docs, byte_file, piece_file, None), vectors, best, scratch)
    out = common.saved(out)
    scratch.clear(docs.sparkSession)
    return out


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between the byte-level BPE and the SentencePiece vocabulary."""
    return align(common.table(spark, sf_dir, "documents"))
