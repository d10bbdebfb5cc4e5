"""Operator 2: benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages. A randomised singular value decomposition of their TF-IDF matrix (hashed terms, document
frequencies over all documents) gives one latent space for all items, of half as many dimensions as passages and at most RANK;
the products run over the rows in Spark and the sketches have a fixed size. Every document is cut into overlapping windows of WINDOW words, one at each STRIDE words, which are
folded into that space and compared with all passages by cosine. A passage's threshold is calibrated on all documents: it is the
mean cosine of trial windows that keep PARAPHRASE of its words (in TRIALS ways) beside a stretch of a document, over all stretches of
all documents, less SIGMAS deviations and MARGIN. A window at or above it is a candidate,
and its surroundings are verified by the longest common subsequence of words with the passage: a share of VERBATIM is
contaminated, one of PARAPHRASE only if it also holds the answer, the passage's rarest words. All terms have weight: the least
is LEAST of the largest, so words made frequent by many copies of a leak still count. All documents are read once for
frequencies, once for thresholds and once for the search, whatever the number of items (up to PASSAGES passages are broadcast, about 1 KB
each; a larger benchmark takes another calibration and search per PASSAGES). A passage of fewer than CERTAIN words counts only where all of them stand
one after the other, one of fewer than FEWEST never: such words stand in clean texts by chance. Cases: null or empty texts are never contaminated, items without words are never
found; repeated rows give repeated results; equal cosines are all candidates; an empty benchmark or table gives an empty
result; other columns are not looked at by contaminated() and are kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
#: Words of a window of a document, words between windows, and words of a benchmark passage.
WINDOW, STRIDE, PASSAGE = 64, 16, 48
RANK, OVER, POWERS, SEED = 64, 16, 2, 17
#: Trial windows of a passage, deviations and what else is taken off their mean cosine, passages of one search, terms of one slice of a sum.
TRIALS, SIGMAS, MARGIN, PASSAGES, SLICE = 12, 2, 0.05, 100_000, 1024
VERBATIM, PARAPHRASE, ANSWER_WORDS, ANSWER_SHARE = 0.8, 0.6, 6, 0.7
#: Smallest weight of a term, against the largest.
LEAST = 0.1
#: Passages of fewer words are no sign of contamination; those of fewer than CERTAIN only if they stand there word for word.
FEWEST, CERTAIN = 5, 12


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed term stands, and the number of documents; summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for part, data, offsets in common.steps(batches):
            words, _, _, first = common.word_hashes(data, offsets)
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            seen = np.unique(text * BUCKETS + _terms(words))
            total += np.bincount(seen % BUCKETS, minlength=BUCKETS)
            rows += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[at], rows])], ["term", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (sums.column(c).to_numpy() for c in ("term", "n"))
    df = np.zeros(BUCKETS, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def weights(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequencies between LEAST and 1."""
    return LEAST + (1 - LEAST) * np.log((n_docs + 1) / (frequencies + 1)) / max(np.log(n_docs + 1), 1e-9)


def passages_of(words: np.ndarray) -> list[np.ndarray]:
    """An item's words in passages of about PASSAGE."""
    return np.array_split(words, max(1, round(len(words) / PASSAGE))) if len(words) else []


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    for part, data, offsets in common.steps(batches):
        words, _, _, first = common.word_hashes(data, offsets)
        for item, a, b in zip(part.column("item_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield item, words[a:b]


def _passages(benchmark: DataFrame) -> DataFrame:
    """item_id and words of all passages."""

    def run(batches):
        for item, words in _items(batches):
            for p in passages_of(words):
                yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), pa.array([p.tobytes()], pa.binary())], ["item_id", "words"])

    return benchmark.mapInArrow(run, "item_id long, words binary")


def latent_space(passages: DataFrame, weight: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the passages (words), and what folds a text in: right singular vectors over their singular values, times weights.

    Each product with the TF-IDF matrix is a pass over its rows in Spark; sums of slices of terms meet there too."""
    context = passages.sparkSession.sparkContext

    def terms_of(batches):
        seen = np.zeros(BUCKETS, bool)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for raw in batch.column("words"):
                seen[_terms(np.frombuffer(raw.as_buffer(), np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.flatnonzero(seen), -1]), pa.array(np.r_[np.ones(int(seen.sum()), np.int64), rows])], ["term", "n"])

    got = passages.select("words").mapInArrow(terms_of, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    used = np.sort(np.array([r["term"] for r in got if r["term"] >= 0], np.int64))
    if not len(used):
        return used, np.zeros((1, 1), np.float32)
    rank = max(1, min(rank, sum(r["n"] for r in got if r["term"] < 0) // 2, len(used)))

    def times(right: np.ndarray) -> np.ndarray:
        """matrix^T (matrix right)."""
        shared = context.broadcast(right)

        def multiply(batches):
            right = shared.value
            total = np.zeros(right.shape)
            for batch in batches:
                for raw in batch.column("words"):
                    at, n = np.unique(_terms(np.frombuffer(raw.as_buffer(), np.uint64)), return_counts=True)
                    row = _unit((1 + np.log(n)) * weight[at])
                    at = np.searchsorted(used, at)
                    total[at] += np.outer(row, row @ right[at])
            cut = [(s, total[s : s + SLICE].tobytes()) for s in range(0, len(used), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), pa.array([c[1] for c in cut], pa.binary())], ["slice", "sums"])

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, raw in zip(batch.column("slice").to_pylist(), batch.column("sums"), strict=True):
                    own = np.frombuffer(raw.as_buffer())
                    sums[at] = sums[at] + own if at in sums else own
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "sums"])

        schema = "slice int, sums binary"
        out = np.zeros(right.shape)
        for at, raw in passages.select("words").mapInArrow(multiply, schema).repartition("slice").mapInArrow(add, schema).collect():
            out[at : at + SLICE] = np.frombuffer(raw).reshape(-1, right.shape[1])
        shared.unpersist()
        return out

    basis = np.random.default_rng(SEED).normal(size=(len(used), min(rank + OVER, max(len(used), 1))))
    for _ in range(POWERS):
        basis, _ = np.linalg.qr(times(basis))
    small = basis.T @ times(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(values)[::-1][:rank]
    fold = basis @ vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-6 * values[top[0]]))
    return used, np.vstack((fold * weight[used][:, None], np.zeros((1, rank)))).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


@dataclass
class Index:
    """Passages in the latent space."""

    lookup: np.ndarray  # of each bucket: its row in terms, the last one (zeros) if it has none
    terms: np.ndarray  # what each term adds to a window
    vectors: np.ndarray  # unit vectors of the passages
    least: np.ndarray  # least cosine of a candidate, for each passage
    items: list  # item of each passage
    words: list[np.ndarray]  # of each passage
    answers: list[set[int]]
    known: np.ndarray  # table of hashed (passage, word); may say yes too often, never no

    def places(self, passage: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (common.mix(word + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(len(self.known) - 1)).astype(np.int64)


def index_of(benchmark: DataFrame, docs: DataFrame, weight: np.ndarray) -> Iterator[Index]:
    """Indexes of at most PASSAGES passages each; vectors and thresholds are worked out in Spark, thresholds with all words of all docs."""
    passages = common.saved(_passages(benchmark).repartition(8))
    used, terms = latent_space(passages, weight)
    if not len(used):
        return
    lookup = np.full(BUCKETS, len(used), np.int32)
    lookup[used] = np.arange(len(used))
    shared = benchmark.sparkSession.sparkContext.broadcast((lookup, terms))

    def run(batches):
        lookup, terms = shared.value
        for batch in batches:
            vectors, trials = [], []
            for raw in batch.column("words"):
                words = np.frombuffer(raw.as_buffer(), np.uint64)
                rng = np.random.default_rng(int(words[0]))
                own = terms[lookup[_terms(words)]]
                vector = _unit(own.sum(0))
                kept = np.stack([own[rng.permutation(len(own))[: _kept(len(own))]].sum(0) for _ in range(TRIALS)])
                vectors.append(vector.tobytes())
                trials.append(np.stack([kept @ vector, (kept * kept).sum(1)]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("words"), pa.array(vectors, pa.binary()), pa.array(trials, pa.binary())], ["item_id", "words", "vector", "trials"])

    found: list = []
    for r in passages.mapInArrow(run, "item_id long, words binary, vector binary, trials binary").orderBy("item_id", "words").toLocalIterator():
        found.append(r)
        if len(found) == PASSAGES:
            yield _index(found, lookup, terms, weight, docs)
            found = []
    if found:
        yield _index(found, lookup, terms, weight, docs)


def _kept(n: int) -> int:
    """Words that a trial window keeps of a passage of n words."""
    return int(np.ceil(PARAPHRASE * n))


def thresholds(docs: DataFrame, lookup: np.ndarray, terms: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, trials: np.ndarray) -> np.ndarray:
    """Least cosine of a candidate for each passage: SIGMAS deviations and MARGIN below the mean over trial windows with the words of all documents.

    Every document is cut into stretches of as many words as a window has besides those kept of a passage (to the next eight), and each takes its turn
    with the trials (what kept words add along the passage, and their square): sums of fixed size, no draw of documents."""
    shared = docs.sparkSession.sparkContext.broadcast((lookup, terms, vectors, lengths, trials))

    def run(batches):
        lookup, terms, vectors, lengths, trials = shared.value
        beside = np.array([-(-(max(WINDOW, n) - _kept(n)) // 8) * 8 for n in lengths.tolist()])  # few kinds of stretches
        groups = [(n, g[s : s + 1024]) for n in np.unique(beside).tolist() for g in [np.flatnonzero(beside == n)] for s in range(0, len(g), 1024)]
        sums = np.zeros((3, len(vectors)))
        for _, data, offsets in common.steps(batches):
            words, _, _, first = common.word_hashes(data, offsets)
            first = first[np.r_[True, first[1:] > first[:-1]]]  # texts with words
            if not len(words):
                continue
            row = lookup[_terms(words)]
            known = row != len(terms) - 1
            upto = np.r_[0, np.cumsum(known)]
            running = np.zeros((upto[-1] + 1, terms.shape[1]))
            np.cumsum(terms[row[known]], axis=0, out=running[1:], dtype=np.float64)
            cut = None
            for n, own in groups:
                if n != cut:
                    cut, counts = n, -(-np.diff(first) // n)
                    of = np.repeat(np.arange(len(counts)), counts)
                    at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                    begin = np.maximum(first[of], np.minimum(first[of] + n * at, first[of + 1] - n))
                    noise = (running[upto[np.minimum(begin + n, first[of + 1])]] - running[upto[begin]]).astype(np.float32)
                    square, turn = (noise * noise).sum(1)[:, None], np.arange(len(of)) % TRIALS
                along = noise @ vectors[own].T
                kept, kept_square = trials[own, 0].T[turn], trials[own, 1].T[turn]
                # kept words lie on average along the passage, so what they share with the noise is what the passage shares with it
                cosine = (kept + along) / np.sqrt(np.maximum(kept_square + 2 * kept * along + square, 1e-9))
                sums[:, own] += np.stack([np.full(len(own), len(of)), cosine.sum(0, dtype=np.float64), (cosine * cosine).sum(0, dtype=np.float64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vectors))), *(pa.array(x) for x in sums)], ["passage", "n", "one", "two"])

    total = docs.select("text").mapInArrow(run, "passage long, n double, one double, two double").groupBy("passage").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")]).toArrow()
    at, n, one, two = (total.column(c).to_numpy() for c in ("passage", "n", "one", "two"))
    mean = one / np.maximum(n, 1)
    least = np.zeros(len(vectors), np.float32)
    least[at] = mean - SIGMAS * np.sqrt(np.maximum(two / np.maximum(n, 1) - mean * mean, 0)) - MARGIN
    shared.unpersist()
    return least


def _index(found: list, lookup: np.ndarray, terms: np.ndarray, weight: np.ndarray, docs: DataFrame) -> Index:
    words = [np.frombuffer(r["words"], np.uint64) for r in found]
    answers = [set(list(dict.fromkeys(w[np.argsort(-weight[_terms(w)], kind="stable")].tolist()))[:ANSWER_WORDS]) for w in words]
    size = 1 << max(16, int(np.ceil(np.log2(16 * sum(map(len, words))))))
    vectors, trials = np.stack([np.frombuffer(r["vector"], np.float32) for r in found]), np.stack([np.frombuffer(r["trials"], np.float32).reshape(2, TRIALS) for r in found])
    least = thresholds(docs, lookup, terms, vectors, np.array(list(map(len, words))), trials)
    index = Index(lookup, terms, vectors, least, [r["item_id"] for r in found], words, answers, np.zeros(size, bool))
    index.known[index.places(np.repeat(np.arange(len(words)), list(map(len, words))), np.concatenate(words))] = True
    return index


def common_words(item: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits: one machine-long step for each word of other."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in other.tolist():
        m = places.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def _verbatim(item: np.ndarray, other: np.ndarray) -> bool:
    """Whether the words of item stand in other one after the other."""
    begins = np.flatnonzero(other[: max(0, len(other) - len(item) + 1)] == item[0])
    return any((other[b : b + len(item)] == item).all() for b in begins.tolist())


def windows_of(terms: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of all windows, and the text and first word of each."""
    counts = np.diff(first)
    blocks = -(-counts // STRIDE)
    block_first = np.concatenate(([0], np.cumsum(blocks)))
    of = np.repeat(np.arange(len(counts)), blocks)
    begin = first[of] + STRIDE * (np.arange(block_first[-1]) - block_first[of])
    if not len(begin):
        return np.zeros((0, vectors.shape[1]), np.float32), of, begin
    sums = np.zeros((len(begin) + WINDOW // STRIDE, vectors.shape[1]), np.float32)
    known = np.flatnonzero(terms != len(vectors) - 1)  # the others add nothing
    start = np.searchsorted(known, np.append(begin, len(terms)))
    some = np.flatnonzero(start[1:] > start[:-1])
    if len(some):
        sums[some] = np.add.reduceat(vectors[terms[known]], start[some], axis=0)
    out = sums[: len(begin)].copy()
    last = block_first[1:][of]
    for k in range(1, WINDOW // STRIDE):
        there = (np.arange(len(begin)) + k < last)[:, None]
        out += sums[k : len(begin) + k] * there
    return _unit(out), of, begin


def _found(words: np.ndarray, first: np.ndarray, index: Index) -> list[tuple[int, int, float, float, int]]:
    """Of each text: (text, passage, cosine, share of the passage in common order, word at which its surroundings begin)."""
    vectors, of, begin = windows_of(index.lookup[_terms(words)], first, index.terms)
    lengths = np.array(list(map(len, index.words)))
    best: dict[tuple[int, int], tuple[int, float, float, int]] = {}
    for p0 in range(0, len(index.vectors), 1024):
        near = vectors @ index.vectors[p0 : p0 + 1024].T
        w, p = np.nonzero(near >= index.least[p0 : p0 + 1024])
        cosine = near[w, p]
        p = p + p0
        low, high = np.maximum(begin[w] - STRIDE, first[of[w]]), np.minimum(begin[w] + WINDOW + STRIDE, first[of[w] + 1])
        for s in range(0, len(w), 1 << 12):  # no subsequence is longer than the words that the passage has
            cut = slice(s, s + (1 << 12))
            at = low[cut, None] + np.arange(WINDOW + 2 * STRIDE)
            inside = at < high[cut, None]
            held = (index.known[index.places(p[cut, None], words[np.minimum(at, len(words) - 1)])] & inside).sum(1)
            for c in (s + np.flatnonzero(held >= PARAPHRASE * lengths[p[cut]])).tolist():
                text, passage, lo, around = int(of[w[c]]), int(p[c]), int(low[c]), words[low[c] : high[c]]
                share = common_words(index.words[passage], around) / len(index.words[passage])
                answer = index.answers[passage]
                if lengths[passage] < CERTAIN:
                    if lengths[passage] < FEWEST or not _verbatim(index.words[passage], around):
                        continue
                if share >= VERBATIM or (share >= PARAPHRASE and len(answer & set(around.tolist())) >= ANSWER_SHARE * len(answer)):
                    key = (text, index.items[passage])
                    if key not in best or share > best[key][2]:
                        best[key] = (passage, float(cosine[c]), share, lo - int(first[text]))
    return [(text, *v) for (text, _), v in sorted(best.items(), key=lambda x: (x[0][0], x[1][0]))]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share of a passage of the item found in order, and the word near which, for each contaminated document and item."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    frequencies, n_docs = document_frequencies(rows)
    weight = weights(frequencies, n_docs)
    schema = "doc_id long, item_id long, cosine double, common double, near_word long"
    out = rows.limit(0).selectExpr("doc_id", "doc_id as item_id", "double(doc_id) as cosine", "double(doc_id) as common", "doc_id as near_word")
    for index in index_of(items, rows, weight):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for part, data, offsets in common.steps(batches):
                words, _, _, first = common.word_hashes(data, offsets)
                found = _found(words, first, index)
                own = part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                columns = [pa.array([index.items[f[1]] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3)), pa.array([f[4] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([own, *columns], ["doc_id", "item_id", "cosine", "common", "near_word"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs that hold no item of the benchmark; rows with a null doc_id are judged by their text."""
    own = F.xxhash64("doc_id", "text")
    dirty = common.saved(contaminated(docs.select(own.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_found_row")).distinct())
    return docs.join(dirty, own == F.col("_found_row"), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contaminated documents with the benchmark items that they hold."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
