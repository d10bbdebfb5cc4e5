"""Operator 10: language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are byte triples of the text with letters lower-cased and every run of other ASCII characters as one boundary;
they are hashed into BUCKETS embeddings, whose average goes through a linear softmax. Embeddings and weights are trained by
stochastic gradient descent in numpy on at most TRAIN_ROWS labelled rows chosen by hash (documented bound, in the driver);
a part of them calibrates a temperature and two bounds for rejection: a score that only REJECT_SHARE of them are below, and
how unlikely a text's subwords may be in its predicted language (a mean log probability below that of the calibration rows by
DEVIATIONS of their own spread and of what the text's length allows; junk has subwords, but not a language's). Prediction runs over all whole
texts in the tasks with the product of embeddings and weights and the languages' subword probabilities, tables of fixed size. Only text and lang are learned from;
only text is predicted from. Cases: a null text or one without a letter is "und" with score 0 (and rejected); without
labelled rows every text is "und"; of equal scores the language first in the alphabet wins; repeated rows give equal rows and
do not widen the sample; other columns are kept by with_language(), whose own replace columns of their names, and all columns
are kept by accepted().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, DIMENSIONS, TRAIN_ROWS, EPOCHS, BATCH, RATE, SEED = 4096, 16, 3000, 12, 32, 0.5, 3
#: Share of the calibration rows whose score lies below the bound, and standard deviations that subwords may be less likely.
REJECT_SHARE, DEVIATIONS = 0.002, 4.0

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # of each bucket: the logits that it adds
    bias: np.ndarray
    temperature: float
    reject_below: float
    likely: np.ndarray  # of each bucket: its log probability in each language
    usual: np.ndarray  # of each language: mean over its calibration rows, spread of rows, spread of subwords


def held_out(doc_id: Column, modulus: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 0, F.lit(False))


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the triples of all texts, and each text's first triple (one more entry than texts)."""
    folded = _FOLD[data]
    upper = np.flatnonzero((data[1:] < 0x9F) & (data[1:] >= 0x80) & (data[:-1] == 0xC3)) + 1  # capital Latin-1 letters
    folded[upper] += 0x20
    blank = folded == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    padded = np.full(int(keep.sum()) + 2 * (len(offsets) - 1), 0x20, np.uint8)
    before = np.concatenate(([0], np.cumsum(keep)))[offsets]
    at = np.flatnonzero(keep)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    padded[np.arange(len(at)) + 2 * text_of + 1] = folded[at]
    wide = padded.astype(np.uint32)
    triple = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761) if len(wide) > 2 else np.zeros(0, np.uint32)
    return (triple >> np.uint32(20)).astype(np.int32), before + 2 * np.arange(len(offsets))


def _sums(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over each text's triples, and their number; a text's two last triples reach into the next and are left out."""
    running = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=running[1:])
    lo, hi = first[:-1], np.maximum(first[:-1], first[1:] - 2)
    return running[hi] - running[lo], hi - lo


def _counts(rows: DataFrame) -> DataFrame:
    """lang, and the buckets of the text with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in common.steps(batches):
            bucket, first = subwords(data, offsets)
            pairs = [np.unique(bucket[a : max(a, b - 2)], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([p[0].astype(np.uint16).tobytes() for p in pairs], pa.binary()), pa.array([p[1].astype(np.uint32).tobytes() for p in pairs], pa.binary())], ["lang", "buckets", "counts"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, buckets binary, counts binary")


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from rows of docs (doc_id, text, lang) that are not held out; None if there are none."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = [r[0] for r in usable.select(order.alias("at")).orderBy("at").limit(train_rows).collect()]
    if not chosen:
        return None
    few = usable.filter(order <= chosen[-1]).select("lang", F.col("text").cast("string").alias("text"), order.alias("at")).orderBy("at", F.xxhash64("text"), "lang").limit(train_rows)
    got = _counts(few).orderBy("lang", "buckets", "counts").collect()
    languages = sorted({r["lang"] for r in got})
    label = np.array([languages.index(r["lang"]) for r in got])
    weights = []
    for r in got:
        counts = np.frombuffer(r["counts"], np.uint32).astype(np.float32)
        weights.append((np.frombuffer(r["buckets"], np.uint16).astype(np.int64), counts / max(1.0, counts.sum())))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(got))
    calibration, learn = order[: len(got) // 5], order[len(got) // 5 :] if len(got) >= 5 else order
    embed, out, bias = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    dense = np.zeros((BATCH, BUCKETS))
    for epoch in range(EPOCHS):
        rng.shuffle(learn)
        rate = RATE * (1 - epoch / EPOCHS)
        for s in range(0, len(learn), BATCH):
            rows = learn[s : s + BATCH]
            x = dense[: len(rows)]
            x[:] = 0
            for k, i in enumerate(rows):
                x[k, weights[i][0]] = weights[i][1]
            mean = x @ embed
            error = _softmax(mean @ out + bias)
            error[np.arange(len(rows)), label[rows]] -= 1
            back = error @ out.T
            out -= rate * mean.T @ error
            bias -= rate * error.mean(0) * 0.1
            embed -= rate * BATCH * (x.T @ back) / len(rows)
    table = embed @ out
    some = calibration if len(calibration) else learn
    logits = np.array([w @ table[b] for b, w in (weights[i] for i in some)]) + bias
    temperature = min((0.1 * 1.25**k for k in range(25)), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(some)), label[some]] + 1e-12).mean())
    score = _softmax(logits / temperature).max(1)
    seen = np.full((BUCKETS, len(languages)), 0.1)
    for i in learn:
        np.add.at(seen[:, label[i]], weights[i][0], np.frombuffer(got[i]["counts"], np.uint32))
    likely = np.log(seen / seen.sum(0))
    usual = np.zeros((3, len(languages)))
    for k in range(len(languages)):
        own = [i for i in some if label[i] == k] or [i for i in learn if label[i] == k]
        means = np.array([weights[i][1] @ likely[weights[i][0], k] for i in own])
        p = np.exp(likely[:, k])
        usual[:, k] = means.mean(), means.std(), np.sqrt(p @ likely[:, k] ** 2 - (p @ likely[:, k]) ** 2)
    return Model(languages, table, bias, float(temperature), float(np.quantile(score, REJECT_SHARE)), likely, usual)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _judge(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: number of the language, score, whether it has a letter, and whether the prediction is rejected."""
    bucket, first = subwords(data, offsets)
    sums, n = _sums(np.hstack([model.table, model.likely])[bucket], first)
    n = np.maximum(n, 1)
    means = sums / n[:, None]
    p = _softmax((means[:, : len(model.languages)] + model.bias) / model.temperature)
    best = p.argmax(1)
    ascii_letters = np.concatenate(([0], np.cumsum(_LETTERS[data])))[offsets]
    worded = np.diff(ascii_letters) > 0
    for i in np.flatnonzero(~worded):
        worded[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace").replace("\ufffd", "")))
    score = np.where(worded, p.max(1), 0.0)
    middle, spread, each = model.usual[:, best]
    strange = means[np.arange(len(best)), len(model.languages) + best] < middle - DEVIATIONS * (spread + each / np.sqrt(n))
    return best, score, worded, ~worded | (score < model.reject_below) | strange


def with_language(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected."""
    df = df.drop(*[c for c in ("lang_pred", "score", "rejected") if c in df.columns])
    if model is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    names = [*df.columns, "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in common.steps(batches, text):
            best, score, worded, rejected = _judge(model, data, offsets)
            said = pa.array([model.languages[b] if w else "und" for b, w in zip(best, worded, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, said, pa.array(score), pa.array(rejected)], names)

    return df.mapInArrow(run, common.wider(df, lang_pred="string", score="double", rejected="boolean"))


def accepted(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of df whose prediction is not rejected, with their own columns."""
    if model is None:
        return df.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in common.steps(batches, text):
            yield part.filter(pa.array(~_judge(model, data, offsets)[3]))

    return df.mapInArrow(run, df.schema)


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = common.table(spark, sf_dir, "documents")
    return with_language(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), train(docs)).drop("text")
