"""Operator 4: license scans by exact phrases and fuzzy short notices.

A text's words are its runs of digits, letters and non-ASCII characters, A-Z lower-cased; joined by single spaces they are
searched. Phrases are found word by word. A notice may differ in up to a share of its characters: it is split into one
more piece than errors allowed, so at least one piece must occur unchanged (pigeonhole); around each such seed the regex
library's bounded-error matching verifies the notice and reports its span. Cases: a null text is an empty one; texts
without words have no spans; repeated rows give equal rows; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices and their labels; each may have one error in ERROR_EVERY characters.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
ERROR_EVERY = 10
#: Surroundings of seeds whose search a text remembers, for each notice.
REMEMBERED = 10_000
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_SPACED = bytes(b if b in _WORD else 0x20 for b in bytes(range(256)).lower())


@lru_cache(maxsize=1)
def _plans() -> tuple[list, list]:
    """For each phrase and notice: what to look for."""
    phrases = [(p.split()[-1].encode(), regex.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label) for p, label in PHRASES.items()]
    notices = []
    for text, label in NOTICES.items():
        errors = len(text) // ERROR_EVERY
        cuts = [round(i * len(text) / (errors + 1)) for i in range(errors + 2)]
        seeds = [(text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]
        notices.append((label, len(text), errors, seeds, regex.compile(b"(?b)(?:" + text.encode() + b"){e<=%d}" % errors)))
    return phrases, notices


def spans_of(joined: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """Byte spans in the joined words: of phrases (start, stop, label), and of notices (start, stop, label, likeness)."""
    phrases, notices = _plans()
    base = [(m.start(), m.end(), label) for last, pattern, label in phrases if last in joined for m in pattern.finditer(joined)]
    fuzzy = {}
    for label, size, errors, seeds, pattern in notices:
        seen: dict[bytes, tuple[int, int, float] | None] = {}  # what was found in surroundings that were equal
        for seed, offset in seeds:
            at = joined.find(seed)
            while at >= 0:
                low = max(0, at - offset - errors)
                around = joined[low : max(0, at - offset + size + errors)]
                if around not in seen:
                    m = pattern.search(around)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[around] = (m.start(), m.end(), 1 - sum(m.fuzzy_counts) / size) if m and m.end() > m.start() else None
                if hit := seen[around]:
                    key = (low + hit[0], low + hit[1], label)
                    fuzzy[key] = max(fuzzy.get(key, 0.0), hit[2])
                at = joined.find(seed, at + 1)
    kept: list[tuple[int, int, str, float]] = []  # in order, none overlapping
    for (start, stop, label), like in sorted(fuzzy.items(), key=lambda x: (-x[1], x[0])):
        at = bisect_left(kept, (start,))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or stop <= kept[at][0]):  # of overlapping notices the likest stays
            kept.insert(at, (start, stop, label, like))
    return sorted(base), kept


def _placed(spans: list[tuple], names: tuple[str, ...], blanks: np.ndarray) -> list[dict]:
    """Spans of bytes as spans of words, by the places of the blanks between words."""
    starts = np.searchsorted(blanks, [s[0] for s in spans]).tolist()
    stops = (np.searchsorted(blanks, [max(s[0], s[1] - 1) for s in spans]) + 1).tolist()
    return [dict(zip(names, (a, b, *s[2:]), strict=True)) for a, b, s in zip(starts, stops, spans)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and arrays of spans in words (start, stop, label): of phrases, and of notices with their likeness."""
    schema = "doc_id long, n_words long, phrases array<struct<start:long,stop:long,label:string>>, notices array<struct<start:long,stop:long,label:string,likeness:double>>"
    plain = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))
    graded = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("likeness", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in common.steps(batches):
            raw = data.tobytes().translate(_SPACED)
            counts, phrases, notices = [], [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = raw[lo:hi].split()
                joined = b" ".join(words)
                base, fuzzy = spans_of(joined)
                blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20) if base or fuzzy else np.zeros(0, int)
                counts.append(len(words))
                phrases.append(_placed(base, ("start", "stop", "label"), blanks))
                notices.append(_placed(fuzzy, ("start", "stop", "label", "likeness"), blanks))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(phrases, plain), pa.array(notices, graded)], ["doc_id", "n_words", "phrases", "notices"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    found = scan(common.table(spark, sf_dir, "documents"))
    base, more = F.col("phrases.label"), F.col("notices.label")
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.col("phrases.start")
    score = F.greatest(F.when(F.size("phrases") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.col("notices.likeness")), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"), score.alias("score"), "notices",
    )
