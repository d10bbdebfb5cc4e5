"""Operator 7: SentencePiece encoding and decoding with a piece file of a public tokenizer (never trained here).

An Aho-Corasick automaton over the pieces reads a text once; at each position it follows its output links to all pieces
that end there, and each relaxes the best score of the position (Viterbi). Spaces become the mark U+2581, one more is put
before the text, and characters without a piece (a mark in the text too) become their UTF-8 bytes' pieces, so decoding gives
back every text exactly. Piece files of the BPE kind hold ranks in place of scores, so a piece's score is the log probability
that the Zipf-Mandelbrot law gives its rank, 1 / (rank + RANK_SHIFT); files of the unigram kind hold log probabilities, which are
taken as they are. Control, unknown and byte pieces are not matched; a placeholder score counts as the last rank. As no piece goes on
over a mark after another character, the best path of a text is that of its stretches (marks, then other characters), which
are remembered per worker, within CACHE entries. New short stretches of many texts go through the automaton side by side, one
character of each at a time, with its states in tables (Side); long ones go one by one. Cases: a null text gives null ids, an empty one no ids; repeated rows
give equal ids; other columns are kept by encode() and decode().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 150_000
#: Characters of a stretch that is remembered, and how many new stretches are read side by side.
SHORT, ABREAST = 64, 1 << 14
MARK = "▁"
#: Scores are whole numbers, log probabilities times SCALE, so that sums are exact; that of a byte piece.
SCALE, BYTE_SCORE = 10**6, -(10**9)
#: Added to ranks before their logarithm is taken.
RANK_SHIFT = 100
_NONE = float("-inf")
_STRETCH = re.compile(" *[^ ]+| +")


class Side:
    """The automaton as tables, which reads many stretches side by side."""

    def __init__(self, words: dict[str, tuple[int, int, int]]):
        edges: dict[tuple[int, str], int] = {}
        ends = {}
        for word, value in words.items():
            state = 0
            for c in word:
                state = edges.setdefault((state, c), len(edges) + 1)
            ends[state] = value
        n = len(edges) + 1
        #: Of each state: its longest proper suffix that is a state, and the longest piece that ends there; of that piece, the next shorter one.
        self.fail = np.zeros(n, np.int64)
        self.output, self.shorter = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.length, self.score, self.id = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for state, value in ends.items():
            self.length[state], self.score[state], self.id[state] = value
        depth = [0] * n
        for (state, _), child in edges.items():  # a parent comes before its children
            depth[child] = depth[state] + 1
        fail, output, shorter = [0] * n, [0] * n, [0] * n
        for (state, c), child in sorted(edges.items(), key=lambda e: depth[e[1]]):
            at = state
            while at:
                at = fail[at]
                if (at, c) in edges:
                    fail[child] = edges[at, c]
                    break
            shorter[child] = output[fail[child]]
            output[child] = child if child in ends else shorter[child]
        self.fail[:], self.output[:], self.shorter[:] = fail, output, shorter
        keys = np.array([state << 21 | ord(c) for state, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.first = np.zeros(0x110000, np.int32)  # children of the root
        for (state, c), child in edges.items():
            if not state:
                self.first[ord(c)] = child

    def _steps(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        state, out = state.copy(), self.first[code].astype(np.int64)
        left = np.flatnonzero(state)
        while len(left):
            keys = state[left] << 21 | code[left]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            there = self.keys[at] == keys
            out[left[there]] = self.child[at[there]]
            left = left[~there]
            state[left] = self.fail[state[left]]
            left = left[state[left] > 0]
        return out

    def paths(self, stretches: list[str], byte: np.ndarray) -> list[bytes]:
        """Ids of the best path of each stretch as 16-bit numbers, as Pieces.path() finds them; the longest stretch comes first."""
        n = np.array([len(s) for s in stretches])
        code = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(n) - n
        wide = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        origin = start + np.arange(len(n))  # places of a stretch: one before each character and one at the end
        best, back = np.zeros(len(code) + len(n), np.int64), np.zeros(len(code) + len(n), np.int64)
        state = np.zeros(len(n), np.int64)
        for k in range(int(n[0])):
            live = int(np.searchsorted(-n, -k))  # stretches of more than k characters
            state = self._steps(state[:live], code[start[:live] + k])
            at = origin[:live] + k + 1
            best[at] = best[at - 1] + BYTE_SCORE * wide[start[:live] + k]
            bare = np.ones(live, bool)  # no piece ends there so far
            piece, left = self.output[state], np.arange(live)
            while True:
                some = piece > 0
                piece, left = piece[some], left[some]
                if not len(left):
                    break
                total = best[at[left] - self.length[piece]] + self.score[piece]
                better = bare[left] | (total > best[at[left]])
                best[at[left[better]]], back[at[left[better]]] = total[better], piece[better]
                bare[left] = False
                piece = self.shorter[piece]
        at, left, taken = origin + n, np.arange(len(n)), []
        while len(left):
            taken.append(at)
            at = at - np.maximum(self.length[back[at]], 1)
            inside = at > origin[left]
            at, left = at[inside], left[inside]
        taken = np.sort(np.concatenate(taken))
        of = np.searchsorted(origin, taken) - 1
        ids = self.id[back[taken]]
        raw = taken - of - 1  # characters without a piece, which end there
        count = np.where(ids < 0, wide[raw], 1)
        out = np.repeat(ids, count)
        out[out < 0] = byte[np.frombuffer(code[raw[ids < 0]].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        ends = np.cumsum(np.bincount(of, count, len(n)).astype(np.int64)).tolist()
        flat = out.astype(np.uint16).tobytes()
        return [flat[2 * a : 2 * b] for a, b in zip([0, *ends], ends)]


class Pieces:
    """The automaton, the pieces' bytes for decoding, and the stretches encoded so far."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        lowest = min(s for s in map(model.get_score, plain) if s > -1e8) - 1
        ranks = all(s <= 0 and s == int(s) for s in map(model.get_score, plain))
        self.machine = ahocorasick.Automaton()
        self.out: list[bytes] = [b""] * size
        for i in plain:
            piece = model.id_to_piece(i).replace(MARK, " ")
            score = max(model.get_score(i), lowest)
            self.machine.add_word(piece, (len(piece), round(SCALE * (-math.log(RANK_SHIFT - score) if ranks else score)), i))
            self.out[i] = piece.encode()
        self.machine.make_automaton()
        self.byte = {}
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte[value], self.out[i] = i, bytes([value])
        self.side, self.bytes = Side(dict(self.machine.items())), np.array([self.byte.get(b, 0) for b in range(256)], np.int64)
        self.known = _Known(self)
        self.length = np.array([len(x) for x in self.out], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(self.out), np.uint8)

    def path(self, stretch: str) -> list[int]:
        """Ids of the best path; of equal ones, that whose last piece is longest, at each position."""
        n = len(stretch)
        best, back = [0] + [_NONE] * n, [(1, -1)] * (n + 1)
        at = 0  # positions up to here have their best score
        for end, (length, score, i) in self.machine.iter(stretch):  # by end; pieces of one end from long to short
            while at < end:
                at += 1
                if best[at] == _NONE:
                    best[at] = best[at - 1] + BYTE_SCORE * len(stretch[at - 1].encode())
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (length, i)
        ids, at = [], n
        while at:
            length, i = back[at]
            ids += (i,) if i >= 0 else [self.byte[b] for b in reversed(stretch[at - 1].encode())]
            at -= length
        return ids[::-1]

    def stretch(self, text: str) -> bytes:
        ids: list[int] = []
        for k, part in enumerate(text.split(MARK)):  # a mark in the text stands for itself and has no piece
            ids += ([self.byte[b] for b in MARK.encode()] if k else []) + (self.path(part) if part else [])
        return np.array(ids, np.uint16).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 16-bit numbers."""
        return b"".join(map(self.known.__getitem__, _STRETCH.findall(" " + text))) if text else b""

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of all texts; their new short stretches are read side by side."""
        parts = [_STRETCH.findall(" " + t) if t else [] for t in texts]
        self.known.learn(set().union(*parts))
        return [None if t is None else b"".join(map(self.known.__getitem__, p)) for t, p in zip(texts, parts, strict=True)]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of all texts, counts[k] of the ids each, and their offsets; the space before each text is left out."""
        length, start = self.length[ids], self.start[ids]
        first = (np.cumsum(counts) - counts)[counts > 0]
        length[first] -= 1
        start[first] += 1
        ends = np.cumsum(length)
        data = self.blob[np.repeat(start - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return data, np.r_[0, np.r_[0, ends][np.cumsum(counts)]]


class _Known(dict):
    """Stretches and their ids; emptied when full."""

    def __init__(self, owner: Pieces):
        super().__init__()
        self.owner = owner

    def learn(self, stretches: set[str]) -> None:
        """The new short ones of stretches, as many as there is room for; the others are met one by one."""
        fresh = [s for s in stretches if len(s) <= SHORT and s not in self]
        if len(self) + len(fresh) > CACHE:
            self.clear()
            fresh = [s for s in stretches if len(s) <= SHORT][:CACHE]
        fresh.sort(key=len, reverse=True)
        for at in range(0, len(fresh), ABREAST):
            some = fresh[at : at + ABREAST]
            self.update(zip(some, self.owner.side.paths(some, self.owner.bytes), strict=True))

    def __missing__(self, text: str) -> bytes:
        got = self.owner.stretch(text)
        if len(text) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[text] = got
        return got


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker and file."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _lists(parts: list[bytes | None]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 2 if p else 0 for p in parts)]).astype(np.int32)
    flat = np.frombuffer(b"".join(p for p in parts if p), np.uint16).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([p is None for p in parts]))


def _texts(own: Pieces, column: pa.Array) -> pa.Array:
    """Texts of a column of ids."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    data, offsets = own.decode(np.asarray(column.flatten()).astype(np.int64), counts)
    texts = pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # ids that no text has
        raw = data.tobytes()
        texts = pa.array([raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
    return pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string())) if column.null_count else texts


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = PIECE_FILE, decoded: str | None = None) -> DataFrame:
    """df with the ids of a text column and, if decoded names a column, the texts that these ids give back; all other columns stay."""
    df = df.drop(out, *([decoded] if decoded else []))
    names = [*df.columns, out, *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for part, _, _ in common.steps(batches, text):
            ids = _lists(own.encode_all(part.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns, ids, *([_texts(own, ids)] if decoded else [])], names)

    return df.mapInArrow(run, common.wider(df, **{out: "array<int>"}, **({decoded: "string"} if decoded else {})))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = PIECE_FILE) -> DataFrame:
    """df with the text of an array of ids; all other columns stay."""
    df = df.drop(out)
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(own, part.column(ids))], names)

    return df.mapInArrow(run, common.wider(df, **{out: "string"}))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: number of ids, a digest of them and whether the text came back."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(joined, 256).alias("ids_sha256"), F.char_length("decoded").cast("long").alias("n_chars"), F.col("text").eqNullSafe(F.col("decoded")).alias("same"))
