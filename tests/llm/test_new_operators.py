"""Operators 11 to 13 against brute force, on tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbitloom.llm import alignment, common, decontamination, induced, lexical, licenses, queries, suffixes

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, item_id long, score double, rank int"


@pytest.fixture(scope="module")
def rows(spark):
    """The documents of the smallest tables and rows of every awkward kind."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(520))
    found = [(r.doc_id, r.text) for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    found += [(None, None), (5, ""), (6, "a" * 399), (7, "a" * 400), (8, "b" * 401), (9, "b" * 2000 + "c"), (None, "é日本" * 200), (10, "é日本" * 100), (11, "ab" * 900), (None, "eresan The thesened")]
    found += [(1000 + i, "".join(rng.choice("klmnop ") for _ in range(300)) + passage + "".join(rng.choice("klmn ") for _ in range(300))) for i in range(60)]
    found += [(5, "<|endoftext|> <s> x")] * 2 + [(5, "\nfoo;\r\n  bar \t x\x1cy  "), (7, " "), (12, "a▁b"), (13, "a  b\n\n c " * 200), (14, "日本語 です　x é ﬁ\x00 z")]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(a, b, 1, 0.5, 2) for a, b in rows], SCHEMA).repartition(5)


def test_suffix_arrays_of_small_strings():
    rng = random.Random(5)
    for _ in range(500):
        n, k = rng.randrange(1, 60), rng.choice([1, 2, 3, 10])
        t = np.array([rng.randrange(1, k + 1) for _ in range(n)] + [0])
        found, want = induced.suffix_array(t), sorted(range(n + 1), key=lambda i: list(t[i:]))
        assert found.tolist() == want
        before, shared = induced.permuted_prefixes(t, found, np.full(n + 1, n), np.zeros(1, int))
        for x, y in zip(want, want[1:]):
            m = 0
            while y + m < n and t[x + m] == t[y + m]:
                m += 1
            assert (before[y], shared[y]) == (x, m)


def test_suffix_array_of_one_long_run():
    found = induced.suffix_array(np.append(np.full(200_000, 5), 0))
    assert found.tolist() == list(range(200_000, -1, -1))


def removed(rows, window=400):
    times = Counter()
    for _, t in rows:
        b = (t or "").encode()
        times.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if times[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out, key=str)


def test_op11(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(common, "table", lambda *_: docs)
    want = removed(rows)
    repeats = suffixes.repeats
    for size in (suffixes.SHARD_BYTES, 3000):  # the second compares the passage of many texts by hash
        monkeypatch.setattr(suffixes, "repeats", lambda d, s, size=size: repeats(d, s, size))
        found = suffixes.op11_suffix_dedup(spark, "")
        assert sorted(map(tuple, found.collect()), key=str) == want
    assert sum(x[2] for x in want) > 100_000 and any(x[2] == 0 < x[1] for x in want)


def test_op11_keeps_columns_and_takes_empty_tables(spark, docs, monkeypatch):
    scratch = common.Scratch()
    assert suffixes.repeats(docs, scratch).columns == [*docs.columns, "_spans"]
    monkeypatch.setattr(common, "table", lambda *_: docs.limit(0))
    assert suffixes.op11_suffix_dedup(spark, "").count() == 0


def ranked(rows, items, top=50):
    def terms(t):
        return [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]

    counts = [(d, Counter(terms(t))) for d, t in rows]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    some, every = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counts:
            m = 50 + 50 * n * some // every
            score = sum(math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [1 << 18, 300, 1])
def test_op12(spark, rows, docs, monkeypatch, postings):
    items = [(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()][:12] + [(None, "the eresan THE"), (50, None), (51, "..."), (1, "the"), (1, "the"), (52, "nowhere9")]
    asked = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id long")
    some, every = lexical.statistics(docs)
    build = lexical.build(docs, some, every)
    if postings != lexical.SHARD_POSTINGS:  # many shards: one for each slice of the rows
        parts = [docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(7 if postings > 1 else 60)) == i) for i in range(7 if postings > 1 else 60)] if postings > 1 else [docs.repartition(60)]
        build = lexical.build(parts[0], some, every)
        for p in parts[1:]:
            build = build.unionByName(lexical.build(p, some, every))
    found = lexical.search(build, asked, some)
    assert sorted(map(tuple, found.collect()), key=str) == ranked(rows, items)


def test_op12_result_batches(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(lexical, "OUT_ITEMS", 2)
    items = [(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()][:5] + [(52, "nowhere9"), (53, "nowhere9")]
    some, every = lexical.statistics(docs)
    found = lexical.search(lexical.build(docs, some, every), spark.createDataFrame(items, "item_id long, text string"), some)
    assert sorted(map(tuple, found.collect()), key=str) == ranked(rows, items)


def test_op12_empty_tables(spark, docs):
    asked = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(lexical.build(docs.limit(0), 0, 0), asked, 0).count() == 0
    some, every = lexical.statistics(docs)
    assert lexical.search(lexical.build(docs, some, every), asked.limit(0), some).count() == 0


def test_op12_shard_bytes(spark, docs):
    """An only child has no drop of its own: at most 2n - 1 drops, of three bytes each, for n postings, however deep the grid."""
    some, every = lexical.statistics(docs)
    shards = lexical.build(docs, some, every).collect()
    assert shards
    for row in shards:
        assert len(row["drops"]) <= 3 * (2 * int(np.frombuffer(row["df"], np.int32).sum()) - 1)


def test_op12_drops():
    rng = np.random.default_rng(5)
    cells = np.unique(rng.integers(0, 1 << 20, 3000))
    rows, columns, impact = cells >> 10, cells & 1023, rng.integers(1, 1_000_000, len(cells))
    masks, drops = lexical.treap(rows, columns, impact, 10)
    assert np.array_equal(lexical._wide(lexical._narrow(drops).reshape(-1)), drops)
    even = np.append(masks, np.zeros(len(masks) % 2, np.uint8))
    plain = {"ids": np.arange(1024), "missing": np.zeros(1024, bool), "terms": np.arange(1024, dtype=np.uint64), "masks": even[::2] | (even[1::2] << 4), "drops": lexical._narrow(drops)}
    tree = lexical.Tree({k: pa.scalar(v.tobytes(), pa.binary()) for k, v in plain.items()} | {"levels": pa.scalar(10), "columns": pa.scalar(1024)})
    leaves = tree.best[tree.inner : tree.none]  # in the order of the grid's quarters
    order = np.argsort((lexical._spread(rows) << np.uint64(1)) | lexical._spread(columns))
    assert np.array_equal(leaves, impact[order]) and tree.best[0] == impact.max() and tree.best[-1] == 0


def tokens(text, bpe, pieces, letters):
    a, b = bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    bytes_a = [bytes(letters[c] for c in bpe.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    return (a, b, [len(x) for x in bytes_a], [len(x) for x in bytes_b]) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def aligned(rows):
    bpe, pieces, letters = Tokenizer.from_file(alignment.BYTE_FILE), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_FILE), alignment._byte_letters()
    bpe.encode_special_tokens = True
    found, times = [], Counter()
    for _, text in rows:
        of = tokens(text, bpe, pieces, letters) if text else None
        if of is None:
            found.append(None)
            continue
        a, b, size_a, size_b = of
        links, groups, i, j, at_a, at_b, group_a, group_b = [], [], 0, 0, 0, 0, [], []
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = at_a + size_a[i], at_b + size_b[j]
            if end_a <= end_b:
                group_a.append(str(a[i]))
                at_a, i = end_a, i + 1
            if end_b <= end_a:
                group_b.append(str(b[j]))
                at_b, j = end_b, j + 1
            if end_a == end_b:
                groups.append(",".join(group_a) + "|" + ",".join(group_b))
                group_a, group_b = [], []
        times.update(links)
        found.append((len(a), len(b), groups, links))
    best: dict = {}
    for (_, y), n in times.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (d, _), of in zip(rows, found):
        if of is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = of
            out.append((d, n_a, n_b, len(groups), len(links), sum(times[x] == best[x[1]] for x in links), sum(times[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"TABLE_PAIRS": 0, "BUCKET": 64, "FAN": 2}])
def test_op13(spark, rows, docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(alignment, name, value)
    found = alignment.align(docs)
    assert sorted(map(tuple, found.collect()), key=str) == aligned(rows)


def test_op13_long_texts_and_a_full_memory(monkeypatch):
    """Slices of a text, forgetting and numbering anew give the same sums as one piece."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", " c", "\n", "é", " dog", ";\r\n", "  "]) for _ in range(n)) for n in (3000, 5, 40, 2000)] + ["a▁b " + "word " * 400]

    def sums(settings):
        for name, value in settings.items():
            monkeypatch.setattr(alignment, name, value)
        aligner, out = alignment.Aligner(alignment.BYTE_FILE, alignment.PIECE_FILE), {}
        for found in alignment._aligned(aligner, texts, aligner.trim):
            for row, of in found:
                had = out.get(row, (np.zeros(4, np.int64), []))
                out[row] = (had[0] + aligner.sizes[of].sum(0), had[1] + [aligner.groups[i] for i in of])
        return {row: (n.tolist(), b";".join(g)) for row, (n, g) in out.items()}

    whole = sums({})
    assert set(whole) == {0, 1, 2, 3}
    assert sums({"GROUP_CHARS": 500, "SLICE": 40, "STRETCHES": 100}) == whole


def test_op13_empty_table(spark, docs):
    assert alignment.align(docs.limit(0)).count() == 0


def test_perfect_hash_has_no_gap():
    for n in (1, 2, 3, 50, 4096):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n, dtype=np.uint64))
        pilots, placed = alignment.perfect(keys)
        slots = alignment._slots(keys, pilots, np.zeros(len(keys), np.int64), np.full(len(keys), len(pilots)), np.full(len(keys), len(keys)))
        assert sorted(slots.tolist()) == list(range(len(keys))) and (placed[slots] == keys).all()


def test_registered():
    assert {"op11_suffix_dedup", "op12_lexical_search", "op13_alignment"} <= set(queries.QUERIES)


def test_op2_short_items_flag_nothing_by_chance(spark):
    docs = common.table(spark, DATA, "documents")
    words = Counter(w for r in docs.select("text").collect() for w in set((r.text or "").lower().split()))
    often, middling = words.most_common(1)[0][0], words.most_common(60)[-1][0]
    text = next(r.text for r in docs.select("text").collect() if r.text and len(r.text.split()) > 200)
    exact = " ".join(text.split()[100:108])
    items = [(9001, often), (9002, middling), (9003, f"{often} {middling} {often}"), (9004, exact), (9005, " ".join(reversed(exact.split()))), (9006, None), (9007, "")]
    benchmark = common.table(spark, DATA, "benchmark").unionByName(spark.createDataFrame(items, "item_id long, text string"))
    found = decontamination.contaminated(docs, benchmark).collect()
    hits = {i: {r.doc_id for r in found if r.item_id == i} for i in range(9001, 9008)}
    assert not any(hits[i] for i in (9001, 9002, 9003, 9005, 9006, 9007)) and hits[9004]
    want = {r.doc_id for r in docs.collect() if f" {exact.lower()} " in f" {' '.join((r.text or '').lower().split())} "}
    assert hits[9004] == want
    others = decontamination.contaminated(docs, common.table(spark, DATA, "benchmark")).collect()
    assert {(r.doc_id, r.item_id) for r in others} <= {(r.doc_id, r.item_id) for r in found if r.item_id < 9000}


def edits(pattern, text):
    """The fewest edits that make the pattern some part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != t))
    return min(row)


def test_op4_whole_query(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(6)):
            letters = list(rng.choice([*licenses.NOTICES, *licenses.PHRASES]))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(letters))
                letters[at : at + 1] = rng.choice([[], ["q"], [letters[at], "z"]])
            parts += ["".join(letters)] + [rng.choice(["Foo", "the;", "license", "é"]) for _ in range(rng.randrange(3))]
        rows.append((i, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, "MIT License " * 40_000), (200, "mit  license")]
    monkeypatch.setattr(common, "table", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(licenses.op4_licenses(spark, "").collect(), key=lambda r: (r.doc_id, r.n_words))
    assert len(found) == len(rows)
    for r, (_, text) in zip(found, sorted(rows, key=lambda x: (x[0], len(x[1] or "")))):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        if len(words) < 1000:
            joined = " ".join(words)
            near = {label for n, label in licenses.NOTICES.items() if edits(n, joined) <= len(n) // licenses.ERROR_EVERY}
            assert set(filter(None, r.labels.split(","))) <= base | near  # nothing that is not there
            spans = [(x.start, x.stop) for x in r.notices]
            assert spans == sorted(spans) and (not near or spans)  # and something of each that is
            assert all(a < b <= len(words) for a, b in spans)


def test_op13_workers_remember_stretches_of_other_tables(spark, docs):
    """A smaller table after a larger one, in the same workers."""
    alignment.align(docs)
    few = [(1, "the cat"), (2, "a dog the cat"), (3, None)]
    found = alignment.align(spark.createDataFrame(few, "doc_id long, text string").coalesce(1))
    assert sorted(map(tuple, found.collect()), key=str) == aligned(few)


def test_op2_thresholds_come_from_all_documents(spark):
    """One text with a passage's word among 4,000 without moves the thresholds, whichever it is."""
    terms, lookup = np.zeros((2, 4), np.float32), np.ones(decontamination.BUCKETS, np.int32)
    terms[0], lookup[decontamination._terms(common.word_hashes(np.frombuffer(b"odd", np.uint8), np.array([0, 3]))[0])] = [1, 2, 3, 4], 0
    vectors, trials = np.eye(4, dtype=np.float32)[:2], np.ones((2, 2, decontamination.TRIALS), np.float32)
    texts = [f"plain{i} " * 70 for i in range(4000)]

    def least(rows):
        return decontamination.thresholds(spark.createDataFrame([(t,) for t in rows], "text string"), lookup, terms, vectors, np.array([40, 12]), trials)

    plain = least(texts)
    for at in (0, 1234, 3999):
        assert (np.abs(least(texts[:at] + ["odd " * 70] + texts[at + 1 :]) - plain) > 1e-5).all()
    assert (least(["", None, " "]) <= 0).all()
