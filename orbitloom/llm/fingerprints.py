"""Operator 3 [native]: document fingerprints as threshold-scaled sketches.

Every hash of a 5-word shingle (lower-cased, white space ignored; fewer words: the whole sequence as one) below a fixed
fraction of the 64-bit range is kept; where none is below it, the smallest hash stands alone, so that no text with words has
an empty sketch. Estimates look only at hashes below the threshold, so containment is estimated without bias between texts
of very unequal sizes; if neither side has one, they are 1 for equal sketches, else 0. Sketches of equal texts are equal, and
the sketch of a union of shingle sets is merged() from their sketches. Cases: a null text is an empty one; texts without words have the empty sketch, and two empty
sketches have likeness 1; repeated rows have equal sketches; other columns are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: One hash in so many is kept.
SCALE = 2
_BELOW = -(1 << 63) + (1 << 64) // SCALE


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """df with the sketch of a text column: ascending array of hashes."""
    w, h, s = (f"_{out}_{x}" for x in ("words", "hashes", "shingles"))
    df = df.withColumn(w, F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    df = df.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x))).drop(w)
    rolled = F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(F.col(h), i + j) for j in range(words)]))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(s, F.when(F.size(h) >= words, rolled).when(F.size(h) > 0, F.array(F.xxhash64(F.col(h)))).otherwise(none)).drop(h)
    df = df.withColumn(out, F.array_sort(F.array_distinct(_below(F.col(s)))))
    return df.withColumn(out, F.when((F.size(out) == 0) & (F.size(s) > 0), F.array(F.array_min(s))).otherwise(F.col(out))).drop(s)


def _below(sketch: Column) -> Column:
    return F.filter(sketch, lambda x: x < F.lit(_BELOW))


def merged(a: str, b: str) -> Column:
    """Sketch of the union of the shingle sets behind two sketches."""
    both = F.array_sort(F.array_union(a, b))
    kept = _below(both)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(both, 1, 1))


def _estimate(a: str, b: str, of: Column) -> Column:
    """Shared hashes below the threshold over those of another array; without any, 1 if the sketches are equal, else 0."""
    shared = F.size(F.array_intersect(_below(F.col(a)), _below(F.col(b))))
    return F.when(F.size(of) > 0, shared / F.size(of)).otherwise((F.col(a) == F.col(b)).cast("double"))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two sketches; 1 for two empty ones."""
    return _estimate(a, b, _below(F.array_union(a, b)))


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(_estimate(a, b, _below(F.col(a))))


def as_text(sketch: str) -> Column:
    """A sketch as 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(F.col(sketch), lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _part(key: Column, bounds: list[int]) -> Column:
    """Number of the ascending bounds that are not above the key, by blocks; a null key has none below."""
    block = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + block] for i in range(0, len(bounds), block)] or [[]]
    heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks]) if bounds else F.array().cast("array<bigint>")
    lists = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks]) if bounds else None
    if lists is None:
        return F.lit(0)
    at = F.size(F.filter(heads, lambda x: x <= key))
    inside = F.size(F.filter(F.element_at(lists, F.greatest(at, F.lit(1))), lambda x: x <= key))
    return F.when(key.isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * block + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the text and sketch of the next row by doc_id (nulls first; equal ones by a hash of the text, then by text); the last row's is the first.

    Rows are dealt by ranges of doc_id, whose bounds are approximate quantiles (as many as twice the shuffle partitions);
    rows without doc_id by ranges of the hash); only the first row of each range is looked at beyond its range."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = sorted(set(found or []))
    rows = rows.withColumn("order", F.xxhash64("text"))
    without = F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * ranges).cast("int") - ranges - 1
    dealt = rows.withColumn("range", F.when(F.col("doc_id").isNull(), without).otherwise(_part(F.col("doc_id"), bounds)))
    # the rows that begin the ranges: one each, small and fixed in number
    begins = dealt.groupBy("range").agg(F.min_by("text", F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "order", "text")).alias("text"))
    begins = common.saved(with_sketch(begins, "text", "sketch"))
    following = {r["range"]: r["to"] for r in _following(sorted(r["range"] for r in begins.select("range").collect()))}
    pairs = spark.createDataFrame(pa.table({"range": pa.array(list(following), pa.int32()), "to": pa.array(list(following.values()), pa.int32())}))
    after = pairs.join(begins.select(F.col("range").alias("to"), F.col("text").alias("far_text"), F.col("sketch").alias("far_sketch")), "to").drop("to")
    window = "over (partition by range order by doc_id nulls first, order, text)"
    near = with_sketch(dealt, "text", "sketch").withColumns({"near_text": F.expr(f"lead(text) {window}"), "near_sketch": F.expr(f"lead(sketch) {window}")})
    joined = near.join(after, "range", "left")
    last = F.col("near_text").isNull()
    return joined.select("doc_id", "text", "sketch", F.when(last, F.col("far_text")).otherwise(F.col("near_text")).alias("next_text"), F.when(last, F.col("far_sketch")).otherwise(F.col("near_sketch")).alias("next_sketch"))


def _following(ranges: list[int]) -> list[dict]:
    """Each range that has rows, and the next such one."""
    return [{"range": r, "to": ranges[(i + 1) % len(ranges)]} for i, r in enumerate(ranges)]


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likenesses to the edited and the next text."""
    rows = with_next(common.table(spark, sf_dir, "documents"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
    )
