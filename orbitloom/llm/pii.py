"""Operator 9 [native]: personal data by patterns, checksums and context.

Patterns propose spans: email, ip, card, phone and iban; Luhn confirms cards, mod 97 confirms ibans, ranges confirm ips and
digit counts phones; words before a span (after the one before it of the same kind, at most CONTEXT_CHARS back) raise its score.
An iban has the length that its country fixes. Positions are code points, end exclusive: a text is
split at the matches of a pattern, and the lengths of the pieces give the places. The patterns are written without
nested retries (a match can begin only where a run begins or where the last match ended), so long runs take linear time; spans
are gathered in runs of RUN, so that a text with many is not copied once for each.
Cases: a null text has no spans (and stays null when redacted); equal texts give equal spans; where spans of several kinds
overlap, all are reported, and redaction covers their union under the name of the first; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Characters of an iban by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{'|'.join(c for c, n in IBAN_LENGTHS.items() if n == size)})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size in sorted(set(IBAN_LENGTHS.values()))) + ")(?![A-Za-z0-9])"
#: Kind: (what a text must hold to be searched, pattern, score, words before a span that raise it).
KINDS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write|kontakt|correo|courriel"),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", 0.6, "ip|address|host|server|adresse"),
    "card": ("(?:[0-9][ -]?){13}[0-9]", "[0-9]++(?:[ -][0-9]++)*+", 0.9, "card|visa|credit|pay|karte|tarjeta|carte"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax|anruf|llame"),
    "iban": ("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", _IBAN, 0.95, "iban|account|bank|konto|cuenta|compte"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS, RUN = 40, 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(d: Column) -> Column:
        return F.when(d > 4, d * 2 - 9).otherwise(d * 2)

    at = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(at, F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(F.substring(digits, -i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, -i, F.lit(1)).cast("int")))
    return total % 10 == 0


def _mod97(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.coalesce(rest == 1, F.lit(False))


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _spans(text: Column, kind: str, order: int) -> Column:
    """Array of (start, order, stop, kind, score) of the confirmed matches of a kind, ascending."""
    needs, pattern, score, context = KINDS[kind]
    element = "struct<start:int,order:int,stop:int,kind:string,score:double>"
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        stop = start + F.length(x["match"])
        before = F.lower(F.substring(x["piece"], -CONTEXT_CHARS, CONTEXT_CHARS))
        value = F.struct(start.alias("start"), F.lit(order).alias("order"), stop.alias("stop"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), F.lit(score) + F.when(before.rlike(context), 0.2).otherwise(0.0)).alias("score"))
        out = F.when(_confirmed(kind, x["match"]), F.array_append(acc["out"], value)).otherwise(acc["out"])
        return F.struct(stop.alias("at"), out.alias("out"))

    empty = F.array().cast(f"array<{element}>")
    zipped = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    has = F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs)
    return F.when(has, _gathered(zipped, empty, step)).otherwise(empty)


def _gathered(items: Column, empty: Column, step) -> Column:
    """What step(acc, item) adds to acc.out over all items, with acc.at carried along; runs of RUN items are gathered apart, then joined."""

    def run(acc: Column, first: Column) -> Column:
        part = F.aggregate(F.slice(items, first, F.lit(RUN)), F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out"))

    runs = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), empty.alias("out")), run, lambda acc: acc["out"])


def with_spans(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """df with an array of spans (start, order, stop, kind, score) ordered by start, then kind."""
    kinds = {f"_{out}_{k}": _spans(F.coalesce(F.col(text), F.lit("")), k, i) for i, k in enumerate(KINDS)}
    return df.withColumns(kinds).withColumn(out, F.array_sort(F.concat(*map(F.col, kinds)))).drop(*kinds)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of personal data in the text replaced by its kind in angle brackets; n_chars, if there, follows."""
    spans = "_pii_spans_of_text"
    df = with_spans(df, text, spans)
    body = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.concat(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.array_append(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    parts = _gathered(F.col(spans), F.array().cast("array<string>"), step)
    rest = F.substring(body, F.array_max(F.transform(F.col(spans), lambda s: s["stop"])) + 1, F.length(body))
    rebuilt = F.concat(F.array_join(parts, ""), rest)
    columns = df.columns
    df = df.withColumn(text, F.when(F.size(spans) > 0, rebuilt).otherwise(body))
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length(text)).otherwise(F.col("n_chars")).cast(dict(df.dtypes)["n_chars"]))
    return df.drop(spans)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = with_spans(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter(spans, lambda s: s["kind"].isin(*BASE)))
    scores = F.transform(spans, lambda s: s["score"])
    return docs.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), joined(spans).alias("spans"), F.array_max(scores).alias("max_score"))
