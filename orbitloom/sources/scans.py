"""Typed scans of stored history: required columns, replay, evidence and event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(rows: DataFrame, required: dict[str, str], late: dict[str, tuple[str, object]] | None = None) -> DataFrame:
    """rows with the required columns (name: type) and the late ones (name: (type, default)), cast and in this order.

    A missing required column is an error that names all of them; a missing late column is its default, a null in a present
    one stays null. Other columns are not read. Casts of the scanned columns to their own types vanish from the plan."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(sorted(missing))}")
    kept = [F.col(c).cast(kind).alias(c) for c, kind in required.items()]
    added = [(F.col(c) if c in rows.columns else F.lit(default)).cast(kind).alias(c) for c, (kind, default) in (late or {}).items()]
    return rows.select(*kept, *added)


def receipt_order(order: str, received: str, stored: str, *ties: str) -> list[Column]:
    """Sort keys of stored receipts: rows without a receipt number first, those by their stamps and the tie columns."""
    legacy = F.col(order).isNull()
    return [F.col(order).asc_nulls_first(), *[F.when(legacy, F.col(c)).asc_nulls_first() for c in (received, stored, *ties)]]


def replay(rows: DataFrame, received: str, since, until=None, limit: int | None = None, **equal) -> DataFrame:
    """Receipts with received in [since, until) and the given column values (None: any).

    With a limit, more rows than it are an error, never a silent cut: one bounded probe counts them up to limit + 1."""
    found = rows.filter(F.col(received) >= F.lit(since))
    if until is not None:
        found = found.filter(F.col(received) < F.lit(until))
    for column, value in equal.items():
        if value is not None:
            found = found.filter(F.col(column) == F.lit(value))
    if limit is not None and found.select(F.lit(1)).limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows in the window")
    return found


def evidence_inputs(bundles: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of the bundles with the same keys, beside the bundle's window; what belongs to no bundle is left out."""
    return samples.join(bundles, keys)


def station_events(events: DataFrame, station: str, time: str, kind: str, who, kinds: list[str], since, until, audience=None) -> DataFrame:
    """Events of one station and the kinds in the closed window [since, until], of one audience or of all."""
    found = events.filter((F.col(station) == F.lit(who)) & F.col(kind).isin(kinds) & F.col(time).between(F.lit(since), F.lit(until)))
    return found if audience is None else found.filter(F.col("audience") == F.lit(audience))
