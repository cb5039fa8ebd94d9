"""Keyed de-duplication and ordered name lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: str, first_at: str = "first_at") -> DataFrame:
    """Per key the last row in ``order``, and the place of its first row.

    A plain aggregate with a map-side partial: copies of a hot key shrink to
    one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"), F.min(order).alias(first_at))
    return kept.select(*keys, "_row.*", first_at)


def finalise_names(df: DataFrame, name: str = "target_filename", dedupe: bool = True) -> DataFrame:
    """Sorted distinct names, or all names as they are."""
    return df.select(name).distinct().orderBy(name) if dedupe else df.select(name)


def first_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """O3: the first n rows (0: all)."""
    ordered = df.orderBy(*order_by)
    return ordered.limit(n) if n > 0 else ordered
