"""Bring one-row-per-group values back to the rows of hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_SALTS = 64


def hash_salt(columns: Sequence[str], salts: int = DEFAULT_SALTS) -> Column:
    """A repeatable salt from row values that differ inside a group."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def attach(
    rows: DataFrame, values: DataFrame, keys: Sequence[str], salt: Column | str, how: str = "left"
) -> DataFrame:
    """Left-join ``values`` (unique per key, no null keys) onto ``rows``.

    The row-side join key is (salt, key). The value side holds one row per
    salt that occurs with the key, so a group with a third of all rows
    spreads over its salts and is never joined in one task.
    """
    keys = list(keys)
    salted = rows.withColumn("_salt", F.col(salt) if isinstance(salt, str) else salt)
    per_salt = salted.select("_salt", *keys).distinct().join(values, keys, "inner")
    return salted.join(per_salt, ["_salt", *keys], how).drop("_salt")
