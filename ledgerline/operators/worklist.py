"""What is still to be done: validation, missing results, sync plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.text import PAGE_NAME_PATTERN, is_page_name, with_prefix


def validate_names(
    df: DataFrame, name: str = "target_filename", skip_invalid: bool = False, pattern: str = PAGE_NAME_PATTERN
) -> DataFrame:
    """flag names that break the pattern, or drop them."""
    checked = df.withColumn("is_valid_name", F.coalesce(is_page_name(name, pattern), F.lit(False)))
    return checked.filter("is_valid_name") if skip_invalid else checked


def work_left(wanted: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Wanted rows without a finished counterpart."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def sync_plan(local: DataFrame, remote: DataFrame, prefix: str | None = None, force: bool = False) -> DataFrame:
    """Local (key, length) rows whose prefixed key is absent remotely or has another length."""
    prefixed = local.withColumn("key", with_prefix("key", prefix))
    return prefixed if force else work_left(prefixed, remote, ["key", "length"])
