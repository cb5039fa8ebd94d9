"""Contiguous runs and neighbour-dependent columns in row order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.text import clean_key
from ledgerline.operators.ordering import BLOCK, ROW, fill_down, number_runs, order_rows, with_previous

SCOPE = ("county_effective", "barony_effective", "parish_effective")
LABEL = "townland_linked"


def contiguous_runs(
    df: DataFrame,
    scope: Sequence[str] = SCOPE,
    label: str = LABEL,
    name: str = "run_no",
    row: str = ROW,
    block: str = BLOCK,
    marks: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Number the runs of equal (scope, label); a blank label ends a run and has none.

    ``marks``: new columns that say whether any row of the run meets a condition (see ``number_runs``).
    """
    return number_runs(df, {name: run_keys(scope, label)}, row, block, {name: marks or {}})


def run_keys(scope: Sequence[str] = SCOPE, label: str = LABEL) -> tuple[list[Column], Column]:
    """What ``number_runs`` needs for runs of equal (scope, label): the key and whether a row has none."""
    return [clean_key(c) for c in (*scope, label)], clean_key(label) == ""


def in_runs(df: DataFrame, scope: Sequence[str] = SCOPE, label: str = LABEL, name: str = "run_no") -> DataFrame:
    """The rows of all runs; numbers them unless the table carries run numbers."""
    numbered = df if name in df.columns else contiguous_runs(df, scope, label, name)
    return numbered.filter(F.col(name).isNotNull())


def forward_fill(
    df: DataFrame,
    group: Sequence[str],
    order_by: Sequence[str],
    value: str,
    name: str,
    blocks: int | None = None,
) -> DataFrame:
    """Fill blank values down inside each group; leading blanks become ''.

    Works on tables of any group size: rows are ordered by group first and the
    last value is carried across blocks.
    """
    filled = order_rows(
        df.withColumns({g: F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group if _is_text(df, g)}),
        [*group, *order_by],
        blocks,
    )
    text = clean_key(value)
    filled = fill_down(filled, group, F.when(text != "", text), "_down")
    return filled.withColumn(name, F.coalesce("_down", F.lit(""))).drop("_down", ROW, BLOCK)


def _is_text(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() == "string"


def suppress_repeats(
    df: DataFrame,
    group: Sequence[str],
    order_by: Sequence[str],
    levels: Sequence[str],
    prefix: str = "shown_",
    blocks: int | None = None,
) -> DataFrame:
    """Show each level only where it or a higher level changes; restart per group."""
    ordered = order_rows(df, [*group, *order_by], blocks)
    columns = {f"_prev_{i}": c for i, c in enumerate([*group, *levels])}
    out = with_previous(ordered, columns)
    changed = F.lit(False)
    for i, column in enumerate([*group, *levels]):
        changed = changed | ~F.col(f"_prev_{i}").eqNullSafe(F.col(column))
        if i >= len(group):
            text = F.coalesce(F.col(column).cast("string"), F.lit(""))
            first = F.col(ROW) == 0
            out = out.withColumn(prefix + column, F.when(changed | first, text).otherwise(""))
    return out.drop(*columns, ROW, BLOCK)
