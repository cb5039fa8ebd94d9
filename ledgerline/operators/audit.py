"""Compare the printed total of a group with the sum of its details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.text import clean_key, from_pence, to_number, to_pence, within_factor
from ledgerline.operators.ordering import ROW
from ledgerline.operators.runs import LABEL, SCOPE, in_runs
from ledgerline.operators.simjoin import closest_to
from ledgerline.operators.skew import attach

NO_TOTAL = "no_total_row"


def total_vs_detail(
    df: DataFrame,
    by: Sequence[str],
    flag: Column,
    amounts: dict[str, Column],
    order: Column,
    which_total: str = "last",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """A1 for any table: one row per group, its (last or first) total row against its detail sums.

    ``flag`` is 1 on total rows and 0 on details; other values are neither.
    ``amounts`` are whole numbers. Everything is one hash aggregate with a
    map-side partial, so a hot group costs no more than its row count.
    """
    pick = {"last": F.max_by, "first": F.min_by}[which_total]
    at_total = F.when(flag == 1, order)
    sums = [F.coalesce(F.sum(F.when(flag == 0, a)), F.lit(0)).alias(f"sum_{n}") for n, a in amounts.items()]
    totals = [pick(a, at_total).alias(f"total_{n}") for n, a in amounts.items()]
    checked = df.groupBy(*by).agg(
        *extra,
        F.count("*").alias("row_count"),
        F.count(at_total).alias("total_row_count"),
        *sums,
        *totals,
    )
    agreed = F.lit(True)
    for n in amounts:
        agreed = agreed & within_factor(F.col(f"total_{n}"), F.col(f"sum_{n}"))
    has_total = F.col("total_row_count") > 0
    return checked.withColumns(
        {
            "has_total_row": has_total,
            "valuation_ok": has_total & F.coalesce(agreed, F.lit(False)),
            "multiple_total_rows": F.when(F.col("total_row_count") > 1, True),
            "failure_reason": F.when(has_total, "").otherwise(NO_TOTAL),
            **{f"sum_{n}": F.when(has_total, F.col(f"sum_{n}")) for n in amounts},
        }
    )


def check_runs(
    df: DataFrame,
    scope: Sequence[str] = SCOPE,
    label: str = LABEL,
    page: str = "page_name",
    strip_currency: bool = True,
    one_page: str | None = "is_one_page_townland",
) -> DataFrame:
    """A1 on an ordered table (``grn``/``blk``): one row per contiguous run, money as text.

    Run numbers (``run_no``) are used if the table carries them. Pages are counted; which ones
    they are is ``run_pages``, one row each.
    """
    if one_page not in df.columns:
        one_page = None
    runs = in_runs(df, scope, label)
    first = F.struct(*scope, label, *([one_page] if one_page else []))
    extra = [
        F.min_by(first, ROW).alias("_first"),
        F.min(ROW).alias("first_grn"),
        F.max(ROW).alias("last_grn"),
        F.count_distinct(page).alias("page_count"),
    ]
    runs = runs.withColumns({f"_{n}": to_pence(n, strip_currency) for n in ("land_val", "total_val")})
    runs = runs.withColumn("_flag", to_number("is_total"))
    money = {n: F.col(f"_{n}") for n in ("land_val", "total_val")}
    checked = total_vs_detail(runs, ["run_no"], F.col("_flag"), money, F.col(ROW), extra=extra)
    text = {c: from_pence(c) for c in ("sum_land_val", "total_land_val", "sum_total_val", "total_total_val")}
    clean = {c: clean_key(c) for c in scope}  # once a run
    return checked.select("*", "_first.*").drop("_first").withColumns(clean | text)


def run_pages(df: DataFrame, page: str = "page_name") -> DataFrame:
    """The distinct pages of each run."""
    return in_runs(df).select("run_no", page).distinct()


def leave_one_out(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    order: Sequence[str],
    salt: Column | str,
    payload: Sequence[str] = (),
    min_rows: int = 3,
    among: DataFrame | None = None,
) -> DataFrame:
    """A10: per group the row whose value is closest to the sum of all other rows.

    Candidates are positive, leave a positive rest and agree within a factor
    of two; ties go to the first row in ``order``. Groups without a candidate
    are absent. Returns by + order + payload of the row, value, rest, and
    whether it is the last row. ``among`` (by, more payload columns) names the groups that count; it meets
    the group totals, not the rows.
    """
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    totals = df.groupBy(*by).agg(
        F.sum(value).alias("_sum"), F.count("*").alias("_rows"), F.max(position).alias("_last")
    )
    totals = totals.filter(F.col("_rows") >= min_rows)
    if among is not None:
        totals = totals.join(among, list(by))
    rows = attach(df, totals, by, salt, how="inner")
    rest = F.col("_sum") - F.col(value)
    candidates = rows.withColumn("_rest", rest).filter(
        (F.col(value) > 0) & (F.col("_rest") > 0) & within_factor(F.col(value), F.col("_rest"))
    )
    best = candidates.groupBy(*by).agg(
        F.min(
            F.struct(
                F.abs(F.col(value) - F.col("_rest")).alias("distance"),
                F.struct(*order).alias("at"),
                F.struct(F.col(value).alias("value"), F.col("_rest").alias("rest"), *payload).alias("row"),
                (position == F.col("_last")).alias("is_last_row"),
            )
        ).alias("_best")
    )
    return best.select(*by, "_best.at.*", "_best.row.*", "_best.distance", "_best.is_last_row")


def check_entity(
    df: DataFrame, entity: str, order: Sequence[str], label: str = "townland", strip_currency: bool = True
) -> DataFrame:
    """Check one named entity; without an exact match take the most similar name.

    Returns one row. ``status`` is ok, entity_not_found or no_total_row; the
    first total row counts here.
    """
    names = df.withColumn("_at", F.struct(*order))
    exact = df.filter(F.col(label) == entity).agg(F.max(label)).scalar()
    close = closest_to(names, label, "_at", entity).withColumn("exact", exact)
    chosen = close.select(F.lit(entity).alias("entity"), F.coalesce("exact", "matched").alias("matched"), "score")
    money = {n: to_pence(n, strip_currency) for n in ("land_val", "total_val")}
    own = df.join(chosen.select(F.col("matched").alias(label)), label, "left_semi")  # only the rows of the chosen name
    checks = total_vs_detail(
        own, [label], to_number("is_total"), money, F.struct(*order), which_total="first"
    ).withColumnRenamed(label, "matched")
    out = chosen.join(checks, "matched", "left")
    status = (
        F.when(F.col("matched").isNull(), "entity_not_found")
        .when(~F.col("has_total_row"), NO_TOTAL)
        .otherwise("ok")
    )
    text = {c: from_pence(c) for c in ("sum_land_val", "total_land_val", "sum_total_val", "total_total_val")}
    return out.withColumn("status", status).withColumns(text).select(
        "entity", "matched", "score", "status", *text, F.col("valuation_ok").alias("is_correct")
    )
