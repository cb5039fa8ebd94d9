"""Resolve entities that are marked as continued from an earlier page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.similarity import may_reach, similarity
from ledgerline.functions.text import clean_key, fraction, normalise_name, to_number, with_once
from ledgerline.operators.lookup import VERIFIED
from ledgerline.operators.ordering import BLOCK, ROW, number_runs, order_rows, with_previous
from ledgerline.operators.skew import attach


def resolve_continued(
    df: DataFrame,
    order_by: Sequence[str],
    threshold: float = 0.9,
    page: str = "page_name",
    label: str = "townland_gv",
    scope: Sequence[str] = VERIFIED,
    continued: str = "is_continued",
    method: str = "indel",
    blocks: int | None = None,
) -> DataFrame:
    """A run that starts with a continued row takes the last name of the nearest earlier page of its scope.

    Runs are contiguous within (scope, page); names are read before any of
    them changes. ``order_by`` orders the rows of one page.
    """
    limit = fraction(threshold) * 100.0
    groups = [f"_s{i}" for i in range(len(scope))]
    rows = df.withColumns({g: F.coalesce(F.col(c).cast("string"), F.lit("")) for g, c in zip(groups, scope)})
    rows = order_rows(rows, [*groups, page, *order_by], blocks)
    name = clean_key(label)
    rows = number_runs(rows, {"_run": ([*groups, page, name], name == ""), "_sheet": ([*groups, page], None)})
    runs = rows.filter("_run is not null").groupBy("_run").agg(
        F.min_by(F.struct(F.col(label).alias("name"), continued, "_sheet", *groups), ROW).alias("r"),
        F.min(ROW).alias(ROW),
    )
    runs = runs.select("_run", ROW, "r.*")
    sheets = runs.groupBy("_sheet", *groups).agg(F.max_by("name", "_run").alias("own_last"))
    # sheets of one scope are adjacent, so the previous sheet with a name is the nearest earlier page
    sheets = number_sheets(sheets, groups)
    starts = runs.filter(to_number(continued) > 0).join(sheets, "_sheet").filter("prior is not null")
    starts = with_once(starts, _a=normalise_name("name"), _b=normalise_name("prior")).filter("_a <> '' and _b <> ''")
    # equal names need no score, and names too far apart for the limit are ruled out before Python sees them
    equal = F.col("_a") == F.col("_b")
    starts = starts.filter(equal | may_reach(F.col("_a"), F.col("_b"), limit / 100.0))
    scored = starts.withColumn("_score", similarity(F.when(~equal, F.col("_a")), "_b", method) * 100.0)
    reached = F.when(equal, 100.0).otherwise(F.col("_score")) >= limit
    taken = scored.filter(reached).select("_run", F.col("prior").alias("_taken"))
    with_key = rows.withColumn("_run", F.coalesce("_run", F.lit(-1)))
    out = attach(with_key, taken, ["_run"], BLOCK)
    return out.withColumn(label, F.coalesce("_taken", label)).drop("_taken", "_run", "_sheet", *groups, ROW, BLOCK)


def number_sheets(sheets: DataFrame, groups: Sequence[str], size: int = 250_000) -> DataFrame:
    """Previous named sheet's last name within the same scope; sheets are numbered in (scope, page) order."""
    blocked = sheets.withColumn(BLOCK, F.floor(F.col("_sheet") / size).cast("int"))
    scope = F.struct(*groups)
    blocked = blocked.withColumn("_scope", scope)
    with_prev = with_previous(blocked, {"_p_scope": "_scope", "_p_name": "own_last"}, row="_sheet")
    prior = F.when(F.col("_p_scope").eqNullSafe(F.col("_scope")), F.col("_p_name"))
    return with_prev.select("_sheet", prior.alias("prior"))
