"""Explain runs that have no total row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.similarity import may_reach, similarity
from ledgerline.functions.text import PAGE_NUMBER, clean_key, fraction, from_pence, normalise_name, squash, to_pence
from ledgerline.operators.audit import leave_one_out, run_pages
from ledgerline.operators.ordering import BLOCK, ROW
from ledgerline.operators.runs import LABEL, SCOPE, in_runs
from ledgerline.storage import materialize


def similar_neighbours(
    runs: DataFrame,
    scope: Sequence[str],
    label: str,
    threshold: float = 0.8,
    run_no: str = "run_no",
    method: str = "difflib",
) -> DataFrame:
    """For runs without a total, the similar neighbour of the same scope that has one.

    Run numbers are dense, so neighbours meet by an equi-join on the number
    plus or minus one. ``next`` wins only if it beats the rounded similarity
    of ``prev``.
    """
    limit = fraction(threshold)
    owners = runs.filter("total_row_count > 0").select(
        run_no, *[F.col(c).alias(f"_n{i}") for i, c in enumerate(scope)], F.col(label).alias("neighbor_townland"),
        F.col("total_row_count").alias("neighbor_total_rows"),
    )
    # an owner is "prev" of the run after it and "next" of the run before it
    sides = F.explode(
        F.array(
            F.struct((F.col(run_no) + 1).alias("at"), F.lit("prev").alias("side")),
            F.struct((F.col(run_no) - 1).alias("at"), F.lit("next").alias("side")),
        )
    )
    owners = owners.withColumn("_s", sides).drop(run_no).select("*", F.col("_s.at").alias(run_no), "_s.side").drop("_s")
    pairs = runs.filter("total_row_count = 0").select(run_no, *scope, label).join(owners, run_no)
    for i, c in enumerate(scope):
        pairs = pairs.filter(F.col(c).eqNullSafe(F.col(f"_n{i}")))
    pairs = pairs.withColumns({"_a": squash(label), "_b": squash("neighbor_townland")})
    pairs = pairs.filter(may_reach(F.col("_a"), F.col("_b"), limit))
    pairs = pairs.withColumn("_sim", similarity("_a", "_b", method)).filter(F.col("_sim") >= limit)
    found = F.struct(
        F.round("_sim", 3).alias("neighbor_similarity"), "neighbor_townland", "neighbor_total_rows", F.col("_sim").alias("raw")
    )
    both = pairs.groupBy(run_no).agg(
        F.max_by(found, F.when(F.col("side") == "prev", 1)).alias("p"),
        F.max_by(found, F.when(F.col("side") == "next", 1)).alias("n"),
    )
    use_next = F.col("p").isNull() | (F.col("n.raw") > F.col("p.neighbor_similarity"))
    use_next = F.col("n").isNotNull() & use_next
    chosen = F.when(use_next, F.col("n")).otherwise(F.col("p"))
    return both.select(
        run_no,
        F.when(use_next, "next").otherwise("prev").alias("neighbor_direction"),
        *[chosen[c].alias(c) for c in ("neighbor_townland", "neighbor_similarity", "neighbor_total_rows")],
    )


def classify(has_candidate: Column, has_neighbour: Column, rows: Column) -> Column:
    """First matching cause."""
    return (
        F.when(has_candidate, "unflagged_total")
        .when(has_neighbour, "split_segment")
        .when(rows <= 2, "tiny_segment")
        .otherwise("genuinely_missing")
    )


def explain_missing_totals(
    df: DataFrame,
    checks: DataFrame,
    scope: Sequence[str] = SCOPE,
    label: str = LABEL,
    threshold: float = 0.8,
    strip_currency: bool = True,
    method: str = "difflib",
) -> DataFrame:
    """One row per run without a total, with its likely cause.

    ``df`` is the ordered table, ``checks`` the result of ``check_runs`` on it.
    """
    open_runs = checks.filter("not has_total_row")
    rows = in_runs(df, scope, label).select("run_no", BLOCK, ROW, to_pence("total_val", strip_currency).alias("_pence"), "occupier")
    starts = open_runs.select("run_no", "first_grn")
    totals = leave_one_out(rows, ["run_no"], "_pence", [ROW], BLOCK, payload=["occupier", "first_grn"], among=starts)
    candidates = totals.select(
        "run_no",
        (F.col(ROW) - F.col("first_grn")).alias("candidate_row_pos"),
        F.col(ROW).alias("candidate_grn"),
        F.col("is_last_row").alias("candidate_is_last_row"),
        F.col("occupier").alias("candidate_occupier"),
        from_pence("value").alias("candidate_total_val"),
        from_pence("rest").alias("sum_other_rows_total_val"),
    )
    neighbours = similar_neighbours(checks, scope, label, threshold, method=method)
    report = open_runs.join(candidates, "run_no", "left").join(neighbours, "run_no", "left")
    unflagged = F.col("candidate_row_pos").isNotNull()
    near = ("neighbor_direction", "neighbor_townland", "neighbor_similarity", "neighbor_total_rows")
    report = report.withColumn("category", classify(unflagged, F.col("neighbor_direction").isNotNull(), F.col("row_count")))
    report = report.withColumns({c: F.when(~unflagged, F.col(c)) for c in near})
    return report.select(
        "run_no", "first_grn", "last_grn", *scope, label, "row_count", "category", *near,
        "candidate_row_pos", "candidate_grn", "candidate_is_last_row", "candidate_occupier",
        "candidate_total_val", "sum_other_rows_total_val",
    )


def unflagged_checklist(report: DataFrame) -> DataFrame:
    """Unflagged totals by confidence: last row of the run and blank occupier first."""
    blank = F.coalesce(F.trim("candidate_occupier"), F.lit("")) == ""
    last = F.col("candidate_is_last_row")
    tier = F.when(last & blank, 1).when(last | blank, 2).otherwise(3)
    return report.filter("category = 'unflagged_total'").withColumn("confidence_tier", tier)


def page_number(page: Column | str) -> Column:
    """'VVV_PPP' of a page name."""
    return F.concat_ws("_", F.regexp_extract(page, PAGE_NUMBER, 1), F.regexp_extract(page, PAGE_NUMBER, 2))


def split_checklist(report: DataFrame, pages: DataFrame, page: str = "page_name") -> DataFrame:
    """D3: split segments with the number of their first page; ``pages`` are the run pages (``run_pages``)."""
    split = report.filter("category = 'split_segment'")
    first = pages.join(split.select("run_no"), "run_no", "left_semi").groupBy("run_no").agg(F.min(page).alias("_first"))
    return split.join(first, "run_no", "left").select(
        "run_no", page_number(F.col("_first")).alias("page_num"), LABEL, "neighbor_direction", "neighbor_townland",
        "neighbor_similarity", "neighbor_total_rows", "parish_effective", "county_effective", "barony_effective", "row_count",
    )


def next_page_in_corpus(pages: DataFrame, page: str = "page_name") -> DataFrame:
    """Whether the page numbered one higher in the same volume exists."""
    volume = F.regexp_extract(page, PAGE_NUMBER, 1)
    number = F.regexp_extract(page, PAGE_NUMBER, 2).try_cast("bigint")
    numbered = pages.select(page).distinct().select(page, volume.alias("_vol"), number.alias("_no"))
    present = numbered.select("_vol", (F.col("_no") - 1).alias("_no"), F.lit(True).alias("next_in_corpus")).distinct()
    out = numbered.join(present, ["_vol", "_no"], "left")
    return out.select(page, F.coalesce("next_in_corpus", F.lit(False)).alias("next_in_corpus"))


def other_model_has_total(
    open_runs: DataFrame, pages: DataFrame, other_checks: DataFrame, other_pages: DataFrame, scope: Sequence[str] = SCOPE, page: str = "page_name"
) -> DataFrame:
    """Run numbers whose entity has a total row in the other model on one of the same pages.

    ``pages`` and ``other_pages`` are the run pages of the two readings (``run_pages``).
    """

    def rows(checks: DataFrame, of_runs: DataFrame) -> DataFrame:
        return checks.select("run_no", *scope, LABEL).join(of_runs.select("run_no", page), "run_no")

    return same_keys_with_total(rows(open_runs, pages), rows(other_checks.filter("has_total_row"), other_pages), scope, page=page)


def same_keys_with_total(
    open_rows: DataFrame, total_rows: DataFrame, scope: Sequence[str] = SCOPE, label: str = LABEL, page: str = "page_name"
) -> DataFrame:
    """J12 on rows: numbers of the runs of ``open_rows`` that share page, scope and name with a row of ``total_rows``."""
    key = {"_page": F.col(page), **{c: clean_key(c) for c in scope}, "_name": normalise_name(label)}
    columns = [c.alias(name) for name, c in key.items()]
    theirs = total_rows.select(*columns).distinct()
    return open_rows.select("run_no", *columns).distinct().join(theirs, list(key), "left_semi").select("run_no").distinct()


def break_down_missing(
    report: DataFrame, df: DataFrame, other_checks: DataFrame, other_pages: DataFrame, page: str = "page_name"
) -> DataFrame:
    """Genuinely missing totals by page position, corpus coverage and the other model (its checks and run pages)."""
    missing = materialize(report.filter("category = 'genuinely_missing'"))
    ends = df.groupBy(F.col(page).alias("_last_page")).agg(F.max(ROW).alias("last_grn"))
    coverage = next_page_in_corpus(df, page).withColumnRenamed(page, "_last_page")
    ends = ends.join(coverage, "_last_page").select("last_grn", "next_in_corpus")
    own_pages = run_pages(df, page).join(missing.select("run_no"), "run_no", "left_semi")
    found = other_model_has_total(missing, own_pages, other_checks, other_pages, page=page).withColumn("_found", F.lit(True))
    out = missing.join(ends, "last_grn", "left").join(found, "run_no", "left")
    bottom = F.col("next_in_corpus").isNotNull()
    sub = (
        F.when(bottom & ~F.col("next_in_corpus"), "continues_to_unscanned_page")
        .when(bottom, "ends_at_page_bottom_next_scanned")
        .when(F.col("_found"), "extraction_miss_other_model_has_total")
        .otherwise("missing_in_both_models_mid_page")
    )
    return out.withColumn("subcategory", sub).drop("_found", "next_in_corpus")


def repair_totals(df: DataFrame, checklist: DataFrame, tier: int = 1) -> DataFrame:
    """Set is_total on the confirmed candidates up to a confidence tier."""
    fixes = checklist.filter(F.col("confidence_tier") <= tier)
    fixes = fixes.select(F.col("candidate_grn").alias(ROW), F.lit(1).alias("_fix"))
    out = df.join(fixes, ROW, "left")
    return out.withColumn("is_total", F.coalesce("_fix", F.col("is_total"))).drop("_fix")
