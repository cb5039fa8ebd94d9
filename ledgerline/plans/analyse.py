"""The analysis of one model's page documents, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerline import sinks
from ledgerline.operators.audit import check_runs, run_pages
from ledgerline.operators.diagnose import explain_missing_totals
from ledgerline.operators.entities import flag_one_page, in_scope, scope_inventory
from ledgerline.operators.linking import link_pages
from ledgerline.operators.lookup import EFFECTIVE, resolve_admin
from ledgerline.operators.ordering import BLOCK, ROW, order_rows
from ledgerline.operators.runs import contiguous_runs
from ledgerline.plans.summary import performance_summary
from ledgerline.sources.admin import scan_overrides, scan_truth
from ledgerline.sources.pages import ROW_ORDER, load_pages
from ledgerline.storage import materialize

PAGE_LINK_THRESHOLD = 0.77
PARISH_THRESHOLD = 0.9


@dataclass
class Analysis:
    combined: DataFrame
    quarantine: DataFrame
    review: DataFrame
    checks: DataFrame
    no_total: DataFrame
    one_page: DataFrame
    multi_page: DataFrame
    summary: DataFrame


def enrich(
    rows: DataFrame,
    truth: DataFrame,
    overrides: DataFrame | None = None,
    threshold: float = PARISH_THRESHOLD,
    method: str = "indel",
    blocks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ordered, joined, linked, flagged and run-numbered rows, and the join review.

    The ordered, linked and run-numbered tables are written, as later steps
    read them more than once.
    """
    ordered = order_rows(rows, ROW_ORDER, blocks)
    joined, review = resolve_admin(ordered, truth, [ROW], BLOCK, overrides, threshold, method=method)
    linked = materialize(link_pages(joined, PAGE_LINK_THRESHOLD, method=method))
    flagged = flag_one_page(linked, BLOCK, page="target_filename")
    return contiguous_runs(flagged), review


def analyse_rows(
    rows: DataFrame,
    quarantine: DataFrame,
    truth: DataFrame,
    model: str,
    overrides: DataFrame | None = None,
    threshold: float = PARISH_THRESHOLD,
    method: str = "indel",
    neighbour_method: str = "difflib",
    strip_currency: bool = True,
    blocks: int | None = None,
) -> Analysis:
    combined, review = enrich(rows, truth, overrides, threshold, method, blocks)
    checks = materialize(check_runs(combined, strip_currency=strip_currency))
    no_total = explain_missing_totals(
        combined, checks, strip_currency=strip_currency, method=neighbour_method
    )
    scoped = in_scope(combined)
    shown = (*EFFECTIVE, "townland_linked")
    return Analysis(
        combined=combined,
        quarantine=quarantine,
        review=review,
        checks=checks,
        no_total=no_total,
        one_page=scope_inventory(scoped, True, page="target_filename", shown=shown),
        multi_page=scope_inventory(scoped, False, page="target_filename", shown=shown),
        summary=performance_summary(combined, checks, model, review),
    )


def analyse_folder(
    spark: SparkSession, folder: str, model: str, truth_path: str, overrides_path: str | None = None, **options
) -> Analysis:
    """Scan, enrich, check and explain all pages of a folder; fails if no page is usable."""
    rows, quarantine = load_pages(spark, folder, model)
    if rows.isEmpty():
        raise RuntimeError(f"no usable page documents under {folder}")
    truth = scan_truth(spark, truth_path)
    return analyse_rows(rows, quarantine, truth, model, scan_overrides(spark, overrides_path), **options)


def write_analysis(result: Analysis, path: str) -> None:
    """All outputs of an analysis below one folder."""
    sinks.write_combined(result.combined.drop(ROW, BLOCK, "run_no"), f"{path}/combined_extractions")
    sinks.write_csv(result.review, f"{path}/gv_join_review")
    pages = run_pages(result.combined)
    for name, table in (("valuation_checks", result.checks), ("no_total_rows", result.no_total)):
        sinks.write_csv(sinks.with_page_cell(table, pages, ["run_no"], "page_name", "page_names"), f"{path}/{name}")
    sinks.write_json(result.one_page, f"{path}/one_page_townlands")
    sinks.write_json(result.multi_page, f"{path}/multi_page_townlands")
    sinks.write_json(result.summary, f"{path}/performance_summary")
    sinks.append_failures(result.quarantine, f"{path}/quarantine")
