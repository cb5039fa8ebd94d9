"""Summary metrics of one model and comparison of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.text import percentage

FLAG = "is_one_page_townland"


def check_metrics(checks: DataFrame, by: list[str] | None = None, flag: str = FLAG) -> DataFrame:
    """A4: segment counts and rates, over everything and by one-page class, in one aggregate.

    Rows that are not one-page count as multi-page.
    """

    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    total, ok = F.col("has_total_row"), F.col("has_total_row") & F.col("valuation_ok")
    with_total, passed = count(total), count(ok)
    measures = [
        F.count("*").alias("townland_segments"),
        with_total.alias("segments_with_total_row"),
        percentage(with_total, F.count("*")).alias("segments_with_total_row_pct"),
        passed.alias("valuation_pass_count"),
        percentage(passed, with_total).alias("valuation_pass_pct"),
    ]
    if flag in checks.columns:
        one = F.coalesce(F.col(flag), F.lit(False))
        for name, chosen in (("one_page_townlands", one), ("multi_page_townlands", ~one)):
            rate = percentage(count(chosen & ok), count(chosen & total))
            measures += [
                count(chosen).alias(f"{name}_segments"),
                rate.alias(f"{name}_valuation_pass_pct"),
            ]
    return checks.groupBy(*(by or [])).agg(*measures)


def performance_summary(df: DataFrame, checks: DataFrame, model: str, review: DataFrame | None = None) -> DataFrame:
    """A4: the one-row summary of a model; the check metrics and the review count are scalar subqueries."""
    missing = F.when(F.coalesce("county_effective", F.lit("")) == "", F.col("page_name"))
    rows = df.agg(
        F.lit(model).alias("llm"),
        F.count_distinct("page_name").alias("pages_processed"),
        F.count("*").alias("entry_rows"),
        F.count_distinct(missing).alias("pages_missing_gv_join"),
    )
    metrics = check_metrics(checks)
    single = metrics.select(F.struct(*metrics.columns)).scalar()
    out = rows.withColumn("_m", single).select(*rows.columns, *[F.col(f"_m.{c}") for c in metrics.columns])
    if review is not None:
        out = out.withColumn("gv_join_review_rows", review.agg(F.count("*")).scalar())
    return out


def category_counts(report: DataFrame) -> DataFrame:
    """A5."""
    return report.groupBy("category").count()


def checked_pages(pages: DataFrame) -> DataFrame:
    """Distinct pages of a table of run pages (``run_pages``) or of any table with page names."""
    names = pages.select(F.trim("page_name").alias("page_name"))
    return names.filter("page_name <> ''").distinct()


def compare_models(summaries: DataFrame, pages_a: DataFrame, pages_b: DataFrame) -> DataFrame:
    """One row per model with its pass rate, and the number of pages checked in both (from their run pages)."""
    common = checked_pages(pages_a).intersect(checked_pages(pages_b)).agg(F.count("*"))
    columns = ["llm", "valuation_pass_pct", "valuation_pass_count", "segments_with_total_row"]
    return summaries.select(*columns).withColumn("common_pages", common.scalar())
