"""Attach authoritative attributes by an exact, then fallback, then fuzzy cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.similarity import best_similarity, char_signature, ratio_at_most
from ledgerline.functions.text import fraction, is_filled, normalise_name, normalise_parish, prefer, trim_text
from ledgerline.operators.skew import attach
from ledgerline.storage import materialize

EFFECTIVE = ("county_effective", "barony_effective", "parish_effective")
VERIFIED = ("county_gv", "barony_gv", "parish_gv")
METHOD = "gv_join_method"
REVIEW_COLUMNS = (
    "page_name",
    "llm_parish",
    "llm_parish_norm",
    "status",
    "candidate_rank",
    "score",
    "county",
    "barony",
    "parish",
    "parish_gv",
    "county_effective",
    "barony_effective",
    "parish_effective",
)
TOP_CANDIDATES = 3


def admin_records(truth: DataFrame, order: str = "row_no") -> DataFrame:
    """one admin record per truth row with its page and row order; rows without a page are dropped."""
    county, barony, parish = (prefer(f"{c}_gv", c) for c in ("county", "barony", "parish"))
    record = F.struct(
        county.alias("county_effective"),
        barony.alias("barony_effective"),
        parish.alias("parish_effective"),
        trim_text("parish").alias("parish_display"),
        trim_text("parish_gv").alias("parish_gv_display"),
        trim_text("townland").alias("townland_display"),
    )
    keys = F.array(
        F.when(is_filled("parish_gv"), normalise_name("parish_gv")),
        F.when(is_filled("parish"), normalise_name("parish")),
        F.when(is_filled("parish"), normalise_parish("parish")),
    )
    return truth.select(
        trim_text("target_filename").alias("page"),
        F.col(order).alias("row_no"),
        record.alias("rec"),
        F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != ""))).alias("parish_keys"),
    ).filter("page <> ''")


def build_lookup(truth: DataFrame, order: str = "row_no") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by page and parish, page fallback, distinct candidates per page).

    The first row of a key wins, unless only a later one has a county. The
    records are written once, as all three tables are derived from them.
    """
    records = materialize(admin_records(truth, order))
    has_county = F.col("rec.county_effective") != ""
    by_key = (
        records.withColumn("parish_norm", F.explode("parish_keys"))
        .groupBy("page", "parish_norm")
        .agg(F.min_by("rec", F.struct((~has_county).alias("late"), "row_no")).alias("rec"))
    )
    fallback = records.filter(has_county).groupBy("page").agg(F.min_by("rec", "row_no").alias("fallback"))
    candidates = records.groupBy("page", *[f"rec.{c}" for c in EFFECTIVE]).agg(
        F.min_by("rec", "row_no").alias("rec"), F.min("row_no").alias("row_no")
    )
    ranked = Window.partitionBy("page").orderBy("row_no")
    candidates = candidates.select("page", "rec", F.row_number().over(ranked).alias("rank"))
    return by_key, fallback, candidates


ADMIN = (*VERIFIED, *EFFECTIVE)


def _with_keys(df: DataFrame, page: str, parish: str) -> DataFrame:
    return df.withColumns({"page": trim_text(page), "parish_norm": normalise_parish(parish)})


def _admin_columns(record: Column, found: Column, otherwise: Column | None = None) -> dict[str, Column]:
    """The six admin columns from a record; both triples hold the effective values."""
    out = {}
    for verified, effective in zip(VERIFIED, EFFECTIVE):
        for column in (verified, effective):
            kept = F.lit("") if otherwise is None else F.col(column)
            out[column] = F.when(found, record[effective]).otherwise(kept)
    return out


def cascade(keys: DataFrame, lookup: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """J2 on distinct (page, parish_norm): exact hit with a county, else the page's fallback, else blank."""
    by_key, fallback, _ = lookup
    return _settled(keys.join(by_key, ["page", "parish_norm"], "left").join(fallback, "page", "left"))


def _settled(found: DataFrame) -> DataFrame:
    """The admin columns and the method from ``rec`` (the exact hit) and ``fallback``, which may be null."""
    exact = F.coalesce(F.col("rec.county_effective"), F.lit("")) != ""
    found = found.withColumns(
        {
            METHOD: F.when(exact, "parish_key").when(F.col("fallback").isNotNull(), "page_fallback").otherwise("unresolved"),
            "_chosen": F.when(exact, F.col("rec")).otherwise(F.col("fallback")),
        }
    )
    columns = _admin_columns(F.col("_chosen"), F.col("_chosen").isNotNull())
    return found.withColumns(columns).drop("rec", "fallback", "_chosen")


def join_admin(
    df: DataFrame,
    truth: DataFrame,
    salt: Column | str,
    page: str = "page_name",
    parish: str = "parish",
    label: str = "townland_filled",
    order: str = "row_no",
) -> DataFrame:
    """Add the six admin columns, the join method and townland_gv.

    The cascade runs on the distinct (page, parish) keys; rows get the result
    through a salted join, so neither a hot page nor a large truth table needs
    a broadcast.
    """
    rows = _with_keys(df, page, parish)
    keys = rows.select("page", "parish_norm").distinct()
    out = attach(rows, cascade(keys, build_lookup(truth, order)), ["page", "parish_norm"], salt)
    return out.drop("page", "parish_norm").withColumn("townland_gv", F.col(label))


def page_lookup(truth: DataFrame, order: str = "row_no") -> DataFrame:
    """J1 with one row per page: (page, by_parish, fallback); ``by_parish`` maps the parish keys of the page to their records."""
    by_key, fallback, _ = build_lookup(truth, order)
    pairs = F.collect_list(F.struct("parish_norm", "rec"))  # the parishes of one page
    packed = by_key.groupBy("page").agg(F.map_from_entries(pairs).alias("by_parish"))
    return packed.join(fallback, "page", "full")


def store_by_page(df: DataFrame, table: str, path: str, page: str | None = None, buckets: int = 200) -> DataFrame:
    """Write a table in buckets by its trimmed page (column ``page``), sorted in them; tables of as many buckets join without an exchange."""
    keyed = df if page is None else df.withColumn("page", trim_text(page))
    # one writer task per bucket, so that a bucket is one sorted file
    dealt = keyed.repartition(buckets, "page")
    dealt.write.bucketBy(buckets, "page").sortBy("page").option("path", path).mode("errorifexists").saveAsTable(table)
    return df.sparkSession.table(table)


def join_admin_stored(rows: DataFrame, lookup: DataFrame, parish: str = "parish", label: str = "townland_filled") -> DataFrame:
    """J2 on tables stored by page: rows with their ``page``, and ``page_lookup``. Where both have the same buckets nothing is shuffled.

    For rows that are looked up again and again, or that arrive stored. A page of very many rows stays one
    task's; ``join_admin`` splits it.
    """
    found = rows.withColumn("parish_norm", normalise_parish(parish)).join(lookup, "page", "left")
    found = found.withColumn("rec", F.try_element_at("by_parish", F.col("parish_norm"))).drop("by_parish")
    return _settled(found).drop("page", "parish_norm").withColumn("townland_gv", F.col(label))


def clean_overrides(overrides: DataFrame, order: str = "row_no") -> DataFrame:
    """Last override per (page, parish); a blank parish stands for the whole page."""
    fields = F.struct(*[prefer(c, F.lit("")).alias(c) for c in EFFECTIVE])
    keyed = overrides.select(
        trim_text("page_name").alias("page"),
        normalise_parish("llm_parish").alias("parish_norm"),
        fields.alias("override"),
        F.col(order).alias("row_no"),
    ).filter("page <> ''")
    return keyed.groupBy("page", "parish_norm").agg(F.max_by("override", "row_no").alias("override"))


def _overridden(groups: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """The override of each group: its own parish before the whole page; it needs a county."""
    if overrides is None:
        return groups.withColumn("_override", F.lit(None).cast("struct<" + ",".join(f"{c}:string" for c in EFFECTIVE) + ">"))
    rules = clean_overrides(overrides)
    exact = rules.withColumnRenamed("override", "_exact")
    whole = rules.filter("parish_norm = ''").select("page", F.col("override").alias("_whole"))
    both = groups.join(exact, ["page", "parish_norm"], "left").join(whole, "page", "left")
    chosen = F.coalesce("_exact", "_whole")
    usable = F.coalesce(chosen["county_effective"], F.lit("")) != ""
    return both.withColumn("_override", F.when(usable, chosen)).drop("_exact", "_whole")


def _shown_labels() -> Column:
    """the normalised labels of a candidate."""
    shown = [F.col(f"rec.{c}") for c in ("parish_gv_display", "parish_display", "parish_effective")]
    forms = [
        F.when(is_filled(c), F.array(normalise_name(c), normalise_parish(c))).otherwise(F.array().cast("array<string>"))
        for c in shown
    ]
    return F.array_distinct(F.flatten(F.array(*forms)))


SPLIT_NAMES = 2000  # names of a page that meet its candidates in one task


def bounded_scores(groups: DataFrame, candidates: DataFrame, method: str, top: int = TOP_CANDIDATES) -> DataFrame:
    """Every candidate of every (page, parish_norm) of ``groups`` with its ``score`` (0..100), null where it cannot be among the first.

    ``candidates`` are (page, rank, _labels). Best first: lengths and signatures bound all scores, natively. The candidates with
    the highest bounds are scored, and of the others only those whose bound reaches the last of these scores; no other
    one can be among the first ``top``. A candidate without labels scores 0. Candidates are written once, so their
    measured size decides whether they are broadcast; then the rows of a group never move. Names of a page
    beyond SPLIT_NAMES are dealt to several tasks.
    """
    group = ["page", "parish_norm"]
    parts = groups.groupBy("page").agg(F.ceil(F.count("*") / SPLIT_NAMES).cast("int").alias("_parts"))
    bags = F.transform("_labels", lambda t: F.struct(F.length(t).alias("n"), char_signature(t).alias("bits")))
    offered = candidates.select("page", "rank", "_labels", bags.alias("_bags")).join(parts, "page")
    offered = materialize(offered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"))
    wanted = groups.join(parts, "page").withColumn("_salt", F.pmod(F.xxhash64("parish_norm"), F.col("_parts")).cast("int")).drop("_parts")
    wanted = wanted.withColumn("_bits", char_signature("parish_norm")).repartition(*group)
    most = F.transform("_bags", lambda b: ratio_at_most(F.col("_bits"), F.length("parish_norm"), b["bits"], b["n"]) * 100.0)
    rows = wanted.join(offered, ["page", "_salt"]).withColumn("_most", F.coalesce(F.array_max(most), F.lit(0.0))).drop("_salt", "_bags", "_bits")
    likely = Window.partitionBy(*group).orderBy(F.desc("_most"), "rank")
    rows = rows.withColumn("_first", F.row_number().over(likely) <= top)

    def scored(when: Column) -> Column:
        return best_similarity(F.when(when, F.col("parish_norm")), F.when(when, F.col("_labels")), method) * 100.0

    rows = rows.withColumn("_score", scored(F.col("_first")))
    rows = rows.withColumn("_least", F.min("_score").over(Window.partitionBy(*group)))
    rows = rows.withColumn("_other", scored(~F.col("_first") & (F.col("_most") >= F.col("_least"))))
    return rows.withColumn("score", F.coalesce("_score", "_other")).drop("_labels", "_most", "_first", "_score", "_least", "_other")


def top_candidates(groups: DataFrame, candidates: DataFrame, method: str, top: int = TOP_CANDIDATES) -> DataFrame:
    """The ``top`` candidates of each (page, parish_norm) by (score, rank), with ``score`` and place ``_rn``."""
    best_first = Window.partitionBy("page", "parish_norm").orderBy(F.desc("score"), "rank")
    every = bounded_scores(groups, candidates, method, top).filter("score is not null")
    return every.withColumn("_rn", F.row_number().over(best_first)).filter(F.col("_rn") <= top)


def match_groups(
    groups: DataFrame,
    candidates: DataFrame,
    overrides: DataFrame | None,
    threshold: float,
    margin: float,
    method: str,
) -> tuple[DataFrame, DataFrame]:
    """J3 on distinct (page, parish_norm, complete, llm_parish): (decisions, review rows).

    A decision is (page, parish_norm, record, method). Only groups of pages
    that have candidates, without an override and without a county, are scored.
    """
    limit = fraction(threshold) * 100.0
    known = candidates.select("page").distinct()
    groups = _overridden(groups.filter("parish_norm <> ''").join(known, "page", "left_semi"), overrides)
    overridden = groups.filter("_override is not null").select(
        "page", "parish_norm", F.col("_override").alias("_rec"), F.lit("override").alias("_method")
    )
    labels = candidates.select("page", "rank", _shown_labels().alias("_labels"))
    wanted = groups.filter("_override is null and not complete").select("page", "parish_norm", "llm_parish")
    top = top_candidates(wanted, labels, method).join(candidates, ["page", "rank"])
    ranked = top.groupBy("page", "parish_norm", "llm_parish").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "score", "rank", "rec"))).alias("top")
    )
    best, second = F.col("top")[0], F.get(F.col("top"), F.lit(1))
    status = (
        F.when(best["score"] < limit, "low_score")
        .when(best["score"] - second["score"] < margin, "ambiguous")
        .otherwise("fuzzy_parish")
    )
    ranked = ranked.withColumn("status", status)
    applied = ranked.filter("status = 'fuzzy_parish'").select(
        "page",
        "parish_norm",
        F.struct(*[best["rec"][c].alias(c) for c in EFFECTIVE]).alias("_rec"),
        F.col("status").alias("_method"),
    )
    queued = ranked.filter("status <> 'fuzzy_parish'").withColumn("c", F.explode("top"))
    queued = queued.select(
        F.col("page").alias("page_name"),
        "llm_parish",
        F.col("parish_norm").alias("llm_parish_norm"),
        "status",
        F.col("c.rank").cast("int").alias("candidate_rank"),
        F.round("c.score", 2).alias("score"),
        F.col("c.rec.county_effective").alias("county"),
        F.col("c.rec.barony_effective").alias("barony"),
        F.col("c.rec.parish_display").alias("parish"),
        F.col("c.rec.parish_gv_display").alias("parish_gv"),
        *[F.col(f"c.rec.{c}") for c in EFFECTIVE],
    )
    return applied.unionByName(overridden), queued


def unknown_pages(rows: DataFrame, candidates: DataFrame, parish: str) -> DataFrame:
    """Review rows for the distinct parishes of pages that the truth table does not know."""
    unknown = rows.select("page", "parish_norm", F.col(parish).alias("llm_parish")).distinct()
    unknown = unknown.filter("llm_parish is not null").join(candidates.select("page").distinct(), "page", "left_anti")
    return unknown.select(
        F.col("page").alias("page_name"),
        "llm_parish",
        F.col("parish_norm").alias("llm_parish_norm"),
        F.lit("no_gv_rows").alias("status"),
        F.lit(None).cast("int").alias("candidate_rank"),
        F.lit(None).cast("double").alias("score"),
        *[F.lit("").alias(c) for c in REVIEW_COLUMNS[6:]],
    )


def _decide(table: DataFrame) -> DataFrame:
    """Overwrite the admin columns and the method where a decision is present."""
    changed = F.col("_method").isNotNull()
    columns = _admin_columns(F.col("_rec"), changed, otherwise=F.lit(None))
    columns[METHOD] = F.when(changed, F.col("_method")).otherwise(F.col(METHOD))
    return table.withColumns(columns).drop("_rec", "_method")


def resolve_fuzzy(
    df: DataFrame,
    truth: DataFrame,
    row_order: Sequence[str],
    salt: Column | str,
    overrides: DataFrame | None = None,
    threshold: float = 0.9,
    margin: float = 5.0,
    method: str = "indel",
    page: str = "page_name",
    parish: str = "parish",
    order: str = "row_no",
) -> tuple[DataFrame, DataFrame]:
    """J3/J4 on joined rows: (updated rows, review table K4).

    Overrides come first, then the clearly best similar candidate of the page;
    the rest goes to review.
    """
    candidates = build_lookup(truth, order)[2]
    rows = _with_keys(df, page, parish)
    groups = rows.groupBy("page", "parish_norm").agg(
        F.bool_and(is_filled("county_effective")).alias("complete"),
        F.min_by(parish, F.struct(*row_order)).alias("llm_parish"),
    )
    decisions, queued = match_groups(groups, candidates, overrides, threshold, margin, method)
    updated = _decide(attach(rows, decisions, ["page", "parish_norm"], salt)).drop("page", "parish_norm")
    return updated, queued.unionByName(unknown_pages(rows, candidates, parish))


def resolve_admin(
    df: DataFrame,
    truth: DataFrame,
    row_order: Sequence[str],
    salt: Column | str,
    overrides: DataFrame | None = None,
    threshold: float = 0.9,
    margin: float = 5.0,
    method: str = "indel",
    fuzzy_before_fallback: bool = False,
    page: str = "page_name",
    parish: str = "parish",
    label: str = "townland_filled",
    order: str = "row_no",
) -> tuple[DataFrame, DataFrame]:
    """J2 and J3 together, both on the distinct keys, so rows are joined once.

    ``fuzzy_before_fallback`` also scores groups that only have the page's
    fallback; by default a fallback county settles a group.
    """
    lookup = build_lookup(truth, order)
    rows = _with_keys(df, page, parish)
    keys = rows.groupBy("page", "parish_norm").agg(F.min_by(parish, F.struct(*row_order)).alias("llm_parish"))
    resolved = materialize(cascade(keys, lookup))
    settled = is_filled("county_effective")
    if fuzzy_before_fallback:
        settled = settled & (F.col(METHOD) != "page_fallback")
    groups = resolved.select("page", "parish_norm", "llm_parish", settled.alias("complete"))
    decisions, queued = match_groups(groups, lookup[2], overrides, threshold, margin, method)
    values = _decide(resolved.drop("llm_parish").join(decisions, ["page", "parish_norm"], "left"))
    out = attach(rows, values, ["page", "parish_norm"], salt)
    out = out.drop("page", "parish_norm").withColumn("townland_gv", F.col(label))
    return out, queued.unionByName(unknown_pages(rows, lookup[2], parish))
