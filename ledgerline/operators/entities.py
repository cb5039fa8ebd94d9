"""Canonical entities by fuzzy clustering, and where they occur."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.text import is_filled, normalise_name, trim_text
from ledgerline.operators.components import connected_components
from ledgerline.operators.continuation import resolve_continued
from ledgerline.operators.lookup import EFFECTIVE, VERIFIED
from ledgerline.operators.simjoin import similar_pairs
from ledgerline.operators.skew import attach, hash_salt
from ledgerline.storage import materialize

CANONICAL = "townland_canonical"
LINK_KEYS = (*EFFECTIVE, "townland_linked")
CANONICAL_KEYS = (*VERIFIED, CANONICAL)
HOT_ROWS = 100_000  # rows of one name that a task takes


def components(
    pairs: DataFrame, block: Sequence[str], a: str = "name_a", b: str = "name_b", on_round: Callable[[int], None] | None = None
) -> DataFrame:
    """G1: smallest name of the connected component of each paired name, as (block, name, canonical)."""
    found = connected_components(pairs, a, b, block, on_round)
    return found.withColumnsRenamed({"node": "name", "component": "canonical"})


def canonical_map(
    df: DataFrame,
    scope: Sequence[str] = VERIFIED,
    label: str = "townland_gv",
    threshold: float = 0.9,
    method: str = "indel",
    normalise_scope: bool = True,
) -> DataFrame:
    """G1: (normalised scope, normalised name) -> canonical name; blank maps to blank."""
    return _counted_map(df, scope, label, threshold, method, normalise_scope).drop("_rows")


def _counted_map(
    df: DataFrame, scope: Sequence[str], label: str, threshold: float, method: str, normalise_scope: bool
) -> DataFrame:
    """``canonical_map`` with the number of rows of each name."""
    fold = normalise_name if normalise_scope else (lambda c: F.lower(trim_text(c)))
    block = [f"_k{i}" for i in range(len(scope))]
    names = df.select(*[fold(c).alias(k) for k, c in zip(block, scope)], normalise_name(label).alias("name"))
    names = materialize(names.groupBy(*block, "name").agg(F.count("*").alias("_rows")))
    pairs = similar_pairs(names.drop("_rows"), block, "name", threshold, method)
    found = components(pairs, block)
    return names.join(found, [*block, "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))


def add_canonical(
    df: DataFrame,
    scope: Sequence[str] = VERIFIED,
    label: str = "townland_gv",
    name: str = CANONICAL,
    threshold: float = 0.9,
    method: str = "indel",
    normalise_scope: bool = True,
    salt: Column | str | None = None,
) -> DataFrame:
    """Look the canonical name up; unmatched rows keep their own normalised name.

    Only names of more than ``HOT_ROWS`` rows, a short list, are dealt by ``salt``; the rows of any other name meet it in one task.
    """
    mapping = _counted_map(df, scope, label, threshold, method, normalise_scope)
    block = [f"_k{i}" for i in range(len(scope))]
    fold = normalise_name if normalise_scope else (lambda c: F.lower(trim_text(c)))
    keyed = df.withColumns({k: fold(c) for k, c in zip(block, scope)}).withColumn("_name", normalise_name(label))
    mapping = mapping.withColumnRenamed("name", "_name")
    hot = materialize(mapping.filter(F.col("_rows") > HOT_ROWS).select(*block, "_name", F.lit(True).alias("_hot")))
    keyed = keyed.join(hot, [*block, "_name"], "left")
    mapping = mapping.select(*block, "_name", F.col("canonical").alias("_canon"))
    salt = hash_salt(df.columns) if salt is None else salt
    salt = F.when(F.col("_hot"), F.col(salt) if isinstance(salt, str) else salt).otherwise(F.lit(0))
    out = attach(keyed, mapping, [*block, "_name"], salt)
    return out.withColumn(name, F.coalesce("_canon", "_name")).drop(*block, "_name", "_canon", "_hot")


def resolve_and_cluster(
    df: DataFrame,
    order_by: Sequence[str],
    threshold: float = 0.9,
    page: str = "page_name",
    method: str = "indel",
) -> DataFrame:
    """W7, then G1, on rows with an admin county (P3); the others get ''.

    If no row has one, all rows only get their normalised name.
    """
    known = is_present("county_gv")
    if df.filter(known).isEmpty():
        return df.withColumn(CANONICAL, normalise_name("townland_gv"))
    resolved = materialize(resolve_continued(df.filter(known), order_by, threshold, page, method=method))
    clustered = add_canonical(resolved, threshold=threshold, method=method)
    rest = df.filter(~known).withColumn(CANONICAL, F.lit(""))
    return clustered.unionByName(rest)


def is_present(county: str) -> Column:
    """The county is neither null nor blank."""
    return trim_text(county) != ""


def page_scope(df: DataFrame, keys: Sequence[str] = LINK_KEYS, page: str = "page_name") -> DataFrame:
    """A2: page count per entity and whether it stays on one page; both classes in one pass."""
    counted = df.groupBy(*keys).agg(F.count_distinct(page).alias("page_count"))
    return counted.withColumn("is_one_page", F.col("page_count") == 1)


def in_scope(df: DataFrame, county: str = "county_effective", label: str = "townland_linked") -> DataFrame:
    """Rows with a county and a linked name."""
    return df.filter(is_filled(county) & (trim_text(label) != ""))


def flag_one_page(
    df: DataFrame,
    salt: Column | str,
    keys: Sequence[str] = LINK_KEYS,
    page: str = "page_name",
    name: str = "is_one_page_townland",
) -> DataFrame:
    """Mark the rows of one-page entities; rows out of scope are False."""
    flags = page_scope(in_scope(df), keys, page).filter("is_one_page").select(*keys, F.lit(True).alias(name))
    return attach(df, flags, keys, salt).withColumn(name, F.coalesce(name, F.lit(False)))


def scope_inventory(
    df: DataFrame,
    one_page: bool,
    keys: Sequence[str] = LINK_KEYS,
    page: str = "page_name",
    shown: Sequence[str] | None = None,
) -> DataFrame:
    """K5/K6: distinct (entity, page) rows of the one-page or the multi-page entities.

    The distinct comes first, so the semi-join works on (entity, page) rows.
    """
    shown = list(shown or keys)
    wanted = F.col("is_one_page") if one_page else ~F.col("is_one_page")
    scope = page_scope(df, keys, page).filter(wanted).select(*keys)
    columns = list(dict.fromkeys([*keys, *shown, page]))
    rows = df.select(*columns).distinct().join(scope, list(keys), "left_semi")
    return rows.select(*shown, F.col(page).alias("target_filename")).distinct()


def entity_summary(df: DataFrame, keys: Sequence[str] = CANONICAL_KEYS, page: str = "target_filename") -> DataFrame:
    """A3: page count and one-page flag per entity; the pages themselves are ``entity_pages``, one row each."""
    return page_scope(df, keys, page)


def entity_pages(df: DataFrame, keys: Sequence[str] = CANONICAL_KEYS, page: str = "target_filename") -> DataFrame:
    """A3/K7: distinct (entity, page) rows."""
    return df.select(*keys, page).filter(F.col(page).isNotNull()).distinct()


def pages_to_check(df: DataFrame, keys: Sequence[str] = CANONICAL_KEYS, page: str = "target_filename") -> DataFrame:
    """Distinct pages of the one-page entities; sort at the sink."""
    single = page_scope(df, keys, page).filter("is_one_page").select(*keys)
    pages = df.select(*keys, page).distinct().join(single, list(keys), "left_semi")
    return pages.filter(F.col(page).isNotNull()).select(page).distinct()
