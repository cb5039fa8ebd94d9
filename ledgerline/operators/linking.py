"""Carry an entity name over page boundaries."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.similarity import ratio_function
from ledgerline.functions.text import PAGE_NUMBER, clean_key, fraction, normalise_name, trim_text
from ledgerline.operators.ordering import BLOCK, ROW, dense_blocks, number_runs, with_previous
from ledgerline.operators.runs import SCOPE
from ledgerline.operators.skew import attach
from ledgerline.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE_BLOCK = 100_000  # pages that one task walks
SUMMARY_BLOCK = 256  # block summaries that one task combines
_SUMMARY = "seq int, test string, out_name string, out_norm string"


def page_boundaries(
    df: DataFrame,
    page: str,
    label: str,
    scope: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(rows with page and lead-run numbers, one boundary row per page).

    A page's lead run is its first stretch of rows with one normalised name
    and one scope. Pages are numbered in row order.
    """
    keyed = df.withColumns(
        {
            "_norm": normalise_name(label),
            "_scope": F.struct(*[trim_text(c).alias(f"s{i}") for i, c in enumerate(scope)]),
        }
    )
    keyed = number_runs(keyed, {"_page_no": ([page], None), "_stretch": ([page, "_norm", "_scope"], None)})
    filled = clean_key(label) != ""
    info = F.struct(trim_text(label).alias("name"), F.col("_norm").alias("norm"), "_scope", "_stretch")
    pages = keyed.groupBy("_page_no").agg(
        F.min("_stretch").alias("_lead"),
        F.min_by(F.struct(F.col("_norm").alias("norm"), "_scope"), ROW).alias("top"),
        F.min_by(info, F.when(filled, F.col(ROW))).alias("first"),
        F.max_by(info, F.when(filled, F.col(ROW))).alias("last"),
        F.first(page).alias("_page"),
    )
    pages = pages.withColumns(
        {
            # the run before the first filled row must already carry its name
            "reach": F.coalesce(
                (F.col("top.norm") == F.col("first.norm")) & (F.col("top._scope") == F.col("first._scope")),
                F.lit(False),
            ),
            # the outgoing name is the incoming one if the lead run reaches the last filled row
            "passes": F.coalesce(F.col("last._stretch") == F.col("_lead"), F.lit(False)),
        }
    )
    return keyed, pages


def _similar(threshold: float, method: str) -> Callable[[str | None, str], bool]:
    ratio = ratio_function(method)

    @lru_cache(maxsize=65536)
    def reaches(carried: str, first: str) -> bool:
        return ratio(carried, first) * 100.0 >= threshold

    return lambda carried, first: carried is not None and reaches(carried, first)


def _fold(threshold: float, method: str):
    """Walk one block of pages in order, from the name handed to it; only page rows, never table rows."""

    def run(pages: pd.DataFrame) -> pd.DataFrame:
        similar = _similar(threshold, method)
        pages = pages.sort_values("_page_no")
        carried, carried_norm = pages["in_name"].iloc[0], pages["in_norm"].iloc[0]
        names = []
        for linked, first, last, last_norm, reach, passes in zip(
            pages["linked"], pages["first_norm"], pages["last_name"], pages["last_norm"], pages["reach"], pages["passes"]
        ):
            if not linked:
                carried = carried_norm = None
            name = carried if reach and similar(carried_norm, first) else None
            names.append(name)
            if last is None:
                carried = carried_norm = None
            elif not (name is not None and passes):
                carried, carried_norm = last, last_norm
        return pages[["_page_no", "_lead"]].assign(name=names)

    return run


# What a block of pages does to the name handed to it. A page that a name can pass hands on that name if it is similar
# to the page's own, else its own name; any other page hands on its own name or none. So a block is a list of tests,
# one for each distinct name on the way: the first one that fails says what the block hands on, and if none fails
# the name passes. The test of a page that nothing passes is null. Lists of neighbouring blocks combine to such a list.


def _summarise(threshold: float, method: str):
    """Tests of one block of pages (seq, test, out_name, out_norm)."""

    def run(pages: pd.DataFrame) -> pd.DataFrame:
        similar = _similar(threshold, method)
        pages = pages.sort_values("_page_no")
        open_ = (pages["linked"] & pages["reach"] & pages["passes"] & pages["last_name"].notna()).tolist()
        firsts, own = pages["first_norm"].tolist(), list(zip(pages["last_name"], pages["last_norm"]))
        tests = []
        for i, first in enumerate(firsts):
            if not open_[i] or all(first != t for _, t in tests):
                tests.append((i, first if open_[i] else None))
            if not open_[i]:
                break
        after: dict[int, int] = {}  # the page whose own name the block hands on, once page i has set its own

        def end_of(i: int) -> int:
            way = []
            while i not in after:
                way.append(i)
                stop = next((j for j in range(i + 1, len(firsts)) if not open_[j] or not similar(own[i][1], firsts[j])), None)
                if stop is None:
                    after[i] = i
                else:
                    i = stop
            for j in way:
                after[j] = after[i]
            return after[i]

        rows = [(i, test, *own[end_of(i)]) for i, test in tests]
        return pd.DataFrame(rows, columns=["seq", "test", "out_name", "out_norm"]).assign(**{BLOCK: pages[BLOCK].iloc[0]})

    return run


def _handed_on(tests: list[tuple], name: tuple, similar: Callable) -> tuple:
    """(name, norm) that a block hands on when it is handed ``name``."""
    for test, out in tests:
        if test is None or not similar(name[1], test):
            return out
    return name


def _tests_by_block(rows: pd.DataFrame) -> list[tuple[int, list[tuple]]]:
    rows = rows.sort_values([BLOCK, "seq"])
    rows = rows.astype(object).where(rows.notna(), None)
    found: dict[int, list[tuple]] = {}
    for block, test, name, norm in zip(rows[BLOCK], rows["test"], rows["out_name"], rows["out_norm"]):
        found.setdefault(int(block), []).append((test, (name, norm)))
    return list(found.items())


def _combine(threshold: float, method: str):
    """Tests of neighbouring blocks as the tests of one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        similar = _similar(threshold, method)
        upper, blocks = rows["_upper"].iloc[0], _tests_by_block(rows)
        out: list[tuple] = []
        for k, (_, tests) in enumerate(blocks):
            for test, name in tests:
                if test is not None and any(test == t for t, *_ in out):
                    continue
                for _, later in blocks[k + 1 :]:
                    name = _handed_on(later, name, similar)
                out.append((test, *name))
                if test is None:
                    break
            if out[-1][0] is None:
                break
        return pd.DataFrame(out, columns=["test", "out_name", "out_norm"]).assign(seq=range(len(out)), **{BLOCK: upper})

    return run


def _hand_out(threshold: float, method: str):
    """The name handed to each of neighbouring blocks, from the one handed to the first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        similar = _similar(threshold, method)
        name, out = (rows["in_name"].iloc[0], rows["in_norm"].iloc[0]), []
        for block, tests in _tests_by_block(rows):
            out.append((block, *name))
            name = _handed_on(tests, name, similar)
        return pd.DataFrame(out, columns=[BLOCK, "in_name", "in_norm"])

    return run


def follows(page: Column, previous: Column) -> Column:
    """Whether a page name carries the next number of the same volume."""
    part = lambda c, i: F.regexp_extract(c, PAGE_NUMBER, i)
    step = part(page, 2).try_cast("bigint") - part(previous, 2).try_cast("bigint")
    return F.coalesce((part(page, 1) == part(previous, 1)) & (step == 1), F.lit(False))


def link_names(
    pages: DataFrame, threshold: float, method: str, page_block: int = PAGE_BLOCK, adjacent_only: bool = False,
    summary_block: int = SUMMARY_BLOCK,
) -> DataFrame:
    """The name each page takes over, as (_page_no, _lead, name); exact and parallel over blocks of pages.

    A parallel prefix scan: every block of ``page_block`` pages is summarised once, summaries are combined
    ``summary_block`` at a time up to one, names are handed down the same tree, and every block is walked once with the
    name handed to it. The number of jobs grows with the logarithm of the pages, whatever the chains.
    """
    pages = dense_blocks(pages, "_page_no", page_block)
    before = with_previous(pages, {"_prev": "last", "_prev_page": "_page"}, row="_page_no")
    linked = F.col("_prev").isNotNull() & F.col("first").isNotNull() & (
        F.col("_prev._scope") == F.col("first._scope")
    )
    if adjacent_only:
        linked = linked & follows(F.col("_page"), F.col("_prev_page"))
    table = materialize(
        before.select(
            "_page_no",
            BLOCK,
            "_lead",
            F.coalesce(linked, F.lit(False)).alias("linked"),
            F.col("first.norm").alias("first_norm"),
            F.col("last.name").alias("last_name"),
            F.col("last.norm").alias("last_norm"),
            "reach",
            "passes",
        )
    )
    how = fraction(threshold) * 100.0, method
    n = (table.agg(F.max(BLOCK)).first()[0] or 0) + 1
    levels: list[DataFrame] = []
    while n > 1:
        if levels:
            above = levels[-1].withColumn("_upper", F.floor(F.col(BLOCK) / summary_block).cast("int"))
            found = above.groupBy("_upper").applyInPandas(_combine(*how), f"{BLOCK} int, {_SUMMARY}")
        else:
            found = table.groupBy(BLOCK).applyInPandas(_summarise(*how), f"{BLOCK} int, {_SUMMARY}")
        levels.append(materialize(found))
        n = -(-n // summary_block)
    handed = table.sparkSession.createDataFrame([(0, None, None)], f"{BLOCK} int, in_name string, in_norm string")
    for tests in reversed(levels):
        above = handed.withColumnRenamed(BLOCK, "_upper")
        met = tests.withColumn("_upper", F.floor(F.col(BLOCK) / summary_block).cast("int")).join(above, "_upper")
        handed = materialize(met.groupBy("_upper").applyInPandas(_hand_out(*how), f"{BLOCK} int, in_name string, in_norm string"))
    walked = table.join(handed, BLOCK).groupBy(BLOCK).applyInPandas(_fold(*how), "_page_no bigint, _lead bigint, name string")
    return materialize(walked)


def link_pages(
    df: DataFrame,
    threshold: float = 0.77,
    page: str = "page_name",
    label: str = "townland_filled",
    name: str = "townland_linked",
    scope: Sequence[str] = SCOPE,
    method: str = "indel",
    page_block: int = PAGE_BLOCK,
    adjacent_only: bool = False,
    summary_block: int = SUMMARY_BLOCK,
) -> DataFrame:
    """W6 on an ordered table: the lead run of a page takes the name its predecessor ends with.

    Neighbours are pages next to each other in row order, with
    ``adjacent_only`` also in page number. Both border rows
    must share the scope and their names must be similar enough. A name read
    from a page is the one it took over itself, so it travels over any number
    of pages.
    """
    keyed, pages = page_boundaries(df, page, label, scope)
    names = link_names(pages, threshold, method, page_block, adjacent_only, summary_block)
    lead = names.filter("name is not null").select(F.col("_lead").alias("_stretch"), F.col("name").alias("_taken"))
    out = attach(keyed, lead, ["_stretch"], BLOCK)
    return out.withColumn(name, F.coalesce("_taken", label)).drop(
        "_norm", "_scope", "_page_no", "_stretch", "_taken"
    )
