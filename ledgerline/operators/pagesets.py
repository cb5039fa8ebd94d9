"""Distinct pages of groups as exact bitmaps over dense page numbers.

A group's pages are rows (group, word, bits): bit i of a word stands for page 64 * word + i. A group has
one row for each stretch of 64 pages that it touches, so one with few pages stays small and one with very many is
spread over as many rows; no list of pages meets in a cell. Bitmaps of parts of a table merge by OR.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators.ordering import ROW, order_rows
from ledgerline.operators.skew import attach, hash_salt
from ledgerline.storage import materialize

BITS = 64
PAGE_ID = "page_id"


def number_pages(df: DataFrame, page: str) -> DataFrame:
    """(page, page_id): the distinct pages, numbered from 0 in their order; null is none."""
    distinct = df.select(page).filter(F.col(page).isNotNull()).distinct()
    return materialize(order_rows(distinct, [page]).select(page, F.col(ROW).alias(PAGE_ID)))


def with_page_ids(df: DataFrame, pages: DataFrame, page: str, salt: Column | None = None) -> DataFrame:
    """The rows with their page's number; a page of any weight is spread by the salt."""
    return attach(df, pages, [page], hash_salt(df.columns) if salt is None else salt)


def page_words(df: DataFrame, keys: Sequence[str], page_id: str | Column = PAGE_ID) -> DataFrame:
    """(keys, word, bits) of rows that carry a page number; rows without one add no page."""
    number = F.col(page_id) if isinstance(page_id, str) else page_id
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(BITS)).cast("int"))
    known = df.filter(number.isNotNull())
    return known.groupBy(*keys, F.floor(number / BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))


def merge_words(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The bitmaps of several parts of a table as those of the whole."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def count_pages(words: DataFrame, keys: Sequence[str], name: str = "page_count") -> DataFrame:
    """(keys, page count) from bitmaps; groups without a page are absent."""
    return words.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias(name))


def pages_of(words: DataFrame, keys: Sequence[str], pages: DataFrame, page: str) -> DataFrame:
    """Long form (keys, page) of bitmaps; ``pages`` are the numbered pages."""
    is_set = lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1
    places = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), is_set)).alias("_bit")
    ids = words.select(*keys, "word", places).withColumn(PAGE_ID, F.col("word") * BITS + F.col("_bit"))
    return ids.join(pages, PAGE_ID).select(*keys, page)


def common_pages(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str = "common_pages") -> DataFrame:
    """(keys, number of pages) that groups of the same keys have in both tables of bitmaps."""
    theirs = b.withColumnRenamed("bits", "_bits")
    both = a.join(theirs, [*keys, "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("_bits")))
    return count_pages(both, keys, name).filter(F.col(name) > 0)
