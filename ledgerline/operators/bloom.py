"""A Bloom filter beside a table of finished work: most new rows are known to be new without a join.

The filter is a table of 64-bit words (block, bits, blocks). A key sets ``HASHES`` bits of the one word its hash
names, so a test reads one word; filters of the same number of blocks merge by OR, one per batch for instance. A key
whose bits are all set may be finished, any other one surely is not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

HASHES = 6
BITS_PER_KEY = 16
_SCHEMA = "block bigint, bits bigint, blocks bigint"


def blocks_for(keys: int) -> int:
    """Words of a filter for about so many keys: less than one test in a hundred is a false alarm."""
    return max(1, -(-keys * BITS_PER_KEY // 64))


def _word(key: Sequence[str | Column], blocks: Column) -> tuple[Column, Column]:
    """(block, bits) of a key; null parts count as a value of their own."""
    digest = F.xxhash64(*key, F.lit(len(key)))
    place = lambda i: F.pmod(F.call_function("shiftrightunsigned", F.xxhash64(digest, F.lit(7)), F.lit(6 * i)), F.lit(64)).cast("int")
    bits = F.lit(0).cast("bigint")
    for i in range(HASHES):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place(i)))
    return F.pmod(digest, blocks), bits


def build_filter(done: DataFrame, key: Sequence[str], blocks: int) -> DataFrame:
    """The filter of a table's keys."""
    block, bits = _word(key, F.lit(blocks).cast("bigint"))
    words = done.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    return words.withColumn("blocks", F.lit(blocks).cast("bigint"))


def merge_filters(filters: DataFrame) -> DataFrame:
    """One filter of several with the same number of blocks (rows of all of them in one table)."""
    return filters.groupBy("block", "blocks").agg(F.bit_or("bits").alias("bits")).select("block", "bits", "blocks")


def may_hold(rows: DataFrame, words: DataFrame, key: Sequence[str], name: str = "_may") -> DataFrame:
    """The rows with a flag: false where the key is surely not in the filter's table."""
    blocks = words.agg(F.max("blocks")).first()[0]
    if blocks is None:  # a filter of nothing
        return rows.withColumn(name, F.lit(False))
    block, bits = _word(key, F.lit(blocks).cast("bigint"))
    held = words.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    met = rows.withColumns({"_block": block, "_mask": bits}).join(held, "_block", "left")
    flag = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return met.withColumn(name, flag).drop("_block", "_mask", "_bits")


def work_left_filtered(
    wanted: DataFrame, done: DataFrame, key: Sequence[str], words: DataFrame, on_counts: Callable[[int, int], None] | None = None
) -> DataFrame:
    """Wanted rows without a finished counterpart; only rows that the filter cannot rule out reach the exact anti-join.

    ``words`` must be a filter of all finished keys (of more is allowed). Rows with a null in the key are never finished.
    ``on_counts`` is told how many rows there are and how many reach the join.
    """
    tested = may_hold(wanted, words, key)
    if on_counts:
        n = tested.agg(F.count("*"), F.count_if("_may")).first()
        on_counts(n[0], n[1])
    sure = tested.filter(~F.col("_may")).drop("_may")
    open_ = tested.filter("_may").drop("_may").join(done.select(*key).distinct(), list(key), "left_anti")
    return sure.unionByName(open_)
