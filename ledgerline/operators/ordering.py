"""Global row order without a single-task window.

``order_rows`` range-partitions the table on the order columns, numbers the
rows and writes them once. Every later scan works inside the resulting blocks
and carries state over block borders through a table with one row per block,
so neither a hot key nor the whole table ever meets in one task. That block
table has as many rows as the range exchange had partitions. Its prefix sums
are taken in two levels and joined to the rows by block, so plans do not grow with the blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.storage import materialize

ROW = "grn"
BLOCK = "blk"
BLOCK_BYTES = 1 << 29
_UNKNOWN_SIZE = 1 << 60  # what the planner says of sources it cannot measure
_ID_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33
_GROUP = 1024  # blocks whose numbers are summed up in one window partition


def order_rows(df: DataFrame, order_by: Sequence[str | Column], blocks: int | None = None) -> DataFrame:
    """Add ``grn`` (dense row number from 0, in order) and ``blk`` (its block).

    There are ``blocks`` blocks, by default as many as the session's shuffle
    partitions, and more where the scanned tables have over ``BLOCK_BYTES`` for each.
    """
    order_by = list(order_by)
    blocks = blocks or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_scanned_bytes(df) // BLOCK_BYTES))
    ranged = df.repartitionByRange(blocks, *order_by)
    tagged = materialize(
        ranged.sortWithinPartitions(*order_by).withColumn("_seq", F.monotonically_increasing_id())
    )
    tagged = tagged.withColumn(BLOCK, F.shiftright("_seq", _ID_BITS).cast("int")).withColumn(
        "_seq", F.col("_seq").bitwiseAND((1 << _ID_BITS) - 1)
    )
    sizes = tagged.groupBy(BLOCK).agg(F.count("*").alias("_offset"))
    offsets = materialize(sums_before(sizes, ["_offset"], BLOCK))
    numbered = tagged.join(offsets, BLOCK).withColumn(ROW, F.col("_offset") + F.col("_seq"))
    return numbered.select(*[c for c in df.columns if c not in (BLOCK, ROW)], BLOCK, ROW)


def _scanned_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads, as the planner knows it; 0 for a source of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    return sum(s for s in sizes if s < _UNKNOWN_SIZE)


def sums_before(table: DataFrame, columns: Sequence[str], block: str = BLOCK) -> DataFrame:
    """The table (one row per block) with each column replaced by its sum over all blocks before.

    In two levels: groups of blocks are summed, the sums before each group are taken over one row per group,
    those before each block inside its group.
    """
    table = table.withColumn("_group", F.floor(F.col(block) / _GROUP))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = table.groupBy("_group").agg(*[F.sum(c).alias(f"_of_{c}") for c in columns])
    groups = groups.select("_group", *[F.coalesce(F.sum(f"_of_{c}").over(before.orderBy("_group")), F.lit(0)).alias(f"_of_{c}") for c in columns])
    inside = before.partitionBy("_group").orderBy(block)
    sums = {c: (F.col(f"_of_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("bigint") for c in columns}
    return table.join(groups, "_group").withColumns(sums).drop("_group", *[f"_of_{c}" for c in columns])


def dense_blocks(df: DataFrame, row: str, size: int = 250_000, block: str = BLOCK) -> DataFrame:
    """Blocks for a table that already has a dense row number."""
    return df.withColumn(block, F.floor(F.col(row) / size).cast("int"))


def _in_block(row: str, block: str):
    return Window.partitionBy(block).orderBy(row)


def with_previous(
    df: DataFrame, columns: Mapping[str, str], row: str = ROW, block: str = BLOCK
) -> DataFrame:
    """Add, under the given new names, the values of the row before (null for the first row)."""
    values = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    tails = (
        df.groupBy(block)
        .agg(F.max_by(values, row).alias("_last"), F.min(row).alias(row))
        .select(block, row, F.lag("_last").over(Window.orderBy(block)).alias("_carry"))
    )
    out = df.withColumn("_before", F.lag(values).over(_in_block(row, block)))
    out = out.join(tails, [block, row], "left")
    merged = F.coalesce("_before", "_carry")
    return out.withColumns({new: merged[new] for new in columns}).drop("_before", "_carry")


def number_runs(
    df: DataFrame,
    runs: Mapping[str, tuple[Sequence[str | Column], Column | None]],
    row: str = ROW,
    block: str = BLOCK,
    marks: Mapping[str, Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Number contiguous runs of equal keys in row order, from 0.

    ``runs`` maps each new column to (key, blank): rows for which ``blank``
    holds belong to no run (null number) and end the run before them. All
    numberings share one exchange and one sort, before the keys are made; the counts inside the blocks are written once,
    after which the result is a plain scan. Keys are not written: over the block borders only a block's
    first and last row need them again.

    ``marks`` maps a numbering to new columns and conditions: whether any row of the row's run meets
    the condition (null for rows of no run). A run inside a block is settled there; the runs
    at the block borders, two a block at most, come back as a small table.
    """
    marks = {name: dict((marks or {}).get(name, {})) for name in runs}
    window = _in_block(row, block)
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    by_block = Window.orderBy(block)
    keys = {}
    for name, (key, blank) in runs.items():
        value = F.struct(*key)
        keys[f"_key_{name}"] = value if blank is None else F.when(~blank, value)
    starts, counts, marked, edges, joined, bases, ends = {}, {}, {}, [], {}, [], []
    for name in runs:
        key, start, count = (F.col(f"_{part}_{name}") for part in ("key", "start", "count"))
        starts[f"_start_{name}"] = (key.isNotNull() & ~F.lag(key).over(window).eqNullSafe(key)).cast("bigint")
        starts[f"_in_{name}"] = key.isNotNull()
        counts[f"_count_{name}"] = F.sum(start).over(so_far)
        edges += [
            F.min_by(F.struct(key.alias("k")), row).alias(f"_head_{name}"),
            F.max_by(F.struct(key.alias("k")), row).alias(f"_tail_{name}"),
            F.max(count).alias(f"_starts_{name}"),
        ]
        # 1 if the first run of a block only goes on with the last run of the block before
        head, tail = F.col(f"_head_{name}.k"), F.lag(F.col(f"_tail_{name}")).over(by_block)["k"]
        joined[f"_joined_{name}"] = F.coalesce((head.isNotNull() & head.eqNullSafe(tail)).cast("bigint"), F.lit(0))
        bases.append((F.col(f"_starts_{name}") - F.col(f"_joined_{name}")).alias(f"_base_{name}"))
        of_run = Window.partitionBy(block, f"_count_{name}")
        for mark, condition in marks[name].items():
            marked[mark] = F.bool_or(F.when(F.col(f"_in_{name}"), F.coalesce(condition, F.lit(False)))).over(of_run)
            edges += [F.min_by(mark, row).alias(f"_head_{mark}"), F.max_by(mark, row).alias(f"_tail_{mark}")]
            ends += [f"_head_{mark}", f"_tail_{mark}"]
        if marks[name]:
            for end in ("head", "tail"):
                joined[f"_{end}_in_{name}"] = F.col(f"_{end}_{name}.k").isNotNull()
            ends += [f"_head_in_{name}", f"_tail_in_{name}", f"_starts_{name}"]
    starts["_edge"] = F.lag(row).over(window).isNull() | F.lead(row).over(window).isNull()
    # a number of partitions: small bytes of many rows are not put together in a few tasks, whose sorts would spill
    placed = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), block).sortWithinPartitions(block, row)
    local = placed.withColumns(keys).withColumns(starts).withColumns(counts).withColumns(marked)
    local = materialize(local.drop(*keys, *[f"_start_{name}" for name in runs]))
    table = local.filter("_edge").withColumns(keys).groupBy(block).agg(*edges).withColumns(joined)
    table = table.select(block, *bases, *dict.fromkeys([*joined, *ends]))
    table = materialize(sums_before(table, [f"_base_{name}" for name in runs], block))
    base = lambda name: F.col(f"_base_{name}") - F.col(f"_joined_{name}")
    numbers = {name: F.when(F.col(f"_in_{name}"), base(name) + F.col(f"_count_{name}") - 1) for name in runs}
    out = local.join(table.select(block, *[f"_{part}_{name}" for name in runs for part in ("base", "joined")]), block).withColumns(numbers)
    for name, of in ((n, list(m)) for n, m in marks.items() if m):
        last = {"head": base(name), "tail": base(name) + F.col(f"_starts_{name}") - 1}
        sides = [F.struct(F.when(F.col(f"_{e}_in_{name}"), no).alias(name), *[F.col(f"_{e}_{m}").alias(f"_all_{m}") for m in of]) for e, no in last.items()]
        border = table.select(F.inline(F.array(*sides))).filter(F.col(name).isNotNull())
        border = border.groupBy(name).agg(*[F.bool_or(f"_all_{m}").alias(f"_all_{m}") for m in of])
        out = out.join(border, name, "left").withColumns({m: F.when(F.col(name).isNotNull(), F.coalesce(f"_all_{m}", m)) for m in of})
    return out.select(*[c for c in df.columns if c not in runs and c not in marked], *runs, *marked)


def fill_down(
    df: DataFrame,
    group: Sequence[str],
    value: Column,
    name: str,
    row: str = ROW,
    block: str = BLOCK,
) -> DataFrame:
    """Last non-null ``value`` of the same group up to this row.

    The row order must keep each group together (order by the group columns
    first); a group may span any number of blocks.
    """
    key = F.struct(*group)
    window = Window.partitionBy(block, *group).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_value", value)
    tails = local.groupBy(block, *group).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(row))).alias("_value"),
        F.max(row).alias("_end"),
    )
    tails = tails.groupBy(block).agg(
        F.max_by(F.struct(key.alias("key"), F.col("_value").alias("value")), "_end").alias("_tail")
    )
    same_group = (
        Window.partitionBy("_tail.key").orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    )
    tails = tails.withColumn("_seen", F.last("_tail.value", ignorenulls=True).over(same_group))
    by_block = Window.orderBy(block)
    tails = tails.select(
        block,
        F.lag("_tail.key").over(by_block).alias("_carry_key"),
        F.lag("_seen").over(by_block).alias("_carry"),
    )
    carried = F.when(key.eqNullSafe(F.col("_carry_key")), F.col("_carry"))
    return (
        local.withColumn("_filled", F.last("_value", ignorenulls=True).over(window))
        .join(tails, block)
        .withColumn(name, F.coalesce("_filled", carried))
        .drop("_value", "_filled", "_carry_key", "_carry")
    )
