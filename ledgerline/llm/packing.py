"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Unplaced documents and the gaps of open sequences are rows of one table. Each round
range-sorts them by size. Blocks of the order sweep at the same time: a gap
takes the largest free document that fits (its predecessor in the order, the
document's successor). What stays free at the ends of the blocks is matched over
block borders by its rank, so no two documents get the same gap. Gaps shrink, and
the next round begins.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.llm.base import case, map_rows, table
from ledgerline.llm.tokens import Encoder
from ledgerline.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

CAPACITY = 1024
END_ID = 2
BLOCK_ROWS = 20_000  # documents and gaps that one task sweeps
DOC, GAP, PLACED = 0, 1, 2
_STATE = "kind int, size bigint, id bigint, seq bigint, blk int, nth bigint"


def cut_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    vocabulary: str | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text encoded, ``end_id`` added, cut if longer than ``capacity``.

    All pieces of a cut document are full but the first, which may be shorter.
    A null text is an empty one: its only token is ``end_id``.
    """

    def cut():
        import zlib

        encoder = Encoder(vocabulary)

        def work(batch):
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.ids(body.as_py() or ""), end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, i, s, e - s, zlib.crc32(ids[s:e].tobytes())) for i, (s, e) in enumerate(zip(bounds, bounds[1:]))]
            if rows:
                yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows)))

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return map_rows(rows, cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Sweep:
    """One block of the order: documents wait on a stack, a gap takes the largest that fit."""

    def __init__(self, opens: bool = False, capacity: int = CAPACITY) -> None:
        self.opens, self.capacity = opens, capacity
        self.sizes: list[int] = []
        self.ids: list[int] = []
        self.out: list[tuple] = []
        self.free_gaps = 0

    def fill(self, gap: int, seq: int) -> int:
        """Place the largest documents that fit, one after the other; returns what is left of the gap."""
        while self.sizes:
            i = bisect_right(self.sizes, gap) - 1
            if i < 0:
                break
            size, doc = self.sizes.pop(i), self.ids.pop(i)
            self.out.append((PLACED, self.capacity - gap, doc, seq, None, None))
            gap -= size
        return gap

    def add(self, kind: int, size: int, item: int) -> None:
        if kind == DOC:
            self.sizes.append(size)
            self.ids.append(item)
            return
        left = self.fill(size, item)
        if left == size and not self.opens:
            self.out.append((GAP, size, item, None, 1, self.free_gaps))
            self.free_gaps += 1
        elif left and not self.opens:
            self.out.append((GAP, left, item, None, None, None))

    def end(self) -> None:
        """Documents without a gap: they stay free, or open sequences of their own, the largest first."""
        if not self.opens:
            self.out += [(DOC, s, i, None, 1, n) for n, (s, i) in enumerate(zip(self.sizes, self.ids))]
            return
        while self.sizes:
            size, doc = self.sizes.pop(), self.ids.pop()
            self.out.append((PLACED, 0, doc, doc, None, None))
            self.fill(self.capacity - size, doc)


def _sweep_blocks(state: DataFrame, blocks: int, opens: bool, capacity: int) -> DataFrame:
    """Sweep every block; free documents and gaps keep their block and their rank in it."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, one = TaskContext.get().partitionId(), Sweep(opens, capacity)

        def drain():
            columns = list(zip(*one.out)) or [()] * 6
            one.out = []
            free = [None if b is None else block for b in columns[4]]
            arrays = [
                pa.array(c, t)
                for c, t in zip([*columns[:4], free, columns[5]], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", "size", "id", "seq", "blk", "nth"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                one.add(*row)
            if len(one.out) > 10_000:
                yield drain()
        one.end()
        yield drain()

    order = [F.col("size"), F.col("kind"), F.col("id")]
    rows = state.select("kind", "size", "id")
    ranged = rows.repartition(1) if blocks == 1 else rows.repartitionByRange(blocks, *order)
    return ranged.sortWithinPartitions(*order).mapInArrow(sweep, _STATE)


def plan_borders(classes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the free rows of each class stand on the stack of free documents, from (blk, kind, size, count).

    Classes come in the order of the blocks, the gaps of a block before its documents.
    Returns (blk, kind, size, first rank in the block, height, pops): a document of rank r pushes
    at height + r - first. A gap pops ``pops`` documents one after the other, as many as surely fit: the
    stack's top is its largest document.
    """
    out, stack, height = [], [], 0
    rank: dict[tuple[int, int], int] = {}
    for blk, kind, size, count in sorted(classes, key=lambda c: (c[0], -c[1], c[2])):
        first = rank.get((blk, kind), 0)
        rank[blk, kind] = first + count
        if kind == DOC:
            out.append((blk, kind, size, first, height, 0))
            stack.append([size, count])
            height += count
            continue
        waiting = sum(n for _, n in stack)
        pops = max(1, min(size // stack[-1][0], -(-waiting // count))) if stack else 1
        out.append((blk, kind, size, first, height, pops))
        height -= pops * count
        taken = pops * count
        while stack and taken:
            step = min(taken, stack[-1][1])
            stack[-1][1] -= step
            taken -= step
            if not stack[-1][1]:
                stack.pop()
    return out


def _match_borders(swept: DataFrame, capacity: int) -> DataFrame:
    """Match what the blocks left free: a gap takes the nearest free documents of the blocks before.

    The free documents form a stack over the blocks; each free row knows the height at which it
    pushes or pops, and a document belongs to the gap that next comes down to its height. A
    block passes a height at most twice, so no group of this step is large.
    """
    free, rest = swept.filter("blk IS NOT NULL"), swept.filter("blk IS NULL").select("kind", "size", "id", "seq")
    counts = free.groupBy("blk", "kind", "size").count().collect()  # blocks hold ranges of sizes: about one row per size and block
    plan = plan_borders([tuple(r) for r in counts])
    base = swept.sparkSession.createDataFrame(plan, "blk int, kind int, size bigint, first bigint, height bigint, pops int")
    at = F.col("nth") - F.col("first")
    slot = F.explode(F.sequence(F.lit(0), F.greatest(F.col("pops") - 1, F.lit(0)))).alias("slot")
    rows = free.join(base, ["blk", "kind", "size"]).select("blk", "kind", "size", "id", "pops", at.alias("at"), "height", slot)
    is_doc = F.col("kind") == DOC
    height = F.when(is_doc, F.col("height") + F.col("at")).otherwise(F.col("height") - F.col("at") * F.col("pops") - F.col("slot") - 1)
    rows = rows.withColumns({"height": height, "side": F.when(is_doc, 1).otherwise(0)})
    order = Window.partitionBy("height").orderBy("blk", "side")
    met = rows.select(
        "kind", "size", "id", "slot",
        F.lead("kind").over(order).alias("_next"),
        F.when(F.lag("kind").over(order) == DOC, F.struct(F.lag("size").over(order).alias("size"), F.lag("id").over(order).alias("id"))).alias("_doc"),
    )
    unmet = met.filter(is_doc & ~F.col("_next").eqNullSafe(F.lit(GAP))).select("kind", "size", "id", F.lit(None).cast("bigint").alias("seq"))
    gap = Window.partitionBy("id").orderBy("slot")
    size = F.coalesce("_doc.size", F.lit(0))
    filled = met.filter(~is_doc).select(
        "size", "id", "slot", "_doc", F.sum(size).over(gap).alias("_upto"), F.sum(size).over(Window.partitionBy("id")).alias("_all")
    )
    left = F.col("size") - F.col("_all")
    outcome = F.array(
        F.when(F.col("_doc").isNotNull(), _row(PLACED, F.lit(capacity) - F.col("size") + F.col("_upto") - F.col("_doc.size"), F.col("_doc.id"), F.col("id"))),
        F.when((F.col("slot") == 0) & (left > 0), _row(GAP, left, F.col("id"))),
    )
    return rest.unionByName(unmet).unionByName(filled.select(F.inline(F.array_compact(outcome))))


def _row(kind: int, size: Column, item: Column, seq: Column | None = None) -> Column:
    seq = F.lit(None) if seq is None else seq
    return F.struct(
        F.lit(kind).alias("kind"), size.cast("bigint").alias("size"), item.cast("bigint").alias("id"), seq.cast("bigint").alias("seq")
    )


def _opened(condition: Column, capacity: int, size: str = "size", item: str = "id") -> Column:
    """Rows of a document: placed first in a sequence of its own, whose gap is open; else still free."""
    gap = _row(GAP, F.lit(capacity) - F.col(size), F.col(item))
    placed = _row(PLACED, F.lit(0), F.col(item), F.col(item))
    return F.when(condition, F.array(placed, gap)).otherwise(F.array(_row(DOC, F.col(size), F.col(item))))


def _open(state: DataFrame, docs: dict[int, int], wanted: int, capacity: int, turn: int) -> DataFrame:
    """Open ``wanted`` sequences with the largest documents; among equal sizes a hash of the id decides."""
    limit, share = 0, 1.0
    for size in sorted(docs, reverse=True):
        if wanted <= docs[size]:
            limit, share = size, wanted / docs[size]
            break
        wanted -= docs[size]
    draw = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1_000_003))
    is_doc = F.col("kind") == DOC
    one = state.filter(is_doc & (F.col("size") == limit)).agg(F.min_by("id", draw)).first()[0]  # at least one
    seed = (F.col("size") > limit) | ((F.col("size") == limit) & ((draw < share * 1_000_003) | F.col("id").eqNullSafe(F.lit(one))))
    return state.select(F.inline(F.when(is_doc, _opened(seed, capacity)).otherwise(F.array(_row(GAP, F.col("size"), F.col("id"))))))


def fitting(docs: dict[int, int], gaps: dict[int, int]) -> int:
    """Tokens of documents that a sweep over all gaps can place at least, from the counts by size."""
    stack: list[list[int]] = []
    volume = 0
    for size in sorted(docs.keys() | gaps.keys()):
        if size in docs:
            stack.append([size, docs[size]])
        count = gaps.get(size, 0)
        while stack and count:
            pops = size // stack[-1][0]
            taken = min(stack[-1][1], pops * count)
            volume += taken * stack[-1][0]
            count -= -(-taken // pops)
            stack[-1][1] -= taken
            if not stack[-1][1]:
                stack.pop()
    return volume


def best_fit(units: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, on_round=None) -> DataFrame:
    """(unit, sequence_id, offset) for units (unit, length) shorter than ``capacity``.

    A sequence is named after its first unit. Units longer than half the
    capacity open sequences at the start, as no two of them share one; more
    are opened, for the largest units, when the gaps fit less than a tenth of the
    rest. What the driver sees of a round are counts by size and by block. When no
    more than ``block_rows`` rows matter, they form one block, which ends the packing.
    """
    state = units.select(F.inline(_opened(F.col("length") * 2 > capacity, capacity, "length", "unit")))
    state, done, rounds = materialize(state), [], 0
    while True:
        done.append(state.filter(F.col("kind") == PLACED))
        counts = state.filter(F.col("kind") != PLACED).groupBy("kind", "size").count().collect()  # at most two per size
        docs = {r["size"]: r["count"] for r in counts if r["kind"] == DOC}
        if not docs:
            break
        rounds += 1
        gaps = {r["size"]: r["count"] for r in counts if r["kind"] == GAP and r["size"] >= min(docs)}
        rows, tokens, fit = sum(docs.values()) + sum(gaps.values()), sum(s * n for s, n in docs.items()), fitting(docs, gaps)
        useful = state.filter((F.col("kind") == DOC) | ((F.col("kind") == GAP) & (F.col("size") >= min(docs))))
        if on_round:
            on_round(rounds, sum(docs.values()), sum(gaps.values()))
        if rows <= block_rows:
            state = materialize(_sweep_blocks(useful, 1, True, capacity))
        elif fit * 10 < tokens:
            state = materialize(_open(useful, docs, -(-(tokens - fit) // capacity), capacity, rounds))
        else:
            swept = materialize(_sweep_blocks(useful, -(-rows // block_rows), False, capacity))
            state = materialize(_match_borders(swept, capacity))
    placed = done[0]
    for part in done[1:]:
        placed = placed.select("kind", "size", "id", "seq").unionByName(part.select("kind", "size", "id", "seq"))
    return placed.select(F.col("id").alias("unit"), F.col("seq").alias("sequence_id"), F.col("size").alias("offset"))


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    block_rows: int = BLOCK_ROWS,
    on_round=None,
) -> DataFrame:
    """Pieces of all rows and their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of the input is packed, repeated ones and those with a null id
    too; a null text counts as empty. A full piece is a sequence of its own. An empty
    table gives no piece.
    """
    pieces = cut_pieces(docs, doc_id, text, capacity, end_id, vocabulary)
    pieces = materialize(pieces.withColumn("unit", F.monotonically_increasing_id()))
    full = F.col("length") == capacity
    places = best_fit(pieces.filter(~full).select("unit", "length"), capacity, block_rows, on_round)
    whole = pieces.filter(full).withColumns({"sequence_id": F.col("unit"), "offset": F.lit(0).cast("bigint")})
    return whole.unionByName(pieces.filter(~full).join(places, "unit")).drop("unit")


@case("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 1024 tokens as best-fit finds."""
    return pack_documents(table(spark, sf_dir, "documents"))
