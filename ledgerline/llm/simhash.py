"""SimHash near-duplicates: a self-join of binary tries under a Hamming error budget."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.llm.base import case, map_rows, table
from ledgerline.llm.copies import near_copies
from ledgerline.operators.components import connected_components
from ledgerline.operators.skew import attach
from ledgerline.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

SHINGLE = 4
BUDGET = 4  # bits in which linked fingerprints may differ
SEED = 42
BITS = 64
RUN_ROWS = 500_000  # a task joins tries of at least so many fingerprints at once; a subtree of more is dealt to several tasks
CHUNK = 100_000  # node pairs that advance together


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash (signed) of the word shingles, repeats included; 0 for a text without a word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six separators only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, 50_000):  # a very long text in parts
        firsts = starts[i : min(i + 50_000, n)].tolist()
        lasts = ends[min(size, len(words)) - 1 :][i : i + len(firsts)].tolist()
        digests = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in zip(firsts, lasts)])
        votes += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row."""

    def hash_texts():
        def work(batch):
            yield {"doc_id": batch.column(0), "fp": [fingerprint(body.as_py(), size) for body in batch.column(1)]}

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return map_rows(rows, hash_texts, f"doc_id {kind}, fp bigint")


def _rotated(fp: Column, by: int) -> Column:
    """Bits turned left, so that the block from bit ``by`` leads."""
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the classes of u and v; ``label`` holds each item's root."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _split(x: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First index in each [low, high) whose given bit (0 leads) is set; the intervals are sorted."""
    low, high = low.copy(), high.copy()
    shift = (BITS - 1 - bit).astype(np.uint64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        is_set = (x[np.minimum(middle, len(x) - 1)] >> shift) & np.uint64(1) == 1
        low = np.where(open_ & ~is_set, middle + 1, low)
        high = np.where(open_ & is_set, middle, high)
    return low


def _depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits that two numbers share."""
    x = a ^ b
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return BITS - np.bitwise_count(x).astype(np.int64)


def trie_classes(x: np.ndarray, starts: np.ndarray, budget: int, middles: np.ndarray | None = None) -> np.ndarray:
    """Class (an index) of every number of the sorted, distinct runs of ``x``; runs begin at ``starts``.

    A run with a middle (above its start) is two sorted runs, of which only the pairs between them are compared.

    Each run is a binary trie with its single-child paths left out: a node is an interval
    whose numbers share ``_depth`` leading bits. Pairs of nodes go down together, from
    (root, root) of each run. A pair is dropped when its shared prefixes already differ
    in more bits than the budget, or when all numbers below both nodes are of
    one class. It links when even the bits not yet compared fit the budget.
    """
    label = np.arange(len(x))
    stops = np.append(starts[1:], len(x))
    middles = starts if middles is None else middles
    two = middles > starts
    roots = np.stack([starts, np.where(two, middles, stops), middles, stops])[:, (stops - starts > 1) & (middles < stops)]
    stack = [roots[:, i : i + CHUNK] for i in range(0, roots.shape[1], CHUNK)]
    changes = np.arange(len(x))
    while stack:
        al, ah, bl, bh = stack.pop()
        one = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (label[al] == label[bl])
        al, ah, bl, bh = (p[~(one & (ah > al))] for p in (al, ah, bl, bh))
        if not len(al):
            continue
        own = (al == bl) & (ah == bh)
        da, db = _depth(x[al], x[ah - 1]), _depth(x[bl], x[bh - 1])
        shared = np.minimum(da, db)
        mask = np.where(shared == 0, np.uint64(0), ~np.uint64(0) << np.minimum(BITS - shared, 63).astype(np.uint64))
        errors = np.bitwise_count((x[al] ^ x[bl]) & mask).astype(np.int64)
        alive = errors <= budget
        linked = alive & ~own & (errors + BITS - shared <= budget)
        if linked.any():
            _unite(label, al[linked], bl[linked])
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        go = alive & ~linked & ((ah - al > 1) | (bh - bl > 1))
        al, ah, bl, bh, own, da, db = (p[go] for p in (al, ah, bl, bh, own, da, db))
        if not len(al):
            continue
        parts = []
        twin = np.flatnonzero(own)
        if len(twin):
            l, h = al[twin], ah[twin]
            m = _split(x, l, h, da[twin])
            parts += [(l, m, m, h), (l, m, l, m), (m, h, m, h)]  # the last are looked at first
        left = np.flatnonzero(~own & (da <= db))
        if len(left):
            l, h = al[left], ah[left]
            m = _split(x, l, h, da[left])
            parts += [(l, m, bl[left], bh[left]), (m, h, bl[left], bh[left])]
        right = np.flatnonzero(~own & (da > db))
        if len(right):
            l, h = bl[right], bh[right]
            m = _split(x, l, h, db[right])
            parts += [(al[right], ah[right], l, m), (al[right], ah[right], m, h)]
        grown = np.concatenate([np.stack(p) for p in parts], axis=1)
        single = (grown[0] == grown[2]) & (grown[1] - grown[0] == 1)
        grown = grown[:, ~single & (grown[1] > grown[0]) & (grown[3] > grown[2])]
        stack += [grown[:, i : i + CHUNK] for i in range(0, grown.shape[1], CHUNK)]
    return label


def linked_fingerprints(prints: DataFrame, fp: str = "fp", budget: int = BUDGET, run_rows: int = RUN_ROWS) -> DataFrame:
    """(a, b) between distinct fingerprints that connect all those within the budget of each other.

    The 64 bits are cut into budget + 1 blocks. Two linked fingerprints agree in
    one block at least, so in the trie whose bits start with that block they lie
    below the same node at its depth. Each such subtree is joined with itself by one task,
    which returns a star for each class it finds: no more links than fingerprints. A subtree of more than
    ``run_rows`` fingerprints is dealt into parts by hash; each part is joined with itself and each pair of parts with each
    other by tasks of their own.
    """
    cuts = [round(i * BITS / (budget + 1)) for i in range(budget + 2)]
    turns = F.array(
        *[
            F.struct(
                F.lit(i).alias("turn"),
                F.shiftrightunsigned(_rotated(F.col(fp), cuts[i]), BITS - (cuts[i + 1] - cuts[i])).alias("lead"),
                _rotated(F.col(fp), cuts[i]).alias("bits"),
            )
            for i in range(budget + 1)
        ]
    )
    turned = prints.select(F.inline(turns))
    hot = turned.groupBy("turn", "lead").agg(F.ceil(F.count("*") / run_rows).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    own = turned.join(materialize(hot), ["turn", "lead"], "left").withColumn("_own", F.pmod(F.xxhash64("bits"), parts).cast("int"))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    # of the two parts i < j of a pair, j comes second; the sign bit is turned, so that signed order is the order of the bits
    dealt = own.select(
        "turn", "lead", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"), F.col("bits").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")).alias("bits"),
    )
    keys = ["turn", "lead", "i", "j"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "side", "bits")

    def new_runs(rows: np.ndarray) -> np.ndarray:
        return np.flatnonzero((np.diff(rows[:4], axis=1) != 0).any(axis=0)) + 1

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(parts: list[np.ndarray]):
            rows = np.concatenate(parts, axis=1)
            starts = np.concatenate([[0], new_runs(rows)])
            firsts = np.add.reduceat((rows[4] == 0).astype(np.int64), starts)  # of the first of two parts
            x = rows[5].view(np.uint64) ^ np.uint64(1 << 63)
            label = trie_classes(x, starts, budget, np.where(rows[2][starts] < rows[3][starts], starts + firsts, starts))
            at = np.flatnonzero(label != np.arange(len(x)))
            by = np.array(cuts, np.uint64)[rows[0][at]]
            back = lambda v: np.where(by == 0, v, (v >> by) | (v << (np.uint64(BITS) - np.maximum(by, np.uint64(1))))).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(back(x[at])), pa.array(back(x[label[at]]))], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            part = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not part.shape[1]:
                continue
            held.append(part)
            rows += part.shape[1]
            if rows >= RUN_ROWS:  # all but the last run, which may go on
                every = np.concatenate(held, axis=1)
                ends = new_runs(every)
                if len(ends):
                    yield stars([every[:, : ends[-1]]])
                    every = every[:, ends[-1] :]
                held, rows = [every], every.shape[1]
        if rows:
            yield stars(held)

    return dealt.mapInArrow(join, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, budget: int = BUDGET
) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest id reachable over links of ``budget`` bits.

    Equal fingerprints meet once and never as pairs. A text that is null or has no
    word has fingerprint 0 and links like any other; a text with fewer words than a
    shingle is one shingle. Rows with a null id belong to their component but
    do not name it; the component of such rows alone is null. Repeated rows repeat.
    """
    own = materialize(fingerprints(docs, doc_id, text, size))
    prints = own.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    classes = connected_components(linked_fingerprints(prints, budget=budget)).withColumnRenamed("node", "fp")
    member = prints.join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("_least").alias("component_id"))
    of_print = materialize(member.join(least, "component").select("fp", "component_id"))
    return attach(own, of_print, ["fp"], F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies (``copies``, not the fingerprints): the row whose id names the component.

    Rows are judged by id and text: of rows of one id in one group one stays, different texts under one id
    are in groups of their own. Rows with a null id stay, as no id can stand for them.
    """
    found = near_copies(docs, doc_id, text)
    others = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_of")).distinct()
    kept = docs.join(others, (F.col(doc_id) == F.col("_gone")) & (F.xxhash64(text) == F.col("_of")), "left_anti")
    repeated = found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
    if repeated.isEmpty():  # then no id needs its rows compared
        return kept
    again = F.col(doc_id) == F.col("_again")
    groups = found.filter("doc_id = component_id").join(repeated, F.col("doc_id") == F.col("_again"))
    groups = groups.select("_again", F.col("text_hash").alias("_of"), F.col("component").alias("_group")).distinct()
    one = kept.join(groups, again & (F.xxhash64(text) == F.col("_of"))).groupBy("_again", "_group").agg(
        F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(text)).alias("_row")
    )
    return kept.join(repeated, again, "left_anti").unionByName(one.select("_row.*"))


@case("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
