"""Document fingerprints from Lempel-Ziv phrases: the least hashes of the phrases that a parse finds new."""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.llm.base import case, map_rows, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

MINIMA = 128  # least phrase hashes that make a fingerprint
FACTOR = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 100_000  # phrases hashed at once


class Parse:
    """LZ78 parse of a text that may go on: each phrase is the longest known one and a code point more.

    With a phrase all its beginnings are known, so a phrase is found by its length.
    """

    def __init__(self) -> None:
        self.known: set[str] = set()
        self.pending = ""  # the beginning of the next phrase

    def read(self, text: str) -> list[str]:
        """Parse what comes next; returns the new phrases."""
        known, text, new = self.known, self.pending + text, []
        add, start, size = self.known.add, 0, len(text)
        while start < size:
            end = start + 2
            phrase = text[start:end]
            if phrase in known:
                while phrase in known and end <= size:
                    end += 1
                    phrase = text[start:end]
            elif text[start] not in known:
                end, phrase = start + 1, text[start]
            if end > size:  # a known phrase that may go on
                break
            add(phrase)
            new.append(phrase)
            start = end
        self.pending = text[start:]
        return new

    def try_on(self, text: str) -> list[str]:
        """The new phrases if ``text`` came next; the parse stays where it is."""
        before = self.pending
        new = self.read(text)
        self.known.difference_update(new)
        self.pending = before
        return new


def phrase_hashes(phrases: list[str]) -> np.ndarray:
    """32-bit hashes: of each phrase the sum of its code points times powers of a fixed number, then mixed."""
    parts = [np.zeros(0, np.uint64)]
    for i in range(0, len(phrases), CHUNK):
        own = phrases[i : i + CHUNK]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        starts = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint64(1)
        powers = np.cumprod(np.full(sizes.max(), FACTOR), dtype=np.uint64)
        parts.append(np.add.reduceat(codes * powers[np.arange(len(codes)) - np.repeat(starts, sizes)], starts))
    mixed = np.concatenate(parts)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def minima(phrases: list[str], more: Sequence[int] = ()) -> list[int]:
    """The least distinct 32-bit hashes of phrases, and of ``more`` such hashes, ascending; at most MINIMA."""
    hashes = np.sort(phrase_hashes(phrases))
    hashes = hashes[np.diff(hashes, prepend=hashes[:1] + 1) != 0]  # distinct ones
    return sorted({*hashes[:MINIMA].tolist(), *more})[:MINIMA]


def likeness(a: list[int], b: list[int]) -> float:
    """Share of the least values of both phrase sets together that are in each of them; of two empty sets 1."""
    both = {*a} & {*b}
    either = sorted({*a, *b})[:MINIMA]
    return sum(v in both for v in either) / len(either) if either else 1.0


def as_text(values: list[int]) -> str:
    return np.array(values, ">u4").tobytes().hex()


class _Held:
    """A text whose edit waits for the next text: its fingerprint, and the parse of the part that stays."""

    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 3
        self.parse = Parse()
        self.stays = minima(self.parse.read(text[: self.cut]))
        self.minima = minima(self.parse.try_on(text[self.cut :]), self.stays)

    def row(self, next_text: str, next_minima: list[int]) -> dict:
        tail = next_text[: len(self.text) - self.cut]
        edited = minima(self.parse.try_on(tail), self.stays)
        body = (self.text[: self.cut] + tail).encode("utf-8", "surrogatepass")
        return {
            "doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": hashlib.sha256(body).hexdigest(),
            "fingerprint": as_text(self.minima), "edited_fingerprint": as_text(edited),
            "near_edited": likeness(self.minima, edited), "near_next": likeness(self.minima, next_minima),
        }


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; a null text counts as empty and has an empty fingerprint. Nothing is shuffled."""

    def hash_texts():
        def work(batch):
            yield {"doc_id": batch.column(0), "fingerprint": [as_text(minima(Parse().read(body.as_py() or ""))) for body in batch.column(1)]}

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return map_rows(rows, hash_texts, f"doc_id {kind}, fingerprint string")


def _block(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are not above the value, found in two steps; of a null none."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    every = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    coarse = F.split(F.lit(",".join(map(str, cuts[::step]))), ",").cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda c: c <= value))
    segment = below(coarse) - 1
    found = F.when(segment < 0, F.lit(0)).otherwise(segment * step + below(F.slice(every, segment * step + 1, F.lit(step))))
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """block, is_next, doc_id, text: the texts range-partitioned by descending id, after each block's rows the first row of the next.

    The last block is followed by the first row of all. Equal ids are ordered by text, null ids come last.
    The cuts are approximate quantiles of the ids alone, one number for each block (by default as many as the session's
    shuffle partitions); the texts are read and shuffled once. Rows of one id stay in one block, sorted and
    streamed, so they are never held together.
    """
    blocks = blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(doc_id).cast("bigint").alias("_id"))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = ids.agg(F.percentile_approx("_id", shares, 10 * blocks).alias("c")).first()["c"] if shares else None
    cuts = sorted(set(cuts or []))
    edges = ids.groupBy((F.lit(len(cuts)) - _block(F.col("_id"), cuts)).alias("b")).agg(F.max("_id").alias("first")).collect()
    first = {r["b"]: r["first"] for r in edges}
    order = sorted(first)
    asks = {b: order[i - 1] for i, b in enumerate(order)}  # who comes before; before the first, the last
    told = lambda values: F.split(F.lit(",".join(values)), ",")
    every = range(len(cuts) + 1)
    firsts = told(["" if first.get(b) is None else str(first[b]) for b in every])
    before = told([str(asks.get(b, 0)) for b in every]).cast("array<int>")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("_b", F.lit(len(cuts)) - _block(F.col("doc_id").cast("bigint"), cuts))
    leads = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")) == F.get(firsts, F.col("_b"))
    here = F.struct(F.col("_b").alias("block"), F.lit(False).alias("is_next"))
    there = F.struct(F.get(before, F.col("_b")).alias("block"), F.lit(True).alias("is_next"))
    sent = own.select("doc_id", "text", F.inline(F.when(leads, F.array(here, there)).otherwise(F.array(here))))
    dealt = sent.repartitionById(len(cuts) + 1, F.col("block"))
    ordered = dealt.sortWithinPartitions("block", "is_next", F.desc_nulls_last("doc_id"), F.desc("text"))
    return ordered.select("block", "is_next", "doc_id", "text")


def edit_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """Each row's fingerprint, and how like it is to that of its edited text and of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edit replaces the
    last third of the code points (rounded down) by as many from the beginning of the next document, by
    descending id, or all it has; after the last comes the first, and a single row follows itself. A null text
    counts as empty; an empty text has an empty fingerprint, is like other empty ones and unlike the rest.
    Equal texts have equal fingerprints, whole texts are parsed whatever their length. Equal ids follow each
    other by descending text; repeated rows repeat. An empty table gives no row.
    """

    def compare():
        held: list[_Held] = []

        def work(batch):
            out = []
            for is_next, doc, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if is_next and not held:
                    continue  # the first row after the block has been met
                now = _Held(doc, body.as_py())
                if held:
                    out.append(held.pop().row(now.text, now.minima))
                if not is_next:
                    held.append(now)
            if out:
                yield {name: [row[name] for row in out] for name in out[0]}

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(with_next(docs, doc_id, text, blocks), compare, schema)


@case("op12_lz_fingerprints")
def op12_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness."""
    return edit_fingerprints(table(spark, sf_dir, "documents"))
