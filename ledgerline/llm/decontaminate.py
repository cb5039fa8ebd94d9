"""Benchmark items inside documents: MinHash containment search by item size, verified on exact shingles."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.base import WORD_SEPARATORS, case, filter_rows, map_rows, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

SHINGLE = 5
CONTAINMENT = 0.8
PERMUTATIONS = 64
ITEMS_PER_BLOCK = 20_000  # items searched for in one pass over the documents
CHUNK = 1 << 18  # bytes hashed at once
BITS = 22  # of the first look-up
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _tables(seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd number and of its inverse modulo 2**64."""
    values = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    powers, inverses = np.full(CHUNK, _STEP, np.uint64), np.full(CHUNK, inverse, np.uint64)
    powers[0] = inverses[0] = 1
    return values, np.cumprod(powers, dtype=np.uint64), np.cumprod(inverses, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of the words of a text: sums of byte values times powers, from running totals, then mixed."""

    def __init__(self) -> None:
        self.values, self.powers, self.inverses = _tables()
        self.separator = np.zeros(256, bool)
        self.separator[list(WORD_SEPARATORS.encode())] = True

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        gap = self.separator[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))  # starts and ends of words in turn
        starts, ends = edge[::2], edge[1::2]
        out, done = np.empty(len(starts), np.uint64), 0
        while done < len(starts):  # a very long text in parts
            first = int(starts[done])
            upto = max(done + 1, int(np.searchsorted(ends, first + CHUNK, "right")))
            part = data[first : int(ends[upto - 1])]
            s, e = starts[done:upto] - first, ends[done:upto] - first
            if len(part) > CHUNK:  # one word longer than a part
                total = np.zeros(1, np.uint64)
                for i in range(0, len(part), CHUNK):
                    piece = part[i : i + CHUNK]
                    total = total * self.powers[7] + (self.values[piece] * self.powers[: len(piece)]).sum(dtype=np.uint64)
                out[done] = total[0]
            else:
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(self.values[part] * self.powers[: len(part)], out=sums[1:])
                out[done:upto] = (sums[e] - sums[s]) * self.inverses[s]
            done = upto
        out ^= out >> np.uint64(32)
        return out * np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles in order; a text with fewer words is one shingle, one without words has none."""
    return _rolled(hashes(text or ""), size)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(len(h), size)))
    for i in range(min(size, len(h))):
        out *= _STEP
        out += h[i : i + n]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def minima(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """The smallest shingle under each of the hash orders, as its hash in that order."""
    masks = np.arange(1, permutations + 1, dtype=np.uint64) * _STEP
    x = (shingles[None, :] ^ masks[:, None]) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1)


@dataclass
class Items:
    """Sorted signatures of one block of items, by size class, and their exact shingles."""

    ids: list
    shingles: list[np.ndarray]  # distinct, sorted
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # width -> (key, permutation, item), sorted by key
    all_shingles: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # words of an item with fewer than a shingle -> (hash, item), sorted by hash


def index_items(rows: list[tuple], permutations: int = PERMUTATIONS) -> Items:
    """Signatures of items; the class of an item is the next power of two of its shingle count.

    An item of fewer words than a shingle is one shingle of its own width, looked up among the runs of as many words.
    """
    hashes = WordHashes()
    ids, shingles, by_class, by_words = [], [], {}, {}
    for item_id, text in rows:
        words = hashes(text or "")
        own = np.unique(_rolled(words, SHINGLE))
        if not len(own):
            continue
        if len(words) < SHINGLE:
            by_words.setdefault(len(words), []).append((own[0], len(ids)))
        else:
            by_class.setdefault(1 << int(len(own) - 1).bit_length(), []).append(len(ids))
        ids.append(item_id)
        shingles.append(own)
    short = {}
    for n, members in by_words.items():
        keys, item = np.array([m[0] for m in members], np.uint64), np.array([m[1] for m in members])
        order = np.argsort(keys, kind="stable")
        short[n] = keys[order], item[order]
    classes = {}
    for width, members in by_class.items():
        keys = np.concatenate([minima(shingles[m], permutations) for m in members])
        which = np.tile(np.arange(permutations), len(members))
        item = np.repeat(np.array(members), permutations)
        order = np.argsort(keys, kind="stable")
        classes[width] = keys[order], which[order], item[order]
    long = [shingles[m] for members in by_class.values() for m in members]
    every = np.unique(np.concatenate(long)) if long else np.zeros(0, np.uint64)
    return Items(ids, shingles, classes, every, short)


def _held(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


class Searcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: Items, containment: float, permutations: int) -> None:
        self.items, self.containment, self.permutations = items, containment, permutations
        self.hashes = WordHashes()
        self.bits = np.zeros(1 << BITS, bool)  # leading bits of the items' shingles, a cheap first look
        self.bits[(items.all_shingles >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items that share a minimum with a window of their size class.

        Windows are 2 x width shingles wide and start every width shingles, so
        an unbroken item lies whole in one. A window without any shingle of
        any item cannot share a minimum, so its signature is not computed.
        """
        near = np.flatnonzero(self.bits[(h >> np.uint64(64 - BITS)).view(np.int64)])
        if len(near):  # then there are items of whole shingles
            near = near[_held(h[near], self.items.all_shingles)]
        found: set[int] = set()
        if not len(near):
            return found
        for width, (keys, which, item) in self.items.classes.items():
            block = near // width
            for w in np.unique(np.concatenate([block, block - 1])):
                window = h[max(0, w * width) : (w + 2) * width]
                own = minima(window, self.permutations)
                low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                for k in np.flatnonzero(high > low):
                    hit = slice(low[k], high[k])
                    found.update(item[hit][which[hit] == k].tolist())
        return found

    def _short(self, words: np.ndarray) -> list[tuple[int, float]]:
        """Items of fewer words than a shingle that stand in the text, word by word."""
        out = []
        for n, (keys, item) in self.items.short.items():
            if len(words) >= n:
                runs = np.unique(_rolled(words, n))
                low, high = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
                out += [(int(i), 1.0) for k in np.flatnonzero(high > low) for i in item[low[k] : high[k]]]
        return out

    def matches(self, text: str | None) -> list[tuple[int, float]]:
        """(item number, exact containment) of every item held by the text."""
        words = self.hashes(text or "")
        out = self._short(words)
        if len(words) < SHINGLE:
            return out
        h = _rolled(words, SHINGLE)
        found, own = self.candidates(h), None
        for i in sorted(found):
            own = np.unique(h) if own is None else own
            item = self.items.shingles[i]
            share = float(_held(item, own).mean())
            if share >= self.containment:
                out.append((i, share))
        return out


def find_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    containment: float = CONTAINMENT,
    permutations: int = PERMUTATIONS,
    block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles) of every item with that share of its shingles in a document.

    Words are runs without white space, in lower case; shingles have five words.
    Items are searched for in blocks of ``block`` (ordered by id), one pass over the
    documents each, so what a task holds is bounded; documents are never shuffled. An item of fewer
    words is one shingle, held by a text with these words one after the other (containment 1).
    Items or texts that are null or have no word match nothing; a repeated document or item repeats
    its matches, and equal items are searched once. A null id is reported as null.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    asked = items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_text")).filter("_text IS NOT NULL")
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, containment double, n_shingles bigint"
    out = None
    for part in _blocks(asked, block):

        def search(part=part):
            index = index_items([((item, times), body) for item, body, times in part], permutations)
            searcher = Searcher(index, containment, permutations)

            def work(batch):
                found = [
                    (doc, index.ids[i][0], share, len(index.shingles[i]))
                    for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for i, share in searcher.matches(body)
                    for _ in range(index.ids[i][1])
                ]
                if found:
                    yield dict(zip(("doc_id", "item_id", "containment", "n_shingles"), zip(*found)))

            return work

        one = map_rows(rows, search, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    containment: float = CONTAINMENT,
    permutations: int = PERMUTATIONS,
    block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """The rows, all columns, that hold no item (see ``find_items``)."""
    asked = items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_text")).filter("_text IS NOT NULL")
    for part in _blocks(asked, block):

        def keeps(part=part):
            searcher = Searcher(index_items([(item, body) for item, body, _ in part], permutations), containment, permutations)
            return lambda bodies: [not searcher.matches(body) for body in bodies]

        docs = filter_rows(docs, keeps, text)
    return docs


def _blocks(items: DataFrame, size: int):
    """The distinct items (id, text, times) in blocks of a bounded size."""
    items = items.groupBy("_item", "_text").agg(F.count("*").alias("_times"))
    count = items.count()
    if count <= size:
        if count:
            yield [tuple(r) for r in items.collect()]
        return
    n = -(-count // size) * 2  # hashed blocks: half full on average, so that they stay below the size
    numbered = items.withColumn("_block", F.pmod(F.xxhash64("_item", "_text"), F.lit(n)))
    for i in range(n):
        rows = [(r["_item"], r["_text"], r["_times"]) for r in numbered.filter(F.col("_block") == i).collect()]
        if rows:
            yield rows


OP10_SQL = rf"""
WITH doc_words AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
item_words AS (
  SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
widths AS (SELECT DISTINCT least(len(ws), {SHINGLE}) AS w FROM item_words WHERE len(ws) > 0),
doc_shingles AS (
  SELECT DISTINCT id AS doc_id, w, array_to_string(ws[i:i + w - 1], ' ') AS s
  FROM (SELECT id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM doc_words, widths WHERE len(ws) >= w)),
item_shingles AS (
  SELECT DISTINCT id AS item_id, w, array_to_string(ws[i:i + w - 1], ' ') AS s
  FROM (SELECT id, ws, least(len(ws), {SHINGLE}) AS w, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM item_words WHERE len(ws) > 0)),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS c FROM doc_shingles JOIN item_shingles USING (w, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, c / n AS containment, n AS n_shingles FROM shared JOIN sizes USING (item_id) WHERE c / n >= {CONTAINMENT}
"""


@case("op10_decontamination", OP10_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
