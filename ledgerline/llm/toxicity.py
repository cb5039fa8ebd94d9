"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text."""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.base import case, map_rows, remainder, table
from ledgerline.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

# Characters drawn like Latin letters, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ß": "ss",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"

SAMPLE_TOXIC, SAMPLE_CLEAN = 5000, 20_000  # bounds of the labelled rows that fit the lexicon (expected sizes)
TEXTS_AT_ONCE = 100  # whose word beginnings a task counts before it passes them on
MIN_DOCS = 5  # toxic documents that must hold an entry
CHANCE = 0.01  # accepted expectation of entries that are toxic by chance
MIN_WEIGHT = 2.0  # log odds of an entry
SHORTEST, LONGEST = 4, 12  # letters of an entry
THRESHOLD = 0.7


class Folding(dict):
    """str.translate table, filled as characters occur: case, accents, wide forms, look-alikes and digits fold to letters."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in INVISIBLE or unicodedata.combining(char):
            out = ""
        elif char in SUBSTITUTES:
            out = SUBSTITUTES[char]
        else:
            base = "".join(c for c in unicodedata.normalize("NFKD", char.lower()) if not unicodedata.combining(c))
            out = "".join(HOMOGLYPHS.get(c, c if c.isalpha() else " ") for c in base)
        self[code] = out
        return out


def fold(text: str, table: Folding) -> str:
    """Folded words, one space before each and one after the last."""
    return f" {' '.join(text.translate(table).split())} "


class Matcher:
    """Aho-Corasick automaton over word beginnings; hits inside an exception phrase do not count."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str] = ()) -> None:
        import ahocorasick

        self.folding, self.automaton = Folding(), ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(f" {entry}", (len(entry) + 1, entry, weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None, 0.0))
        self.empty = not (weights or exceptions)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(start, entry, weight) of the longest entry at each word that no exception phrase covers."""
        if self.empty:
            return []
        found, free = {}, []
        for last, (length, entry, weight) in self.automaton.iter(folded):
            start = last - length + 1
            if entry is None:
                free.append((start, last))
            elif start not in found or len(found[start][0]) < len(entry):
                found[start] = (entry, weight)
        for start, last in free:
            for inside in [s for s in found if start <= s < last]:
                del found[inside]
        return [(s, *found[s]) for s in sorted(found)]

    def features(self, text: str | None) -> tuple[int, float, float]:
        """Hits, log of the weight, log of the weight per 100 words."""
        folded = fold(text or "", self.folding)
        found = self.hits(folded)
        weight = sum(w for _, _, w in found)
        words = max(1, folded.count(" ") - 1)
        return len(found), math.log1p(weight), math.log1p(100 * weight / words)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 0.001) -> np.ndarray:
    """Newton steps for a ridge logistic regression with an intercept, classes weighted equally."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge * beta
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _beginnings(word: str) -> list[str]:
    """Beginnings of a word, and the whole word (ends in a space) if it is no longer than an entry."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]


def choose_entries(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, n_candidates: int) -> dict[str, float]:
    """Entries from (toxic documents, clean documents) per word beginning.

    A beginning must have the weight and the support, and among ``n_candidates`` beginnings such counts must be
    unlikely by chance. One that nearly always goes on in the same way gives way to its continuation, and one
    that a chosen shorter beginning covers is left out.
    """
    share = n_toxic / (n_toxic + n_clean)

    def weight(toxic: int, clean: int) -> float:
        return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))

    def by_chance(toxic: int, clean: int) -> float:
        ways = math.lgamma(toxic + clean + 1) - math.lgamma(toxic + 1) - math.lgamma(clean + 1)
        return ways + toxic * math.log(share) + math.log(n_candidates)

    longer: Counter = Counter()
    for entry, (toxic, _) in counts.items():
        if len(entry) > SHORTEST:
            longer[entry[:-1]] = max(longer[entry[:-1]], toxic)
    chosen: dict[str, float] = {}
    for entry in sorted(counts, key=lambda e: (len(e), e)):
        toxic, clean = counts[entry]
        if toxic < MIN_DOCS or weight(toxic, clean) < MIN_WEIGHT or clean > 0.02 * toxic + 1 or by_chance(toxic, clean) > math.log(CHANCE):
            continue
        if longer[entry] >= 0.95 * toxic or any(entry[:n] in chosen for n in range(SHORTEST, len(entry))):
            continue
        chosen[entry] = weight(toxic, clean)
    return chosen


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """One row (_text, _y) of most near copies: those whose smallest hashed run of five words is equal, fewer words as a whole."""
    rows = sample.withColumn("_words", F.split(F.lower("_text"), "[\\x20\\x09-\\x0D]+"))  # a column, so that it is cut once
    n = F.size("_words")
    runs = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(5)]))
    key = F.when(n >= 5, F.array_min(runs)).otherwise(F.xxhash64("_words"))
    return rows.withColumn("_copies", key).dropDuplicates(["_y", "_copies"]).select("_text", "_y")


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN,
) -> dict:
    """Entries, exception phrases and the logistic curve, from a bounded sample of the labelled rows.

    ``sample_toxic`` and ``sample_clean`` bound the expected number of rows of the classes. Of near copies
    one row counts. Rows with a null id, text or label teach nothing. Without rows of both classes the
    lexicon is empty and every score is the curve's value for no hit (0.02).
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).filter("_y IN (0, 1) AND _id IS NOT NULL").distinct()
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    empty = {"weights": {}, "exceptions": [], "beta": [-4.0, 0.0, 0.0]}
    if len(sizes) < 2:
        return empty
    share = F.when(F.col("_y") == 1, sample_toxic / sizes[1]).otherwise(sample_clean / sizes[0])
    draw = F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) / 1_000_003
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).filter("_text IS NOT NULL")
    drawn = F.broadcast(known.filter(draw < share))  # its size is bounded by the sample's
    sample = rows.join(drawn, "_id").select("_text", F.col("_y").cast("int").alias("_y"))
    sample = materialize(_one_of_copies(sample))

    def count_beginnings():
        folding = Folding()

        def work(batch):
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                yield count(batch.slice(i, TEXTS_AT_ONCE))

        def count(batch):
            toxic, clean = Counter(), Counter()
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if y else clean).update({b for w in set(fold(body, folding).split()) for b in _beginnings(w)})
                (toxic if y else clean)[""] += 1
            keys = list(toxic.keys() | clean.keys())
            return {"entry": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]}

        return work

    summed = materialize(
        map_rows(sample, count_beginnings, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
        )
    )
    kept = summed.filter((F.col("entry") == "") | ((F.col("toxic") >= MIN_DOCS) & (F.col("clean") <= 0.02 * F.col("toxic") + 1)))
    counts = {r.entry: (r.toxic, r.clean) for r in kept.collect()}  # bounded by the sample
    n_toxic, n_clean = counts.pop("", (0, 0))
    if not n_toxic or not n_clean:
        return empty
    weights = choose_entries(counts, n_toxic, n_clean, summed.filter(F.col("toxic") >= MIN_DOCS).count())

    def phrases():
        matcher = Matcher(weights)

        def work(batch):
            toxic, clean = Counter(), Counter()
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(body, matcher.folding)
                own = set()
                for start, _, _ in matcher.hits(folded):
                    before, after = folded[:start].rpartition(" ")[2], folded[start + 1 :].split(" ", 2)
                    own.add(" ".join(after[:2]).strip())
                    own.add(f"{before} {after[0]}".strip())
                (toxic if y else clean).update(own)
            keys = list(toxic.keys() | clean.keys())
            yield {"phrase": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]}

        return work

    found = map_rows(sample, phrases, "phrase string, toxic bigint, clean bigint").groupBy("phrase").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    exceptions = sorted(r.phrase for r in found.filter("clean >= 3 AND toxic = 0 AND phrase LIKE '% %'").collect())

    def measure():
        matcher = Matcher(weights, exceptions)

        def work(batch):
            values = [matcher.features(body)[1:] for body in batch.column(0).to_pylist()]
            yield {"a": [v[0] for v in values], "b": [v[1] for v in values], "y": batch.column(1).to_pylist()}

        return work

    points = map_rows(sample, measure, "a double, b double, y int").collect()  # bounded by the sample
    x = np.array([[p.a, p.b] for p in points])
    return {"weights": weights, "exceptions": exceptions, "beta": _logistic(x, np.array([p.y for p in points])).tolist()}


def score_toxicity(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), n_hits of every row; a null text is scored as an empty one."""

    def score():
        matcher, (bias, total, density) = Matcher(model["weights"], model["exceptions"]), model["beta"]

        def work(batch):
            values = [matcher.features(body) for body in batch.column(1).to_pylist()]
            odds = [bias + total * a + density * b for _, a, b in values]
            yield {
                "doc_id": batch.column(0),
                "score": [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds],
                "n_hits": [v[0] for v in values],
            }

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return map_rows(rows, score, f"doc_id {kind}, score double, n_hits bigint")


@case("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; every third id is held out from the labels that teach."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_lexicon(docs, labels.filter(remainder("doc_id", 3) != 1))
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_hits",
    )
