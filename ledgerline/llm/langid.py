"""Language ID by unigram piece probabilities, summed over all segmentations."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.base import case, filter_rows, map_rows, remainder, table
from ledgerline.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"  # the vocabulary's mark of a word's beginning

SAMPLE_PER_LANGUAGE = 2000  # bound of the labelled rows that fit the model, per language (expected size)
MIN_DOCS = 5  # a language needs so many labelled rows
EVIDENCE_WORDS = 20  # a longer text counts as so many words of its average when scored
CACHE_WORDS = 200_000  # scored tokens a task keeps
PART_LETTERS = 1_000_000  # letters of texts whose words are scored together
WORDS_AT_ONCE = 20_000
COMMON_LETTERS = 64
LONG_WORD = 40  # longer words are summed one by one, with rescaling, and teach in parts
UND = "und"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, int]:
    """Fixed vocabulary: the pieces made of letters (after the word mark), lower-cased, numbered."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    kept = sorted(p for p in pieces if p and all(c.isalpha() for c in p.removeprefix(START)))
    return {p: i for i, p in enumerate(kept)}


def edges_of(word: str, pieces: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(end, start, piece) of every vocabulary piece in the word, by end; single letters outside the vocabulary are piece -1."""
    out = []
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            piece = pieces.get(word[start:end])
            if piece is not None:
                out.append((end, start, piece))
            elif start == end - 1:
                out.append((end, start, -1))
    return out


def forward(edges: list[tuple[int, int, int]], size: int, probability: list[float], longest: int) -> tuple[list[float], float]:
    """Sums over all segmentations of each prefix, up to a common factor e**log_scale of the last ones.

    The sums of the last ``longest`` positions are scaled up whenever they
    become small, so words of any length stay in range.
    """
    total, log_scale = [0.0] * (size + 1), 0.0
    total[0] = 1.0
    at = 0
    for end, start, piece in edges:
        if end != at:
            if at and total[at] < 1e-100:
                for i in range(max(0, at - longest), at + 1):
                    total[i] *= 1e100
                log_scale -= 100 * math.log(10)
            at = end
        total[end] += total[start] * probability[piece]
    return total, log_scale


def log_probability(word: str, pieces: dict[str, int], models: list[list[float]], longest: int) -> list[float]:
    """Log probability of a word under each language, all segmentations summed."""
    marked = START + word
    edges = edges_of(marked, pieces, longest)
    out = []
    for probability in models:
        total, log_scale = forward(edges, len(marked), probability, longest)
        out.append(math.log(max(total[-1], 1e-300)) + log_scale)
    return out


def expected_counts(word: str, pieces: dict[str, int], probability: list[float], longest: int) -> dict[int, float]:
    """Expected number of times each piece is used, over the segmentations of a word (see ``parts_of``)."""
    return _counts_of(START + word, pieces, probability, longest)


def parts_of(word: str) -> list[str]:
    """A word with its mark, a long one in parts of LONG_WORD letters, of which the first carries the mark."""
    parts = [word[i : i + LONG_WORD] for i in range(0, len(word), LONG_WORD)]
    return [START + parts[0], *parts[1:]]


def _counts_of(marked: str, pieces: dict[str, int], probability: list[float], longest: int) -> dict[int, float]:
    size, edges = len(marked), edges_of(marked, pieces, longest)
    total, _ = forward(edges, size, probability, longest)
    back = [0.0] * (size + 1)
    back[size] = 1.0
    for end, start, piece in reversed(edges):
        back[start] += back[end] * probability[piece]
    out: dict[int, float] = {}
    if total[size] > 0:
        for end, start, piece in edges:
            out[piece] = out.get(piece, 0.0) + total[start] * probability[piece] * back[end] / total[size]
    return out


def _probabilities(counts: dict[int, float], n_pieces: int) -> list[float]:
    """Smoothed piece probabilities; the last entry (piece -1) is the floor of unknown letters."""
    alpha = 0.01
    total = sum(counts.values()) + alpha * (n_pieces + 1)
    values = [alpha / total] * (n_pieces + 1)
    for piece, n in counts.items():
        if piece >= 0:
            values[piece] = (n + alpha) / total
    return values


def fit_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", vocabulary: str | None = None,
    sample_per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = 1,
) -> dict:
    """Piece probabilities per language, from a bounded sample of the labelled rows.

    ``sample_per_language`` bounds the expected number of rows of each language.
    Starts from equal probabilities of all pieces, which favours long pieces, then
    ``rounds`` + 1 EM steps over the distinct words, long ones in parts. Rows with a null text or
    language, and languages with fewer than five rows, teach nothing. The driver holds one number per piece and language.
    """
    vocabulary = vocabulary or vocabulary_path()
    pieces = load_pieces(vocabulary)
    longest = max(map(len, pieces))
    rows = docs.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.col(doc_id).alias("_id"))
    rows = rows.filter("_text IS NOT NULL AND _lang IS NOT NULL")
    sizes = rows.groupBy("_lang").count().filter(F.col("count") >= MIN_DOCS)
    sizes = sorted((r["_lang"], r["count"]) for r in sizes.collect())
    languages = [name for name, _ in sizes]
    if not languages:
        return {"languages": [], "models": [], "vocabulary": vocabulary}
    draw = F.pmod(F.xxhash64("_id", "_text"), F.lit(1_000_003)) / 1_000_003
    share = F.create_map(*[F.lit(v) for name, n in sizes for v in (name, sample_per_language / n)])
    sample = rows.filter(draw < share[F.col("_lang")]).select("_text", "_lang")

    def count_words():
        def work(batch):
            counts: dict[str, Counter] = {}
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(name, Counter()).update(p for w in LETTERS.findall(body.lower()) for p in parts_of(w))
            for name, own in counts.items():
                yield {"lang": [name] * len(own), "word": list(own), "n": list(own.values())}

        return work

    words = map_rows(sample, count_words, "lang string, word string, n bigint")
    words = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    models = [[1.0 / len(pieces)] * len(pieces) + [1e-9] for _ in languages]
    for _ in range(rounds + 1):
        current = models

        def expect():
            own = load_pieces(vocabulary)

            def work(batch):
                sums: dict[tuple[str, int], float] = {}
                for name, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                    for piece, x in _counts_of(word, own, current[languages.index(name)], longest).items():
                        sums[name, piece] = sums.get((name, piece), 0.0) + n * x
                yield {"lang": [k[0] for k in sums], "piece": [k[1] for k in sums], "n": list(sums.values())}

            return work

        found = map_rows(words, expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        counts: dict[str, dict[int, float]] = {name: {} for name in languages}
        for r in found.collect():  # at most vocabulary x languages rows
            counts[r.lang][r.piece] = r.n
        models = [_probabilities(counts[name], len(pieces)) for name in languages]
    return {"languages": languages, "models": models, "vocabulary": vocabulary}


class Trie:
    """The vocabulary as a table of steps: node x letter -> node (0: none); 1 is the root."""

    def __init__(self, pieces: dict[str, int]) -> None:
        counts = Counter(c for p in pieces for c in p)
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.letter = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other letter
        self.table = np.zeros(0x2FFF, np.int64)
        for c, i in self.letter.items():
            if ord(c) < len(self.table):
                self.table[ord(c)] = i
        steps, piece = [{}, {}], [-1, -1]
        for text, number in pieces.items():
            node = 1
            for c in text:
                at = steps[node].get(self.letter[c])
                if at is None:
                    at = steps[node][self.letter[c]] = len(steps)
                    steps.append({})
                    piece.append(-1)
                node = at
            piece[node] = number
        parent = [n for n, own in enumerate(steps) for _ in own]
        self.width = len(letters) + 1
        keys = np.array(parent, np.int64) * self.width + np.array([c for own in steps for c in own], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array([t for own in steps for t in own.values()], np.int64)[order]
        self.piece = np.array(piece, np.int64)
        self.common = np.zeros((len(steps), COMMON_LETTERS), np.int32)  # the steps by the usual letters, in full
        for node, own in enumerate(steps):
            for c, target in own.items():
                if c < COMMON_LETTERS:
                    self.common[node, c] = target
        self.first = np.zeros(self.width, np.int64)
        for c, node in steps[1].items():
            self.first[c] = node

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Letter numbers of code points."""
        low = np.minimum(points, len(self.table) - 1)
        out = self.table[low]
        high = points >= len(self.table)
        if high.any():
            out[high] = [self.letter.get(chr(c), 0) for c in points[high]]
        return out

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        usual = letter < COMMON_LETTERS
        target = self.common[node, np.where(usual, letter, 0)]
        if not usual.all():
            key = (node * self.width + letter)[~usual]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            target[~usual] = np.where(self.keys[at] == key, self.targets[at], 0)
        return target.astype(np.int64)


def forward_words(words: list[str], trie: Trie, models: np.ndarray) -> np.ndarray:
    """Log probabilities (word x language), every word's segmentations summed; for words of bounded length.

    The forward sums of all words advance together, one letter at a time. ``models`` is
    (piece + 1) x language, the last row for letters outside the vocabulary.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(sizes) - sizes
    code = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32)
    letters = trie.codes(code)
    within = np.arange(len(code)) - np.repeat(begin, sizes)
    left = np.repeat(sizes, sizes) - within  # letters from here to the end of the word
    start = np.arange(len(code))
    node, length = trie.first[letters], 1
    starts, ends, pieces = [start], [within + 1], [np.where(trie.piece[node] >= 0, trie.piece[node], len(models) - 1)]
    while len(start):
        go = (node > 0) & (left[start] > length)
        start, node = start[go], node[go]
        node = trie.step(node, letters[start + length])
        length += 1
        hit = (node > 0) & (trie.piece[node] >= 0)
        starts.append(start[hit])
        ends.append(within[start[hit]] + length)
        pieces.append(trie.piece[node[hit]])
    start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
    word = np.repeat(np.arange(len(words)), sizes)[start]
    start += word  # every word has one more place, for its end
    target = begin[word] + word + end
    order = np.lexsort((target, end))
    start, target, piece = start[order], target[order], piece[order]
    total = np.zeros((len(code) + len(words), models.shape[1]))
    total[begin + np.arange(len(words))] = 1.0
    bounds = np.cumsum(np.bincount(end, minlength=sizes.max() + 1))
    for low, high in zip(bounds, bounds[1:]):
        if low < high:
            own = target[low:high]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[first]] = np.add.reduceat(total[start[low:high]] * models[piece[low:high]], first)
    return np.log(np.maximum(total[begin + sizes + np.arange(len(words))], 1e-300))


class WordScores:
    """Log probabilities of words, kept from text to text."""

    def __init__(self, pieces: dict[str, int], models: list[list[float]]) -> None:
        self.pieces, self.models, self.longest = pieces, models, max(map(len, pieces))
        self.trie, self.columns = Trie(pieces), np.array(models).T.copy()
        self.rows: dict[str, int] = {}
        self.values = np.zeros((0, len(models)))

    def _learn(self, words: list[str]) -> None:
        own = [w for w in words if len(w) <= LONG_WORD]
        values = [
            forward_words(own[i : i + WORDS_AT_ONCE], self.trie, self.columns) for i in range(0, len(own), WORDS_AT_ONCE)
        ]
        for w in words:
            if len(w) > LONG_WORD:
                own.append(w)
                values.append(np.array([log_probability(w, self.pieces, self.models, self.longest)]))
        self.rows.update(zip(own, range(len(self.values), len(self.values) + len(own))))
        self.values = np.concatenate([self.values, *values])

    def texts(self, bodies: list[str]) -> list[tuple[np.ndarray, int]]:
        """Summed log probabilities and the number of words of each text."""
        split = [LETTERS.findall(body.lower()) for body in bodies]
        found = set().union(*split)
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.values = {}, self.values[:0]
        fresh = [w for w in found if w not in self.rows]
        if fresh:
            self._learn(fresh)
        get = self.rows.__getitem__
        return [(self.values[list(map(get, words))].sum(axis=0), len(words)) if words else (None, 0) for words in split]


def _verdicts(model: dict) -> Callable[[list[str | None]], list[tuple[str, float]]]:
    """The function that names the language of texts, with its own kept words."""
    languages = model["languages"]
    if not languages:
        return lambda bodies: [(UND, 0.0)] * len(bodies)
    scores = WordScores(load_pieces(model["vocabulary"]), model["models"])

    def one(sums: np.ndarray | None, words: int) -> tuple[str, float]:
        if not words:
            return UND, 0.0
        log = sums * min(1.0, EVIDENCE_WORDS / words)
        odds = np.exp(log - log.max())
        best = int(odds.argmax())
        return languages[best], float(odds[best] / odds.sum())

    return lambda bodies: [one(*found) for found in scores.texts([b or "" for b in bodies])]


def predict_language(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row.

    Words are lower-cased runs of letters; pieces do not cross words, so a
    text's probability is the product over its words, and equal words are
    summed over their segmentations once as long as a task keeps them. The score is the posterior
    (equal priors) of the text's average word, counted at most 20 times.
    ``und`` with score 0: a null text, one without letters, or no learned language.
    Repeated rows repeat; an empty table gives no row.
    """

    def score():
        verdicts = _verdicts(model)

        def columns(ids, part):
            values = verdicts(part)
            return {"doc_id": ids, "lang_pred": [v[0] for v in values], "score": [v[1] for v in values]}

        def work(batch):
            ids, part, size = [], [], 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                part.append(body.as_py())
                size += len(part[-1] or "")
                if size > PART_LETTERS:
                    yield columns(ids, part)
                    ids, part, size = [], [], 0
            if ids:
                yield columns(ids, part)

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return map_rows(rows, score, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows whose text is in a learned language with at least that score; all columns."""

    def keeps():
        verdicts = _verdicts(model)
        return lambda bodies: [name != UND and score >= min_score for name, score in verdicts(bodies)]

    return filter_rows(docs, keeps, text)


@case("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; every fifth id is held out from the labels that teach."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
