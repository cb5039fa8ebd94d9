"""String similarity for linking names.

``indel`` is the normalised insert/delete ratio (twice the longest common
subsequence over the summed lengths), ``difflib`` the matching-block ratio of
Python's standard library. Both are 0..1 here; pairs reach the Python side in
Arrow batches and only after the equi-joins and the native bounds have
removed everything that cannot match. A batch is scored as a whole (``lanes``).
"""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from ledgerline.functions.lanes import difflib_ratios, indel_ratios

# Executors get these functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METHODS = ("indel", "difflib")
_KINDS, _RUN = 32, 2  # of a signature: so many kinds of characters, of each up to so many
_SLACK = 1e-9  # keeps the whole-number edit bound on the lossless side


def indel_ratio(a: str, b: str) -> float:
    """1 - (inserted + deleted characters) / summed length, by bit-parallel subsequence length."""
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    where: dict[str, int] = {}
    for position, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << position)
    full = (1 << len(a)) - 1
    unmatched = full
    for char in b:
        hit = unmatched & where.get(char, 0)
        unmatched = ((unmatched + hit) | (unmatched - hit)) & full
    common = len(a) - unmatched.bit_count()
    return 1.0 - (total - 2 * common) / total


def difflib_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def ratio_function(method: str):
    if method not in METHODS:
        raise ValueError(f"similarity method must be one of {METHODS}")
    return indel_ratio if method == "indel" else difflib_ratio


def _once(udf):
    """Keep the optimizer from moving or repeating the call: it stays after the steps that thin out the pairs."""
    return udf.asNondeterministic()


def similarity(a: Column | str, b: Column | str, method: str = "indel") -> Column:
    """Similarity of two text columns, 0..1."""
    ratio_function(method)  # an unknown method is an error here
    ratios = indel_ratios if method == "indel" else difflib_ratios

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        known = (left.notna() & right.notna()).to_numpy()
        out = np.full(len(left), np.nan)
        out[known] = ratios(left[known].tolist(), right[known].tolist())
        return pd.Series(out)

    return _once(score)(a, b)


def best_similarity(name: Column | str, labels: Column | str, method: str = "indel") -> Column:
    """the highest similarity between a text and an array of texts; 0 of an empty array, null if either is null."""
    ratio_function(method)
    ratios = indel_ratios if method == "indel" else difflib_ratios

    @F.pandas_udf("double")
    def score(names: pd.Series, arrays: pd.Series) -> pd.Series:
        known = np.flatnonzero((names.notna() & arrays.notna()).to_numpy())
        out = np.full(len(names), np.nan)
        out[known] = 0.0
        own = [arrays.iloc[i] for i in known]
        sizes = np.array([len(a) for a in own], np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            left = [n for i in some for n in [names.iloc[known[i]]] * sizes[i]]
            scores = ratios(left, [t for i in some for t in own[i]])
            out[known[some]] = np.maximum.reduceat(scores, np.cumsum(sizes[some]) - sizes[some])
        return pd.Series(out)

    return _once(score)(name, labels)


def char_signature(name: Column | str) -> Column:
    """64 bits that stand for the characters of a text: 32 kinds (the letters a to z apart), of each a run of up to two ones."""
    name = F.col(name) if isinstance(name, str) else name
    kinds = F.transform(
        F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(name))).otherwise(F.array().cast("array<int>")),
        lambda i: (F.pmod(F.ascii(F.substring(name, i, 1)), F.lit(_KINDS)) * _RUN).cast("int"),
    )

    def one_more(bits: Column, at: Column) -> Column:
        full = F.lit((1 << _RUN) - 1).cast("bigint")
        run = F.call_function("shiftrightunsigned", bits, at).bitwiseAND(full)
        grown = (run * 2 + 1).bitwiseAND(full)
        return bits.bitwiseOR(F.call_function("shiftleft", grown, at))

    return F.aggregate(kinds, F.lit(0).cast("bigint"), one_more)


def common_at_most(bits_a: Column, length_a: Column, bits_b: Column, length_b: Column) -> Column:
    """Native bound: no more characters than these can be common to two texts of these signatures, in whatever order."""
    beyond = F.least(length_a - F.bit_count(bits_a), length_b - F.bit_count(bits_b))  # characters that the runs do not show
    return F.bit_count(bits_a.bitwiseAND(bits_b)) + beyond


def ratio_at_most(bits_a: Column, length_a: Column, bits_b: Column, length_b: Column) -> Column:
    """Native bound of both similarities, 0..1, from signatures and lengths."""
    total = length_a + length_b
    common = F.least(common_at_most(bits_a, length_a, bits_b, length_b), length_a, length_b)
    return F.when(total > 0, common * 2.0 / total + _SLACK).otherwise(F.lit(1.0))


def edit_budget(length_a: Column, length_b: Column, threshold: float) -> Column:
    """Most inserted plus deleted characters a pair may need and still reach the threshold."""
    return F.floor((length_a + length_b) * (1.0 - threshold) + _SLACK).cast("int")


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Native, lossless bound: an edit distance above the budget cannot reach the threshold."""
    budget = edit_budget(F.length(a), F.length(b), threshold)
    return F.call_function("levenshtein", a, b, budget) >= 0  # stops early; -1 above the budget
