"""Batch similarity against the scalar forms, and the native bounds against both."""

import random

import pytest
from ledgerline.functions import lanes
from ledgerline.functions.similarity import char_signature, difflib_ratio, indel_ratio, ratio_at_most, similarity
from ledgerline.operators import lookup
from pyspark.sql import functions as F

ALPHABETS = ["ab", "abcdefgh -", "aé日本\U0001f600z", "ACGT", "".join(map(chr, range(0x400, 0x460)))]


def word(rng, alphabet, low, high):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))


def pairs(seed, low, high, n):
    rng = random.Random(seed)
    left = [word(rng, rng.choice(ALPHABETS), low, high) for _ in range(n)]
    alphabet = rng.choice(ALPHABETS)
    right = [word(rng, alphabet, low, high) if rng.random() < 0.4 else x[: rng.randint(0, len(x))] + word(rng, alphabet, 0, 4) + x[len(x) // 2 :] for x in left]
    return left, right


@pytest.mark.parametrize("low, high, n", [(0, 9, 1500), (0, 40, 800), (60, 70, 200), (100, 400, 60), (500, 600, 4)])
def test_lanes_equal_the_scalar_forms(low, high, n):
    left, right = pairs(high, low, high, n)
    assert lanes.indel_ratios(left, right).tolist() == [indel_ratio(a, b) for a, b in zip(left, right)]
    assert lanes.difflib_ratios(left, right).tolist() == [difflib_ratio(a, b) for a, b in zip(left, right)]


def test_lanes_of_nothing_and_of_parts(monkeypatch):
    assert lanes.indel_ratios([], []).tolist() == lanes.difflib_ratios([], []).tolist() == []
    assert lanes.indel_ratios(["", "", "a"], ["", "x", "a"]).tolist() == [1.0, 0.0, 1.0]
    left, right = pairs(3, 0, 90, 300)
    want = lanes.indel_ratios(left, right).tolist(), lanes.difflib_ratios(left, right).tolist()
    monkeypatch.setattr(lanes, "CELLS", 500)  # a few pairs at a time
    assert (lanes.indel_ratios(left, right).tolist(), lanes.difflib_ratios(left, right).tolist()) == want


@pytest.mark.parametrize("method, scalar", [("indel", indel_ratio), ("difflib", difflib_ratio)])
def test_similarity_and_its_bound(spark, method, scalar):
    left, right = pairs(8, 0, 30, 700)
    rows = list(zip(left, right)) + [(None, "a"), ("a", None), (None, None), ("", ""), ("x" * 300, "x" * 150 + "y" * 150)]
    df = spark.createDataFrame(rows, "a string, b string")
    bound = ratio_at_most(char_signature("a"), F.length("a"), char_signature("b"), F.length("b"))
    got = df.select("a", "b", similarity("a", "b", method).alias("s"), bound.alias("most")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.s is None
        else:
            assert r.s == scalar(r.a, r.b) and r.most >= r.s
    apart = [r for r in got if r.a and r.b and r.s < 0.3]
    assert sum(r.most < 0.7 for r in apart) > 0.5 * len(apart)  # it says something


def test_top_candidates_score_few(spark, monkeypatch):
    """The first three of every group equal those of scoring everything; many candidates are never scored."""
    rng = random.Random(4)
    labels = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 14))) for _ in range(300)]
    of_rank = {i: [x] if i % 9 else [x, x[::-1]] for i, x in enumerate(labels)} | {300: []}
    offered = [(f"p{page}", rank, own) for page in range(3) for rank, own in of_rank.items() if rank % 3 == page or rank == 300]
    names = [x[:-1] + "q" for x in labels[:20]] + ["zzzz", labels[5]]
    groups = [(f"p{i % 3}", n, n.upper()) for i, n in enumerate(names)] + [("p9", "on no page of the truth", "x")]
    candidates = spark.createDataFrame(offered, "page string, rank int, _labels array<string>")
    wanted = spark.createDataFrame(groups, "page string, parish_norm string, llm_parish string")
    for split in (2000, 3):
        monkeypatch.setattr(lookup, "SPLIT_NAMES", split)
        found = {}
        for r in lookup.top_candidates(wanted, candidates, "indel").collect():
            found.setdefault((r.page, r.parish_norm, r.llm_parish), {})[r._rn] = (r.rank, r.score)
        want = {}
        for g in groups[:-1]:
            own = [(-max([indel_ratio(g[1], x) * 100 for x in texts], default=0.0), rank) for p, rank, texts in offered if p == g[0]]
            want[g] = {i + 1: (rank, -score) for i, (score, rank) in enumerate(sorted(own)[:3])}
        assert found == want
    counts = lookup.bounded_scores(wanted, candidates, "indel").agg(F.count("*").alias("n"), F.count("score").alias("scored")).first()
    assert counts.n == sum(sum(p == g[0] for p, *_ in offered) for g in groups) and counts.scored < 0.5 * counts.n
