import itertools
import random

import pytest

from ledgerline.functions.similarity import difflib_ratio, indel_ratio
from ledgerline.operators import components as components_module
from ledgerline.operators.components import connected_components
from ledgerline.operators.entities import add_canonical, components
from ledgerline.operators.simjoin import _keys, best_match, closest_to, rarest_tokens, similar_pairs
from pyspark.sql import functions as F


def squash(s):
    return s.upper().translate(str.maketrans("", "", "- ."))


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("DRUMCOR", "DRUMCON", 0.857), ("TULLYVIONGAN UPPER", "TULLYVIONGAN LOWER", 0.824), ("GRANGE, WEST", "GRANGE, EAST", 0.909),
        ("BURNCHURCH", "BURNCHURCH UPPER", 0.8), ("KILCUMMER UP.", "KILCUMMER LR.", 0.818), ("TIRNAHINCH NEAR", "TIRNAHINCH FAR", 0.889),
        ("KNOCKDUFF, UPPER", "KNOCKDUFF, LOWER", 0.8), ("CLONMEEN, SOUTH", "CLONMEEN, NORTH", 0.857),
    ],
)
def test_known_similarities(a, b, want):
    assert round(difflib_ratio(squash(a), squash(b)), 3) == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def names(seed, n=120, letters="abc"):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
        out.add("".join(base))
        for _ in range(rng.randint(0, 3)):
            base.insert(rng.randint(0, len(base)), rng.choice(letters))
        out.add("".join(base))
    return sorted(out)


def test_indel_equals_subsequence_length():
    for a, b in itertools.combinations(names(2, 60) + [""], 2):
        assert indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)))
    assert indel_ratio("", "") == 1.0


@pytest.mark.parametrize("threshold, method", [(0.9, "indel"), (0.77, "indel"), (60, "indel"), (0.77, "difflib")])
def test_similar_pairs_lose_nothing(spark, threshold, method):
    ratio = indel_ratio if method == "indel" else difflib_ratio
    limit = threshold / 100 if threshold > 1 else threshold
    rows = [("hot" if i % 3 else "cold", n) for i, n in enumerate(names(7))]
    got = similar_pairs(spark.createDataFrame(rows, "b string, n string"), ["b"], "n", threshold, method).collect()
    want = {
        (x[0], *sorted((x[1], y[1]))) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and ratio(*sorted((x[1], y[1]))) * 100 >= limit * 100
    }
    assert {(r.b, r.name_a, r.name_b) for r in got} == want
    assert len(got) == len(want)


def long_names(seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(12):
        base = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(8, 80)))
        for edits in range(0, 40, 4):
            name = list(base)
            for _ in range(min(edits, len(base) // 2)):
                at = rng.randrange(len(name))
                if rng.random() < 0.5:
                    del name[at]
                else:
                    name.insert(at, rng.choice("xyz"))
            out.add("".join(name))
    return sorted(n for n in out if n)


@pytest.mark.parametrize("threshold", [0.6, 0.77, 0.9])
def test_long_names_lose_nothing_and_keys_are_linear(spark, threshold):
    rows = long_names(9)
    df = spark.createDataFrame([("b", n) for n in rows], "b string, name string")
    got = {(r.name_a, r.name_b) for r in similar_pairs(df, ["b"], "name", threshold).collect()}
    assert got == {p for p in itertools.combinations(rows, 2) if indel_ratio(*p) * 100 >= threshold * 100} and got
    tokens = rarest_tokens(df, ["b"], threshold)
    for short_side in (True, False):
        keys = _keys(tokens, ["b"], threshold, short_side, "n").groupBy("n").count().collect()
        assert max(r["count"] / len(r.n) for r in keys) < 4


@pytest.mark.parametrize("threshold", [0.3, 0.55, 1.0])
def test_similar_pairs_at_other_thresholds(spark, threshold):
    rows = names(11, 60)
    got = similar_pairs(spark.createDataFrame([("b", n) for n in rows], "b string, n string"), ["b"], "n", threshold).collect()
    assert {(r.name_a, r.name_b) for r in got} == {p for p in itertools.combinations(rows, 2) if indel_ratio(*p) * 100 >= threshold * 100}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [("b%d" % (i % 2), f"n{rng.randint(0, 80):02d}", f"n{rng.randint(0, 80):02d}") for i in range(70)]
    edges += [("b0", f"z{i:03d}", f"z{i + 1:03d}") for i in range(40)]  # a long chain
    edges = [(b, *sorted((x, y))) for b, x, y in edges if x != y]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for b, x, y in edges:
        a, c = find((b, x)), find((b, y))
        parent[max(a, c)] = min(a, c)
    got = components(spark.createDataFrame(edges, "b string, name_a string, name_b string"), ["b"]).collect()
    assert {(r.b, r.name): r.canonical for r in got} == {v: find(v)[1] for v in list(parent)}


def chain(order):
    return [("b", *sorted(pair)) for pair in zip(order, order[1:])]


@pytest.mark.parametrize("kind", ["sorted", "reversed", "shuffled", "adverse"])
def test_components_of_long_chains(spark, kind):
    names = [f"n{i:03d}" for i in range(400)]
    order = list(reversed(names)) if kind == "reversed" else list(names)
    if kind == "shuffled":
        random.Random(1).shuffle(order)
    if kind == "adverse":  # small names far apart, each beyond a settled stretch of larger ones
        order = [names[i // 20 if i % 20 == 0 else 20 + i] for i in range(380)]
    rounds = []
    got = components(spark.createDataFrame(chain(order), "b string, name_a string, name_b string"), ["b"], on_round=rounds.append).collect()
    assert {r.name: r.canonical for r in got} == dict.fromkeys(order, min(order)) and max(rounds) <= 10


def test_rounds_of_components_shrink(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components_module, "materialize", lambda df: written.append(df.localCheckpoint()) or written[-1])
    order = list(range(600))
    random.Random(5).shuffle(order)
    got = connected_components(spark.createDataFrame(list(zip(order, order[1:])), "a int, b int")).collect()
    assert {r.node: r.component for r in got} == dict.fromkeys(range(600), 0)
    assert sum(df.count() for df in written) < 6 * 600  # all rounds together, with the pairs and the result


def test_components_of_odd_pairs(spark):
    pairs = [(1, 1), (2, None), (None, None), (5, 4), (4, 5), (5, 4), (9, 8), (8, 7)] + [(100, 100 + i) for i in range(1, 50)] + [(300 + i, 400) for i in range(50)]
    got = connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()
    want = {1: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 400: 300} | {100 + i: 100 for i in range(50)} | {300 + i: 300 for i in range(50)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_add_canonical(spark):
    rows = [("C", "Ballymore"), ("c.", "BALLY-MORE"), ("C", "Ballymor"), ("C", ""), ("C", None), ("D", "Ballymor"), ("C", "Tully")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, county string, name string")
    got = add_canonical(df, ["county"], "name").orderBy("i").collect()
    assert [r.townland_canonical for r in got] == ["ballymor", "ballymor", "ballymor", "", "", "ballymor", "tully"]


def test_best_match_first_maximum_wins(spark):
    left = spark.createDataFrame([("b", "Ballymor"), ("b", "Xyz"), ("b", "")], "b string, w string")
    offered = spark.createDataFrame([("b", "Ballymora", 2), ("b", "Ballymore", 1), ("b", "-", 0), ("c", "Ballymor", 0)], "b string, c string, p int")
    got = {r.w: r.matched for r in best_match(left, offered, ["b"], "w", "c", "p", 0.9).collect()}
    assert got == {"Ballymor": "Ballymore", "Xyz": None, "": None}


def test_closest_to_reports_low_scores(spark):
    df = spark.createDataFrame([("Grange West", 1), ("Grange East", 2), (None, 0)], "n string, p int")
    hit = closest_to(df, "n", "p", "GRANGE WES").first()
    assert hit.matched == "Grange West" and round(hit.score, 3) == round(difflib_ratio("GRANGEWES", "GRANGEWEST"), 3)
    miss = closest_to(df, "n", "p", "Qqqq").first()
    assert miss.matched is None and miss.score < 0.65
    assert closest_to(df.filter(F.col("n") == "none"), "n", "p", "x").first().score == 0.0
