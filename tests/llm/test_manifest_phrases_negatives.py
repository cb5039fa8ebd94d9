"""Merkle manifest, Lempel-Ziv fingerprints and hard negatives against brute force, also on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from ledgerline.llm import QUERIES, merkle, negatives, phrases
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", leaf string, tree_key string, grn string, blk string, block string, q string, i string"


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes, at, node):
    """Root over the nodes, what the node's proof holds, and the root that another node in its place gives."""
    proof = []
    while len(nodes) > 1:
        first = at - at % 16
        run = nodes[first : first + 16]
        before, after = "".join(run[: at - first]), "".join(run[at - first + 1 :])
        proof += [before, after]
        node, at = sha(before + node + after), at // 16
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], "".join(proof), node


def manifest(rows):
    """Expected rows by the rules, level by level."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = [doc_id, source, lang, n_chars]
        leaf = sha("".join(map(told, [*own, text])))
        marked = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        trees.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, sha("".join(map(told, [*own, lower(text)]))) if marked else leaf))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: r[0])
    subroots = [climb([r[2] for r in trees[s]], 0, "")[0] for s in order]
    out = []
    for k, s in enumerate(order):
        leaves = [r[2] for r in trees[s]]
        for i, (_, doc_id, leaf, other) in enumerate(trees[s]):
            _, inner, node = climb(leaves, i, other)
            root, outer, folded = climb(subroots, k, node)
            out.append((doc_id, leaf, subroots[k], root, sha(inner + outer), folded, folded == root))
    return out


def check_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, *"abcdefg") for r in rows], DOCUMENT + EXTRA)
    got = merkle.merkle_proofs(merkle.document_leaves(docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(manifest(rows), key=key)


def test_manifest_trees_of_every_height(spark):
    """One leaf up to a source of 5,000, which has superblocks below several levels of outer nodes, and 20 sources."""
    sizes = [1, 2, 15, 16, 17, 255, 256, 257, 300, 5000, *[3] * 10]
    rows = [(1000 * k + i if n < 1000 else 10**6 + i, f"Text {i} {k}", "en", f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    check_manifest(spark, rows)


def test_manifest_odd_rows(spark):
    long = "Alpha beta " * 100_000
    rows = [
        (1, None, None, None, None), (2, "", "", "", 0), (3, "UPPER é Ü", "en", None, 9), (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)),
        (5, "other", "en", "b", 5), (None, "No id", "en", "b", 5), (2**60 + 1, "A", "en", "B", 1), (-7, "A", "en", "b", 1), (None, None, None, None, None),
    ]
    check_manifest(spark, rows)
    check_manifest(spark, [(7, "Alone", "en", "s", 5)])
    assert merkle.merkle_proofs(merkle.document_leaves(spark.createDataFrame([], DOCUMENT))).count() == 0


# Lempel-Ziv fingerprints


def phrase_set(text):
    found, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in found:
            found.add(text[start:end])
            start = end
    return found


def phrase_hashes(text):
    out = set()
    for phrase in phrase_set(text):
        h = sum((ord(c) + 1) * int(phrases.FACTOR) ** (k + 1) for k, c in enumerate(phrase)) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor % 2**64
        out.add((h ^ h >> 31) >> 32)
    return sorted(out)[: phrases.MINIMA]


def expected_edits(rows):
    """Rows of (doc_id, text) in descending order of id, nulls last, then text."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        a, e, o = phrase_hashes(text), phrase_hashes(edited), phrase_hashes(other)

        def near(x, y):
            either = sorted({*x, *y})[: phrases.MINIMA]
            return sum(v in x and v in y for v in either) / len(either) if either else 1.0

        told = lambda hashes: "".join(f"{h:08x}" for h in hashes)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), told(a), told(e), near(a, e), near(a, o)))
    return out


def same_edits(got, want):
    key = lambda r: tuple(map(str, r[:5])) + tuple(round(v, 9) for v in r[5:])
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_fingerprints_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op12_lz_fingerprints"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = got.collect()
    same_edits(got, expected_edits(rows))
    by = {r.doc_id: r for r in got}
    texts = dict(rows)
    assert all(by[a].fingerprint == by[b].fingerprint for a in texts for b in texts if texts[a] == texts[b])
    alike = [r for r in got if r.n_chars >= 300 and r.near_next < 0.9]
    assert sum(r.near_edited > r.near_next for r in alike) >= 0.97 * len(alike)


@pytest.mark.parametrize("blocks", [1, 2, 7, 50])
def test_fingerprints_over_block_borders(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.randint(0, 60), "".join(rng.choice("ab é\U0001f600") for _ in range(rng.randint(0, 90)))) for _ in range(70)]
    rows += [(None, "no id"), (None, None), (None, None), (5, ""), (61, None), (2**60, "far away"), (-4, "x")]
    docs = spark.createDataFrame([(*r, "a", True, 3) for r in rows], "doc_id bigint, text string, block string, is_next boolean, _b int")
    same_edits(phrases.edit_fingerprints(docs, blocks=blocks).collect(), expected_edits(rows))


def test_fingerprints_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert phrases.edit_fingerprints(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, "one and only")], [(1, None)], [(None, "none")], [(1, "")] * 3, [(None, None), (3, "abc")]):
        same_edits(phrases.edit_fingerprints(spark.createDataFrame(rows, schema)).collect(), expected_edits(rows))
    long = [(2, "lorem ipsum " * 40_000), (1, "a" * 1_100_000)]
    same_edits(phrases.edit_fingerprints(spark.createDataFrame(long, schema)).collect(), expected_edits(long))
    assert [r.fingerprint for r in phrases.fingerprints(spark.createDataFrame([(1, "abab"), (2, None)], schema)).orderBy("doc_id").collect()] == [
        "".join(f"{h:08x}" for h in phrase_hashes("abab")), ""
    ]


# hard negatives


def expected_negatives(rows, every=100):
    """Rows of (vec_id, whole numbers, label)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for anchor, q, label in rows:
        if anchor % every:
            continue
        ranked = sorted((-dot(q, other), i, of) for i, other, of in rows if i != anchor)
        for score, positive, _ in [r for r in ranked if r[2] == label][:5]:
            fit = [r for r in ranked if r[2] != label and 30 * -score <= 100 * -r[0] <= 90 * -score]
            out += [(anchor, positive, k + 1, r[1], -score, -r[0]) for k, r in enumerate(fit[:10])]
    return sorted(out)


def got_negatives(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clusters(n, spread, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = centres[rng.integers(0, 6, n)] * rng.uniform(0.5, 2, (n, 1)) + rng.normal(size=(n, width)) * spread
    return [(i, [float(x) for x in row], int(rng.integers(0, 4))) for i, row in enumerate(rows)]


def whole(rows):
    return [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_negatives_over_many_blocks(spark, spread):
    rows = clusters(700, spread, 12, 3)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = negatives.hard_negatives(df, every=20, block_rows=30, n_references=5)
    assert got_negatives(got) == expected_negatives(whole(rows), 20)


def test_negatives_prune_pairs_and_rows(spark):
    """Of tight groups most rows are never scored: the bounds of their angles do not meet the windows."""
    rows = clusters(600, 0.01, 12, 5)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint")
    stored = negatives.store(negatives.usable(df, "vec_id", "embedding", "label"), 6, 50).collect()
    column = lambda c: np.array([r[c] for r in stored])
    table = {c: column(c) for c in ("vec_id", "label", "norm", "angles", "q")}
    scored = []
    real = negatives.scores_of
    try:
        negatives.scores_of = lambda q, anchor: scored.append(len(q)) or real(q, anchor)
        for r in stored[:20]:
            one = {c: [r[c]] for c in ("vec_id", "label", "norm")} | {"q": [np.array(r.q)], "angles": [np.array(r.angles)]}
            best = real(table["q"], np.array(r.q))
            fifth = sorted(best[(table["label"] == r.label) & (table["vec_id"] != r.vec_id)])[-5]
            one["windows"] = [[{"name": 0, "low": int(fifth), "high": negatives.MOST}]]
            found = negatives.search_blocks(one, table, True, 5)
            assert [s for *_, s in found] == sorted(best[(table["label"] == r.label) & (table["vec_id"] != r.vec_id)])[:-6:-1]
    finally:
        negatives.scores_of = real
    assert sum(scored) < 0.2 * 20 * len(stored)


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 2),
        (7, [inf, 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [0.4], 3), (10, [0.3, 0.2, 9.0], 3), (100, [0.0, 0.0], 1), (200, [], 2), (11, [0.9, 0.6], 1),
        (300, [-1.0, -1.0], 5), (12, [1.0, 1.0], 5),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, block int, q string")
    out = {4, 5, 6, 7, 8, None}
    kept = {i: (i, v, label) for i, v, label in rows if i not in out}
    assert got_negatives(negatives.hard_negatives(df)) == expected_negatives(whole(kept.values()))
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e300], 1), (1, [1e300], 1), (2, [3e16], 2), (3, [-1e300], 2)], "vec_id bigint, embedding array<double>, label int")
    assert got_negatives(negatives.hard_negatives(huge)) == []  # every score is at the limit of a long or below zero
    exact = [(0, [2.0**20, 3.0], 1), (1, [2.0**20, 1.0], 1), (2, [2.0**19, 7.0], 2), (3, [2.0**19, 5.0], 2)]
    df = spark.createDataFrame(exact, "vec_id bigint, embedding array<double>, label int")
    assert got_negatives(negatives.hard_negatives(df)) == expected_negatives(whole(exact))  # beyond the doubles' 53 bits


def test_negatives_of_repeated_ids_take_the_least(spark):
    rows = [(0, [1.0], 1), (0, [2.0], 1), (1, [1.0], 1), (2, [0.5], 2), (2, [0.6], 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert got_negatives(negatives.hard_negatives(df)) == [(0, 1, 1, 2, 256 * 256, 256 * 128)]
    assert df.filter(F.col("vec_id") == 0).count() == 2
