import random

from pyspark.sql import functions as F

from ledgerline.operators.dedupe import keep_last
from ledgerline.operators import ordering
from ledgerline.operators.ordering import fill_down, number_runs, order_rows, sums_before, with_previous
from ledgerline.operators.runs import contiguous_runs, forward_fill, suppress_repeats


def sample(seed, n=300):
    """Rows in shuffled order; one key holds more than a third of them."""
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice("ab"), rng.choice(["", None, "x", "y", "nan", " x "])) for i in range(n)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return rows, shuffled


def test_order_rows_is_dense(spark):
    rows, shuffled = sample(1)
    got = order_rows(spark.createDataFrame(shuffled, "i int, k string, v string"), ["i"], blocks=7).collect()
    assert sorted((r.grn, r.i) for r in got) == [(i, i) for i in range(len(rows))]
    assert len({r.blk for r in got}) > 3


def test_sums_before_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_GROUP", 4)
    rng = random.Random(2)
    rows = [(b, rng.randint(0, 50), rng.randint(-5, 5)) for b in range(0, 60, 1) if b % 7]  # some blocks are empty
    got = {r.blk: (r.x, r.y) for r in sums_before(spark.createDataFrame(rows, "blk int, x bigint, y bigint"), ["x", "y"]).collect()}
    assert got == {b: (sum(r[1] for r in rows if r[0] < b), sum(r[2] for r in rows if r[0] < b)) for b, _, _ in rows}


def test_plans_do_not_grow_with_the_blocks(spark):
    df = spark.range(2000).selectExpr("id", "CAST(id % 7 AS string) AS k")
    sizes = []
    for blocks in (3, 300):
        runs = contiguous_runs(order_rows(df, ["id"], blocks), ["k"], "k", "run")
        sizes.append(len(runs._jdf.queryExecution().optimizedPlan().toString()))
        got = sorted((r.id, r.grn, r.run) for r in runs.collect())
        assert got == [(i, i, i) for i in range(2000)]
    assert sizes[1] < 1.1 * sizes[0]


def test_runs_previous_and_fill(spark):
    for seed in range(3):
        rows, shuffled = sample(seed)
        df = order_rows(spark.createDataFrame(shuffled, "i int, k string, v string"), ["i"], blocks=9)
        numbered = contiguous_runs(df, ["k"], "v", "run")
        numbered = number_runs(numbered, {"plain": (["k"], None), "again": (["v"], None)})
        got = {r.i: r for r in with_previous(numbered, {"pk": "k", "pv": "v"}).collect()}
        run, plain, previous = -1, -1, (None, None)
        last_key = None
        for i, k, v in rows:
            text = (v or "").strip()
            name = "" if text == "nan" else text
            key = (k, name) if name else None
            if key is not None and key != last_key:
                run += 1
            last_key = key
            assert got[i].run == (run if key else None)
            plain += previous[0] != k
            assert got[i].plain == plain
            assert (got[i].pk, got[i].pv) == previous
            previous = (k, v)


def test_fill_down_over_blocks(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else "g%d" % (i % 5), i, rng.choice(["", "", "", "x", "y", None, " z "])) for i in range(400)]
    got = forward_fill(spark.createDataFrame(rows, "g string, i int, v string"), ["g"], ["i"], "v", "f", blocks=11).collect()
    last, want = {}, {}
    for g, i, v in rows:
        if (v or "").strip():
            last[g] = v.strip()
        want[(g, i)] = last.get(g, "")
    assert {(r.g, r.i): r.f for r in got} == want
    assert {(r.g, r.i): r.v for r in got} == {(g, i): v for g, i, v in rows}


def test_fill_value_only_after_its_block(spark):
    df = order_rows(spark.createDataFrame([("a", i, "x" if i == 0 else None) for i in range(50)], "g string, i int, v string"), ["i"], 10)
    got = fill_down(df, ["g"], F.col("v"), "f").collect()
    assert {r.f for r in got} == {"x"}


def test_suppress_repeats(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice("ab"), rng.choice(["p", ""]), rng.choice("xy")) for g in range(3) for i in range(60)]
    got = suppress_repeats(
        spark.createDataFrame(rows, "g int, i int, t string, s1 string, s2 string"), ["g"], ["i"], ["t", "s1", "s2"], blocks=7
    ).collect()
    want, group, held = {}, None, [None] * 3
    for g, i, *levels in rows:
        if g != group:
            group, held = g, [None] * 3
        out = []
        for n, value in enumerate(levels):
            changed = value != held[n]
            out.append(value if changed else "")
            if changed:
                held[n] = value
                held[n + 1 :] = [None] * (2 - n)
        want[(g, i)] = tuple(out)
    assert {(r.g, r.i): (r.shown_t, r.shown_s1, r.shown_s2) for r in got} == want


def test_keep_last(spark):
    rows = [("a", 1, "x"), ("b", 2, "y"), ("a", 3, None), ("c", 4, "z"), ("b", 5, "w")]
    got = keep_last(spark.createDataFrame(rows, "k string, o int, v string"), ["k"], "o").collect()
    assert {r.k: (r.o, r.v, r.first_at) for r in got} == {"a": (3, None, 1), "b": (5, "w", 2), "c": (4, "z", 4)}
