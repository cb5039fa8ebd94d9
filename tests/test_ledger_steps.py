import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from ledgerline.functions.text import clean_key, to_pence, trim_text
from ledgerline.operators import entities, ordering
from ledgerline.plans.cases import ledgers

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def tables(monkeypatch):
    """The tables that orderings and numberings write."""
    written, write = [], ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df: written.append(write(df)) or written[-1])
    return written


@pytest.mark.parametrize("name", ["missing_breakdown", "other_model_total", "model_overlap"])
def test_two_readings_share_one_order(spark, tables, name):
    queries()[name](spark, FOLDER)
    assert sum("_seq" in t.columns for t in tables) == 1  # rows put in order
    assert sum("_edge" in t.columns for t in tables) == 1  # rows with their runs


def test_keys_of_runs_are_not_written(spark, tables):
    rows = [(i, "ab  cc"[i // 5 % 6].strip()) for i in range(60)]
    df = ordering.order_rows(spark.createDataFrame(rows, "i int, n string"), ["i"], 7)
    got = ordering.number_runs(df, {"r": (["n"], F.col("n") == "")}).orderBy("i").collect()
    want, last, number = [], "", -1
    for _, n in rows:
        number += n not in ("", last)
        last = n
        want.append(number if n else None)
    assert [r.r for r in got] == want
    assert not any(c.startswith("_key_") for t in tables for c in t.columns)


def test_other_total_reads_flags_where_rows_are_numbered(spark, tables, monkeypatch):
    written, write = [], ledgers.materialize
    monkeypatch.setattr(ledgers, "materialize", lambda df: written.append(df) or write(df))
    assert queries()["other_model_total"](spark, FOLDER).count() > 0
    assert not written  # no table of checks
    numbered = next(t for t in tables if "_edge" in t.columns)
    assert not {"total_val", "land_val", "event_id", "ts", "occupier"} & set(numbered.columns)


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_marks_say_whether_any_row_of_the_run_meets_them(spark, blocks):
    import random

    rng = random.Random(blocks)
    names = [n for _ in range(25) for n in [rng.choice(["a", "b", "c", ""])] * rng.choice([1, 1, 2, 3, 30])]
    rows = [(i, n, rng.choice([True, False, False, False, None]), rng.random() < 0.02) for i, n in enumerate(names)]
    df = ordering.order_rows(spark.createDataFrame(rows, "i int, n string, x boolean, y boolean"), ["i"], blocks)
    runs = {"r": (["n"], F.col("n") == ""), "s": (["n"], F.col("n").isin("", "b")), "t": (["n"], None)}
    marks = {"r": {"x": F.col("x"), "any_y": F.col("y")}, "s": {"s_y": F.col("y")}}
    got = ordering.number_runs(df, runs, marks=marks).orderBy("i").collect()
    plain = ordering.number_runs(df, runs).orderBy("i").collect()
    want, met = {"r": [], "s": []}, {"x": set(), "any_y": set(), "s_y": set()}
    for name, blank in (("r", ("",)), ("s", ("", "b"))):
        last, number = None, -1
        for _, n, x, y in rows:
            number += n not in blank and n != last
            last = None if n in blank else n
            want[name].append(None if n in blank else number)
            for mark, value in (("x", x), ("any_y", y)) if name == "r" else (("s_y", y),):
                if value and n not in blank:
                    met[mark].add(number)
    assert [(g.r, g.s, g.t) for g in got] == [(p.r, p.s, p.t) for p in plain]
    assert [g.r for g in got] == want["r"] and [g.s for g in got] == want["s"]
    for mark, name in (("x", "r"), ("any_y", "r"), ("s_y", "s")):
        assert [g[mark] for g in got] == [None if no is None else no in met[mark] for no in want[name]]


def test_marks_of_an_empty_table(spark):
    df = ordering.order_rows(spark.createDataFrame([], "i int, n string"), ["i"], 3)
    assert ordering.number_runs(df, {"r": (["n"], None)}, marks={"r": {"m": F.col("i") > 0}}).collect() == []


def test_page_cells_only_of_split_runs(spark, monkeypatch):
    seen, cells = [], ledgers.with_page_cell
    monkeypatch.setattr(ledgers, "with_page_cell", lambda df, pages, *rest: seen.append(pages) or cells(df, pages, *rest))
    shown = queries()["split_checklist"](spark, FOLDER).count()
    assert shown > 0 and seen[0].select("run_no").distinct().count() == shown


def test_short_ways_keep_odd_texts(spark):
    texts = {
        "nan": "", "NaN ": "", " nAn": "", "nan a": "nan a", "xnan": "xnan", "": "", " ": "", "\u00a0x\u2003": "x", "x\u0085": "x", "\tx y\n": "x y",
        "é x": "é x", "x é": "x é", "\u3000": "",
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: (r.k, r.m) for r in df.select("t", clean_key("t").alias("k"), trim_text("t").alias("m")).collect()}
    assert {t: k for t, (k, _) in got.items()} == texts | {None: ""}
    assert {t: m for t, (_, m) in got.items()} == {t: t.strip() for t in texts} | {None: ""}
    amounts = {
        "1 2 3": 267, "1 2 3\n": 267, "1 2 3\u0085": 267, "1  2 3": 267, "+1 2 3": 267, "-1 2 3": -213, "£1 2 3": 267, "1,000 0 1": 240001, "1 2": 0,
        "1 2 3 4": 267, "x 2 3": 27, "": 0, "1 2 99999999999999999999": 264, "999999999999999 0 0": 239999999999999760, "١ 2 3": 27,
    }
    df = spark.createDataFrame([(t,) for t in [*amounts, None]], "t string")
    assert {r.t: r.p for r in df.select("t", to_pence("t").alias("p")).collect()} == amounts | {None: 0}


def test_only_names_of_many_rows_are_dealt(spark, monkeypatch):
    names = ["Tully"] * 40 + ["tully."] * 5 + ["Tullyy"] * 3 + ["Grange", "", None]
    df = spark.createDataFrame([(i, "C", n) for i, n in enumerate(names)], "i int, county string, name string")
    dealt, attach = [], entities.attach
    monkeypatch.setattr(entities, "attach", lambda rows, values, keys, salt: dealt.append(rows.select(salt, *keys).distinct().count()) or attach(rows, values, keys, salt))
    want = ["tully"] * 48 + ["grange", "", ""]
    for many, salts in ((entities.HOT_ROWS, 4), (20, 5)):
        monkeypatch.setattr(entities, "HOT_ROWS", many)
        got = entities.add_canonical(df, ["county"], "name", threshold=0.8).orderBy("i").collect()
        assert [r.townland_canonical for r in got] == want and got[0].asDict().keys() == {"i", "county", "name", "townland_canonical"}
        assert dealt[-1] == salts if many > 20 else dealt[-1] > salts
