from pyspark.sql import functions as F

from ledgerline.operators.entities import (
    entity_pages, entity_summary, flag_one_page, in_scope, page_scope, pages_to_check, resolve_and_cluster, scope_inventory,
)
from ledgerline.operators.lookup import REVIEW_COLUMNS, join_admin, resolve_admin, resolve_fuzzy
from ledgerline.sources.admin import OVERRIDE_COLUMNS, TRUTH_COLUMNS, marked_for_check
from ledgerline.sinks import with_page_cell

ADMIN = ["county_effective", "barony_effective", "parish_effective"]


def truth_table(spark, rows):
    """rows: (page, county, county_gv, parish, parish_gv)"""
    data = [(p, c, cg, "b", None, pa, pg, "t", None, "1" if i % 2 else "0", i) for i, (p, c, cg, pa, pg) in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in TRUTH_COLUMNS) + ", row_no bigint")


def page_rows(spark, rows):
    data = [(i, p, parish, f"n{i}") for i, (p, parish) in enumerate(rows)]
    return spark.createDataFrame(data, "i int, page_name string, parish string, townland_filled string")


TRUTH = [
    ("p1", None, None, "Clones", None), ("p1", "Monaghan", None, "CLONES", None),  # only the second has a county
    ("p1", "Cavan", "Cavan GV", "Urney", "Urney-GV"),
    ("p2", "nan", None, "Killeagh", None),  # a page without any county
    ("p2", None, None, "Kilteagh", None), ("p2", "", None, "Other Parish", None), ("p3", None, None, "Drumcor", None),
]
ROWS = [
    ("p1", "PARISH OF CLONES"), ("p1", "urneygv"), ("p1", "Nowhere"), ("p1", None), ("p2", "Killeagh"), ("p2", "Kileagh"),
    ("p2", "Parish of Other Parsh"), ("p2", "zzz"), ("p3", "Drumcor (part of)"), ("p9", "Clones"), ("p9", ""), ("p2", ""), (" p1 ", "Urney"),
]


def test_cascade(spark):
    got = join_admin(page_rows(spark, ROWS), truth_table(spark, TRUTH), F.col("i") % 3).orderBy("i").collect()
    assert [r.gv_join_method for r in got] == (
        ["parish_key", "parish_key", "page_fallback", "page_fallback"] + ["unresolved"] * 8 + ["parish_key"]
    )
    assert [r.county_effective for r in got[:4]] == ["Monaghan", "Cavan GV", "Monaghan", "Monaghan"]
    assert got[1].parish_gv == "Urney-GV" and got[0].barony_gv == "b" and got[4].county_gv == ""
    assert got[0].townland_gv == "n0"


def check_resolution(rows, review):
    by = {r.i: r for r in rows.collect()}
    assert by[4].gv_join_method == "fuzzy_parish" and by[4].parish_effective == "Killeagh"
    assert by[5].gv_join_method == "unresolved"  # two candidates within five points
    assert by[6].gv_join_method == "fuzzy_parish" and by[6].parish_effective == "Other Parish" and by[6].county_effective == ""
    assert by[8].gv_join_method == "fuzzy_parish"
    assert by[0].gv_join_method == "parish_key" and by[2].gv_join_method == "page_fallback"
    queue = {}
    for r in review.collect():
        queue.setdefault((r.page_name, r.llm_parish), []).append((r.status, r.candidate_rank))
    assert {k: sorted(v, key=str) for k, v in queue.items()} == {
        ("p2", "Kileagh"): [("ambiguous", 1), ("ambiguous", 2), ("ambiguous", 3)],
        ("p2", "zzz"): [("low_score", 1), ("low_score", 2), ("low_score", 3)],
        ("p9", "Clones"): [("no_gv_rows", None)],
        ("p9", ""): [("no_gv_rows", None)],
    }
    assert tuple(review.columns) == REVIEW_COLUMNS


def test_fuzzy_resolution(spark):
    truth = truth_table(spark, TRUTH)
    joined = join_admin(page_rows(spark, ROWS), truth, F.col("i") % 3)
    check_resolution(*resolve_fuzzy(joined, truth, ["i"], F.col("i") % 3))
    check_resolution(*resolve_admin(page_rows(spark, ROWS), truth, ["i"], F.col("i") % 3))


def test_fuzzy_before_fallback(spark):
    truth = truth_table(spark, [("p1", "Cavan", None, "Urney", None), ("p1", "Cork", None, "Clonmeen", None)])
    rows = page_rows(spark, [("p1", "Clonmeenn"), ("p1", "zzz")])
    plain, _ = resolve_admin(rows, truth, ["i"], F.lit(0))
    assert [r.county_effective for r in plain.orderBy("i").collect()] == ["Cavan", "Cavan"]
    eager, review = resolve_admin(rows, truth, ["i"], F.lit(0), fuzzy_before_fallback=True)
    assert [(r.county_effective, r.gv_join_method) for r in eager.orderBy("i").collect()] == [
        ("Cork", "fuzzy_parish"), ("Cavan", "page_fallback"),
    ]
    assert {r.status for r in review.collect()} == {"low_score"}


def test_overrides(spark):
    data = [
        ("p1", "Parish of Clones", "OldC", "ob", "op", 0), ("p1", "CLONES.", "NewC", "ob", "op", 1), ("p2", None, "Whole", "wb", None, 2),
        ("p2", "zzz", "", "x", "x", 3), ("p9", "", "Never", "x", "x", 4), (" ", "", "Never", "x", "x", 5),
    ]
    overrides = spark.createDataFrame(data, ", ".join(f"{c} string" for c in OVERRIDE_COLUMNS) + ", row_no bigint")
    truth = truth_table(spark, TRUTH)
    got, _ = resolve_admin(page_rows(spark, ROWS), truth, ["i"], F.col("i") % 2, overrides)
    by = {r.i: (r.county_gv, r.gv_join_method) for r in got.collect()}
    assert by[0] == ("NewC", "override")  # the last rule wins
    assert by[4] == ("Whole", "override") and by[6] == ("Whole", "override")
    assert by[7] == ("", "unresolved")  # its own rule lacks a county and hides the page rule
    assert by[9] == ("", "unresolved") and by[11] == ("", "unresolved")  # unknown page; blank parish


def test_scope_operators(spark):
    rows = [("C", "b", "p", "A", "g1"), ("C", "b", "p", "A", "g2"), ("C", "b", "p", "B", "g1"), ("C", "b", "p", "B", "g1"), ("", "b", "p", "A", "g1"), ("C", "b", "p", "", "g3")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in [*ADMIN, "townland_linked", "page_name"]))
    flags = flag_one_page(df, F.col("i") % 2).orderBy("i").collect()
    assert [r.is_one_page_townland for r in flags] == [False, False, True, True, False, False]
    scoped = in_scope(df)
    assert {(r.townland_linked, r.page_count, r.is_one_page) for r in page_scope(scoped).collect()} == {("A", 2, False), ("B", 1, True)}
    one = scope_inventory(scoped, True).collect()
    assert [(r.townland_linked, r.target_filename) for r in one] == [("B", "g1")]
    many = scope_inventory(scoped, False).orderBy("target_filename").collect()
    assert [(r.townland_linked, r.target_filename) for r in many] == [("A", "g1"), ("A", "g2")]
    keys = ["county_effective", "townland_linked"]
    pages = entity_pages(scoped, keys, "page_name")
    shown = with_page_cell(entity_summary(scoped, keys, "page_name"), pages, keys, "page_name", "pages", ", ")
    summary = {tuple(r[k] for k in keys): (r.pages, r.page_count, r.is_one_page) for r in shown.collect()}
    assert summary == {("C", "A"): ("g1, g2", 2, False), ("C", "B"): ("g1", 1, True)}
    assert [r.page_name for r in pages_to_check(scoped, keys, "page_name").collect()] == ["g1"]


def test_resolve_and_cluster(spark):
    schema = "i int, page_name string, county_gv string, barony_gv string, parish_gv string, townland_gv string, is_continued int"
    rows = [
        (0, "p1", "C", "b", "p", "Ballymore", 0), (1, "p2", "C", "b", "p", "Ballymora", 1), (2, "p2", "C", "b", "p", "Ballymorre", 0),
        (3, "p2", " ", "b", "p", "Ballymore", 1), (4, "p3", None, None, None, "X", 0),
    ]
    got = {r.i: (r.townland_gv, r.townland_canonical) for r in resolve_and_cluster(spark.createDataFrame(rows, schema), ["i"], 0.85).collect()}
    assert got == {0: ("Ballymore", "ballymore"), 1: ("Ballymore", "ballymore"), 2: ("Ballymorre", "ballymore"), 3: ("Ballymore", ""), 4: ("X", "")}
    none = resolve_and_cluster(spark.createDataFrame(rows[3:], schema), ["i"]).collect()
    assert {r.townland_canonical for r in none} == {"ballymore", "x"}


def test_marked_rows(spark):
    assert marked_for_check(truth_table(spark, TRUTH)).count() == 3
