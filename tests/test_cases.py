import inspect

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from ledgerline.plans.cases import ORACLES, QUERIES
from tools.compare import TABLES, _agree, normal

FOLDER = "/root/testdata/sf0.001"
# one case of each kind; tools/compare.py runs all of them on larger tables
SAMPLED = [
    "total_vs_detail", "leave_one_out", "page_link", "missing_breakdown", "cascade_lookup", "review_queue", "canonical_entities",
    "reply_finalise_chat", "page_display", "build_requests_chat", "last_wins", "similar_pairs_difflib", "cascade_default", "cascade_review",
    "truth_file", "name_files", "combined_file", "document_files", "old_field_names", "chain_components", "page_bitmap_counts",
    "page_bitmap_common", "reply_source_generate", "page_files", "work_left_filtered", "cascade_stored", "load_counts", "finalise_counts",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLED)
def test_query_equals_sql(spark, db, name):
    got = queries()[name](spark, FOLDER)
    cursor = db.execute(oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(got.columns) == sorted(types)
    assert all(_agree(t, types[c]) for c, t in got.dtypes)
    assert normal(got.toPandas()) == normal(cursor.df())


def test_registry(db):
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) == set(ORACLES) <= set(oracle_sql())
    for name, sql in ORACLES.items():
        db.execute("EXPLAIN " + sql)
        assert len(inspect.signature(QUERIES[name]).parameters) == 2


def test_entry(spark):
    assert entry(spark).count() == 1500


def test_difflib_pairs(spark, db):
    from itertools import combinations

    from ledgerline.functions.similarity import difflib_ratio

    parts = db.execute("SELECT DISTINCT p_brand, p_name FROM part").fetchall()
    want = {
        (x[0], *sorted((x[1], y[1]))) for x, y in combinations(parts, 2) if x[0] == y[0] and difflib_ratio(*sorted((x[1], y[1]))) >= 0.8
    }
    assert {(r.p_brand, r.name_a, r.name_b) for r in queries()["similar_pairs_difflib"](spark, FOLDER).collect()} == want
