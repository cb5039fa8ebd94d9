"""Cases for lookups, page links and entities."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ledgerline.operators.components import connected_components
from ledgerline.operators.continuation import resolve_continued
from ledgerline.operators.entities import (
    add_canonical, entity_pages, entity_summary, flag_one_page, page_scope, pages_to_check, resolve_and_cluster, scope_inventory,
)
from ledgerline.operators.linking import link_pages
from ledgerline.operators.lookup import REVIEW_COLUMNS, join_admin, resolve_admin, resolve_fuzzy
from ledgerline.operators.simjoin import best_match, similar_pairs
from ledgerline.operators.skew import hash_salt
from ledgerline.plans.analyse import analyse_rows
from ledgerline.plans.cases.base import CHECKS_SQL, LEDGER_SQL, case, ledger, ordered_ledger, table
from ledgerline.plans.cases.texts import normal_sql, parish_sql, part_truth
from ledgerline.sinks import with_page_cell
from ledgerline.storage import materialize


def _lookup_rows(spark, folder):
    """Parts under their brand, and customers under the brand numbered like their nation."""
    parts = table(spark, folder, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("id"),
        F.col("p_brand").alias("page_name"),
        F.concat(F.col("p_name"), F.when(F.col("p_type") == "LARGE", " (part of)").otherwise("")).alias("parish"),
        F.col("p_type").alias("townland_filled"),
    )
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("id"),
        F.concat(F.lit("Brand#"), F.col("c_nationkey")).alias("page_name"),
        F.col("c_mktsegment").alias("parish"),
        F.col("c_name").alias("townland_filled"),
    )
    return parts.unionByName(customers)


_LOOKUP_SQL = f"""
truth AS (
  SELECT p_brand AS page, p_partkey AS row_no,
         CASE WHEN p_size > 40 THEN 'GV ' || p_size WHEN p_size > 20 THEN 'C ' || p_size ELSE '' END AS county,
         p_type AS barony, CASE WHEN p_type = 'SMALL' THEN p_name || ' gv' ELSE 'PARISH OF ' || p_name END AS parish,
         CASE WHEN p_type = 'SMALL' THEN [{normal_sql("p_name || ' gv'")}, {normal_sql("'PARISH OF ' || p_name")}, {parish_sql("'PARISH OF ' || p_name")}]
              ELSE [{normal_sql("'PARISH OF ' || p_name")}, {parish_sql("'PARISH OF ' || p_name")}] END AS keys
  FROM part),
by_key AS (
  SELECT * FROM (SELECT page, unnest(keys) AS k, county, barony, parish, row_no FROM truth)
  QUALIFY row_number() OVER (PARTITION BY page, k ORDER BY CAST(county = '' AS INT), row_no) = 1),
by_page AS (
  SELECT page, county, barony, parish FROM truth WHERE county <> '' QUALIFY row_number() OVER (PARTITION BY page ORDER BY row_no) = 1),
rows AS (
  SELECT 'p' || p_partkey AS id, p_brand AS page, p_name || CASE WHEN p_type = 'LARGE' THEN ' (part of)' ELSE '' END AS raw, p_type AS townland_gv FROM part
  UNION ALL SELECT 'c' || c_custkey, 'Brand#' || c_nationkey, c_mktsegment, c_name FROM customer),
keyed AS (SELECT *, {parish_sql('raw')} AS k FROM rows),
joined AS (
  SELECT r.id, r.page, r.k, r.townland_gv, coalesce(e.county, '') <> '' AS exact, f.page IS NOT NULL AS fallback,
         CASE WHEN exact THEN e.county ELSE coalesce(f.county, '') END AS county, CASE WHEN exact THEN e.barony ELSE coalesce(f.barony, '') END AS barony,
         CASE WHEN exact THEN e.parish ELSE coalesce(f.parish, '') END AS parish
  FROM keyed r LEFT JOIN by_key e ON e.page = r.page AND e.k = r.k LEFT JOIN by_page f ON f.page = r.page)
"""


@case(
    "cascade_lookup",
    f"""WITH {_LOOKUP_SQL}
    SELECT id, county AS county_effective, barony AS barony_effective, parish AS parish_effective, county AS county_gv, townland_gv,
           CASE WHEN exact THEN 'parish_key' WHEN fallback THEN 'page_fallback' ELSE 'unresolved' END AS gv_join_method
    FROM joined""",
)
def cascade_on_parts(spark, folder):
    joined = join_admin(_lookup_rows(spark, folder), part_truth(spark, folder), hash_salt(["id"]))
    return joined.select(
        "id", "county_effective", "barony_effective", "parish_effective", "county_gv", "townland_gv", "gv_join_method"
    )


@case(
    "override_lookup",
    f"""WITH {_LOOKUP_SQL},
    rules AS (
      SELECT 'Brand#' || s_nationkey AS page, s_suppkey,
             {parish_sql("CASE WHEN s_acctbal < 3000 THEN '' WHEN s_acctbal < 6000 THEN 'Parish of MACHINERY' ELSE 'FURNITURE' END")} AS k,
             CASE WHEN s_acctbal > 9000 THEN '' ELSE 'OV' || s_suppkey END AS county
      FROM supplier QUALIFY row_number() OVER (PARTITION BY page, k ORDER BY s_suppkey DESC) = 1),
    chosen AS (
      SELECT j.*, CASE WHEN j.page IN (SELECT page FROM truth) THEN CASE WHEN e.page IS NOT NULL THEN e.county ELSE w.county END END AS o
      FROM joined j LEFT JOIN rules e ON e.page = j.page AND e.k = j.k LEFT JOIN rules w ON w.page = j.page AND w.k = '')
    SELECT id, CASE WHEN coalesce(o, '') <> '' THEN o ELSE county END AS county_effective,
           CASE WHEN coalesce(o, '') <> '' THEN 'override' WHEN exact THEN 'parish_key' WHEN fallback THEN 'page_fallback' ELSE 'unresolved' END AS gv_join_method
    FROM chosen""",
)
def overrides_on_parts(spark, folder):
    balance = F.col("s_acctbal")
    rules = table(spark, folder, "supplier").select(
        F.concat(F.lit("Brand#"), F.col("s_nationkey")).alias("page_name"),
        F.when(balance < 3000, "").when(balance < 6000, "Parish of MACHINERY").otherwise("FURNITURE").alias("llm_parish"),
        F.when(balance > 9000, F.lit(None)).otherwise(F.concat(F.lit("OV"), F.col("s_suppkey"))).alias("county_effective"),
        F.lit("ob").alias("barony_effective"),
        F.lit("op").alias("parish_effective"),
        F.col("s_suppkey").alias("row_no"),
    )
    rows, _ = resolve_admin(_lookup_rows(spark, folder), part_truth(spark, folder), ["id"], hash_salt(["id"]), rules)
    return rows.select("id", "county_effective", "gv_join_method")


# Length of the longest common subsequence of columns a and b.
LCS_SQL = """list_last(list_reduce(
  list_transform(string_split(a, ''), lambda ch: [unicode(ch)::bigint]),
  lambda prev, ch: list_reduce(
    list_transform(range(1, length(b) + 1), lambda j: [j]),
    lambda cur, jj: cur || [CASE WHEN unicode(substring(b, jj[1], 1)) = ch[1] THEN prev[jj[1]] + 1
                                 ELSE greatest(prev[jj[1] + 1], cur[len(cur)]) END],
    [0::bigint]),
  list_transform(range(0, length(b) + 1), lambda x: 0::bigint)))"""
INDEL_SQL = f"(1.0::DOUBLE - (length(a) + length(b) - 2 * {LCS_SQL})::DOUBLE / (length(a) + length(b)))"

_GARBLED = """CASE WHEN p_size < 20 THEN replace(p_name, ' ', '') WHEN p_size < 30 THEN replace(p_name, 'l', 't')
  WHEN p_size < 40 THEN p_name || ' hill' ELSE reverse(p_name) END"""


def garbled(name: str = "p_name"):
    """Part names with the kinds of damage a reader makes, by part size."""
    size, text = F.col("p_size"), F.col(name)
    return (
        F.when(size < 20, F.replace(text, F.lit(" "), F.lit("")))
        .when(size < 30, F.replace(text, F.lit("l"), F.lit("t")))
        .when(size < 40, F.concat(text, F.lit(" hill")))
        .otherwise(F.reverse(text))
    )


def _fuzzy(spark, folder):
    parts = table(spark, folder, "part")
    truth = parts.select(
        F.col("p_brand").alias("target_filename"), F.lit("C").alias("county"), F.lit(None).cast("string").alias("county_gv"),
        F.lit("").alias("barony"), F.lit("").alias("barony_gv"), F.col("p_name").alias("parish"), F.lit("").alias("parish_gv"),
        F.lit("").alias("townland"), F.col("p_partkey").alias("row_no"),
    )
    rows = parts.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("page_name"), garbled().alias("parish"), F.lit("t").alias("townland_filled")
    )
    return resolve_admin(rows, truth, ["id"], hash_salt(["id"]), fuzzy_before_fallback=True)


_FUZZY_SQL = f"""
names AS (SELECT p_partkey AS id, p_brand AS page, {_GARBLED} AS a FROM part),
cands AS (
  SELECT p_brand AS page, p_name AS b, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) AS rank
  FROM part GROUP BY 1, 2),
first_row AS (SELECT p_brand AS page, arg_min(p_name, p_partkey) AS fb FROM part GROUP BY 1),
open_names AS (
  SELECT DISTINCT page, a FROM names n WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.page = n.page AND c.b = n.a)),
met AS MATERIALIZED (SELECT DISTINCT a, b FROM open_names JOIN cands USING (page)),
known AS MATERIALIZED (SELECT a, b, {INDEL_SQL} * 100.0 AS score FROM met),
scored AS (SELECT page, a, b, rank, score FROM open_names JOIN cands USING (page) JOIN known USING (a, b)),
ranked AS (
  SELECT *, row_number() OVER w AS rn, score - lead(score) OVER w AS gap FROM scored
  WINDOW w AS (PARTITION BY page, a ORDER BY score DESC, rank)),
decided AS (
  SELECT page, a, b, CASE WHEN score < 90.0 THEN 'low_score' WHEN gap < 5.0 THEN 'ambiguous' ELSE 'fuzzy_parish' END AS status
  FROM ranked WHERE rn = 1)
"""


@case(
    "fuzzy_resolve",
    f"""WITH {_FUZZY_SQL}
    SELECT n.id, CASE WHEN d.page IS NULL THEN n.a WHEN status = 'fuzzy_parish' THEN d.b ELSE fb END AS parish_effective,
           CASE WHEN d.page IS NULL THEN 'parish_key' WHEN status = 'fuzzy_parish' THEN status ELSE 'page_fallback' END AS gv_join_method
    FROM names n JOIN first_row USING (page) LEFT JOIN decided d ON d.page = n.page AND d.a = n.a""",
)
def fuzzy_on_parts(spark, folder):
    return _fuzzy(spark, folder)[0].select("id", "parish_effective", "gv_join_method")


@case(
    "review_queue",
    f"""WITH {_FUZZY_SQL}
    SELECT page AS page_name, a AS llm_parish_norm, status, CAST(rank AS INT) AS candidate_rank, round(score, 2) AS score, r.b AS parish
    FROM ranked r JOIN decided d USING (page, a) WHERE rn <= 3 AND status <> 'fuzzy_parish'""",
)
def review_of_parts(spark, folder):
    review = _fuzzy(spark, folder)[1]
    assert tuple(review.columns) == REVIEW_COLUMNS
    return review.select("page_name", "llm_parish_norm", "status", "candidate_rank", "score", "parish")


def _open_pages(spark, folder):
    """Garbled parts whose pages name no county where the brand ends in 1, and customers on pages that the truth does not know."""
    parts = table(spark, folder, "part")
    none = F.lit(None).cast("string")
    truth = parts.select(
        F.col("p_brand").alias("target_filename"), F.when(~F.col("p_brand").endswith("1"), "C").alias("county"), none.alias("county_gv"),
        F.lit("").alias("barony"), F.lit("").alias("barony_gv"), F.col("p_name").alias("parish"), F.lit("").alias("parish_gv"),
        F.lit("").alias("townland"), F.col("p_partkey").alias("row_no"),
    )
    rows = parts.select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_brand").alias("page_name"), garbled().alias("parish"), F.lit("t").alias("townland_filled")
    )
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.concat(F.lit("Nation"), F.col("c_nationkey")).alias("page_name"),
        F.lower("c_mktsegment").alias("parish"), F.lit("t").alias("townland_filled"),
    )
    return rows.unionByName(customers), truth


_OPEN_SQL = f"""{_FUZZY_SQL.replace("WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.page = n.page AND c.b = n.a)", "WHERE right(page, 1) = '1'")},
held AS (SELECT page, b FROM cands WHERE right(page, 1) <> '1')
"""
_OPEN_ROWS_SQL = f"""WITH {_OPEN_SQL}
    SELECT 'p' || n.id AS id, CASE WHEN h.b IS NOT NULL THEN n.a WHEN right(n.page, 1) <> '1' THEN fb WHEN status = 'fuzzy_parish' THEN d.b ELSE '' END AS parish_effective,
           CASE WHEN right(n.page, 1) = '1' THEN '' ELSE 'C' END AS county_effective,
           CASE WHEN h.b IS NOT NULL THEN 'parish_key' WHEN right(n.page, 1) <> '1' THEN 'page_fallback' WHEN status = 'fuzzy_parish' THEN status
                ELSE 'unresolved' END AS gv_join_method
    FROM names n JOIN first_row USING (page) LEFT JOIN decided d ON d.page = n.page AND d.a = n.a LEFT JOIN held h ON h.page = n.page AND h.b = n.a
    UNION ALL SELECT 'c' || c_custkey, '', '', 'unresolved' FROM customer"""


def _shown_admin(rows):
    return rows.select("id", "parish_effective", "county_effective", "gv_join_method")


@case("cascade_default", _OPEN_ROWS_SQL)
def default_cascade_on_parts(spark, folder):
    rows, truth = _open_pages(spark, folder)
    return _shown_admin(resolve_admin(rows, truth, ["id"], hash_salt(["id"]))[0])


@case("cascade_two_steps", _OPEN_ROWS_SQL)
def two_step_cascade_on_parts(spark, folder):
    rows, truth = _open_pages(spark, folder)
    joined = join_admin(rows, truth, hash_salt(["id"]))
    return _shown_admin(resolve_fuzzy(joined, truth, ["id"], hash_salt(["id"]))[0])


@case(
    "cascade_review",
    f"""WITH {_OPEN_SQL}
    SELECT page AS page_name, a AS llm_parish_norm, status, CAST(rank AS INT) AS candidate_rank, round(score, 2) AS score, r.b AS parish
    FROM ranked r JOIN decided d USING (page, a) WHERE rn <= 3 AND status <> 'fuzzy_parish'
    UNION ALL SELECT DISTINCT 'Nation' || c_nationkey, lower(c_mktsegment), 'no_gv_rows', NULL, NULL, '' FROM customer""",
)
def review_of_open_pages(spark, folder):
    rows, truth = _open_pages(spark, folder)
    review = resolve_admin(rows, truth, ["id"], hash_salt(["id"]))[1]
    return review.select("page_name", "llm_parish_norm", "status", "candidate_rank", "score", "parish")


@case(
    "chain_components",
    "SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id) AS component FROM events QUALIFY count(*) OVER (PARTITION BY user_id) > 1",
)
def components_of_user_chains(spark, folder):
    """The events of a user as one chain in an order that has nothing to do with their numbers."""
    events = table(spark, folder, "events").select("event_id", "user_id")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string"))))
    return connected_components(events.select(before.alias("a"), F.col("event_id").alias("b")).filter("a IS NOT NULL"))


@case(
    "similar_pairs",
    f"""
    WITH n AS (SELECT DISTINCT p_brand, p_name FROM part),
    p AS (SELECT x.p_brand, x.p_name AS a, y.p_name AS b FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.p_name < y.p_name)
    SELECT p_brand, a AS name_a, b AS name_b, round({INDEL_SQL}, 6) AS similarity FROM p WHERE {INDEL_SQL} * 100.0 >= 77.0""",
)
def similar_part_names(spark, folder):
    pairs = similar_pairs(table(spark, folder, "part"), ["p_brand"], "p_name", 0.77)
    return pairs.withColumn("similarity", F.round("similarity", 6))


# Matched characters of columns a and b by the longest common block, first in a, then in b, and so on left and right of it.
_BLOCKS_SQL = """
grid AS (SELECT p, a, b, i, unnest(range(1, length(b) + 1)) AS j FROM (SELECT p, a, b, unnest(range(1, length(a) + 1)) AS i FROM close)),
runs AS (
  SELECT p, i, j, (SELECT max(k) FROM (SELECT unnest(range(1, least(length(a) - i, length(b) - j) + 2)) AS k) WHERE a[i:i + k - 1] = b[j:j + k - 1]) AS size
  FROM grid WHERE a[i] = b[j]),
parts AS (
  SELECT p, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, CAST(0 AS BIGINT) AS size FROM close
  UNION ALL
  SELECT f.p, unnest([f.alo, f.i + f.k]), unnest([f.i, f.ahi]), unnest([f.blo, f.j + f.k]), unnest([f.j, f.bhi]), unnest([f.k, 0])
  FROM (
    SELECT s.p, s.alo, s.ahi, s.blo, s.bhi, r.i, r.j, least(r.size, s.ahi - r.i, s.bhi - r.j) AS k
    FROM parts s JOIN runs r ON r.p = s.p AND r.i >= s.alo AND r.i < s.ahi AND r.j >= s.blo AND r.j < s.bhi
    QUALIFY row_number() OVER (PARTITION BY s.p, s.alo, s.ahi, s.blo, s.bhi ORDER BY k DESC, r.i, r.j) = 1) f),
matched AS (SELECT p, sum(size) AS m FROM parts GROUP BY p)
"""


@case(
    "similar_pairs_difflib",
    f"""
    WITH RECURSIVE n AS (SELECT DISTINCT p_brand, p_name FROM part),
    near AS (SELECT x.p_brand, x.p_name AS a, y.p_name AS b FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.p_name < y.p_name),
    forms AS MATERIALIZED (SELECT a, b, row_number() OVER () AS p FROM (SELECT DISTINCT a, b FROM near)),
    close AS MATERIALIZED (SELECT * FROM forms WHERE {INDEL_SQL} * 100.0 >= 80.0), {_BLOCKS_SQL},
    scored AS (SELECT a, b, 2.0::DOUBLE * m::DOUBLE / (length(a) + length(b)) AS ratio FROM close JOIN matched USING (p))
    SELECT p_brand, a AS name_a, b AS name_b, round(ratio, 6) AS similarity FROM near JOIN scored USING (a, b) WHERE ratio * 100.0 >= 80.0""",
)
def similar_part_names_difflib(spark, folder):
    pairs = similar_pairs(table(spark, folder, "part"), ["p_brand"], "p_name", 0.8, method="difflib")
    return pairs.withColumn("similarity", F.round("similarity", 6))


@case(
    "best_match",
    f"""
    WITH w AS (SELECT DISTINCT p_brand, {_GARBLED} AS a FROM part),
    c AS (SELECT p_brand, p_name AS b, min(p_partkey) AS pos FROM part GROUP BY 1, 2),
    s AS (SELECT p_brand, a, b, pos, {INDEL_SQL} AS score FROM w JOIN c USING (p_brand)),
    best AS (SELECT * FROM s WHERE score * 100.0 >= 70.0 QUALIFY row_number() OVER (PARTITION BY p_brand, a ORDER BY score DESC, pos) = 1)
    SELECT w.p_brand, w.a AS wanted, b AS matched, round(score, 6) AS score FROM w LEFT JOIN best ON best.p_brand = w.p_brand AND best.a = w.a""",
)
def best_part_names(spark, folder):
    parts = table(spark, folder, "part")
    wanted = parts.select("p_brand", garbled().alias("wanted"))
    offered = parts.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("pos"))
    found = best_match(wanted, offered, ["p_brand"], "wanted", "p_name", "pos", 0.70)
    return found.withColumn("score", F.round("score", 6))


@case(
    "canonical_entities",
    f"""
    WITH RECURSIVE n AS (SELECT DISTINCT p_brand, p_name FROM part),
    p AS (SELECT x.p_brand, x.p_name AS a, y.p_name AS b FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.p_name <> y.p_name),
    e AS (SELECT p_brand, a, b FROM p WHERE {INDEL_SQL} * 100.0 >= 80.0),
    reach AS (
      SELECT p_brand, p_name AS a, p_name AS b FROM n
      UNION SELECT r.p_brand, r.a, e.b FROM reach r JOIN e ON e.p_brand = r.p_brand AND e.a = r.b),
    canon AS (SELECT p_brand, a, min(b) AS c FROM reach GROUP BY 1, 2)
    SELECT p_partkey, c AS townland_canonical FROM part JOIN canon ON canon.p_brand = part.p_brand AND a = p_name""",
)
def canonical_part_names(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    found = add_canonical(parts, ["p_brand"], "p_name", threshold=0.8, salt=hash_salt(["p_partkey"]))
    return found.select("p_partkey", "townland_canonical")


_LINK_SQL = f"""{LEDGER_SQL},
    numbered AS (SELECT *, dense_rank() OVER (ORDER BY page_name) AS page_no FROM seq),
    firsts AS (
      SELECT page_no, arg_min(name, grn) FILTER (name <> '') AS first_name, arg_max(name, grn) FILTER (name <> '') AS last_name,
             max(grn) FILTER (name <> '') AS last_grn, arg_min(lower(name), grn) AS top, any_value(user_id) AS user_id
      FROM numbered GROUP BY 1),
    leads AS (
      SELECT n.page_no, min(n.grn) FILTER (lower(n.name) IS DISTINCT FROM lower(first_name)) AS stop
      FROM numbered n JOIN firsts f USING (page_no) GROUP BY 1),
    pages AS (
      SELECT f.*, coalesce(stop, 1e18::BIGINT) AS stop,
             coalesce(top = lower(first_name) AND lag(user_id) OVER w = user_id AND lower(lag(last_name) OVER w) = lower(first_name), false) AS linked,
             coalesce(last_grn < coalesce(stop, 1e18::BIGINT), false) AS passes
      FROM firsts f JOIN leads USING (page_no) WINDOW w AS (ORDER BY page_no)),
    chains AS (SELECT *, sum(CASE WHEN linked AND passes THEN 0 ELSE 1 END) OVER (ORDER BY page_no) AS chain FROM pages),
    sent AS (SELECT *, first_value(last_name) OVER (PARTITION BY chain ORDER BY page_no) AS out_name FROM chains),
    taken AS (SELECT page_no, stop, CASE WHEN linked THEN lag(out_name) OVER (ORDER BY page_no) END AS taken FROM sent),
    linked_seq AS (
      SELECT * REPLACE (CASE WHEN taken IS NOT NULL AND grn < stop THEN taken ELSE name END AS name) FROM numbered JOIN taken USING (page_no))"""


@case("page_link", f"WITH {_LINK_SQL} SELECT event_id, name AS townland_linked FROM linked_seq")
def link_ledger_pages(spark, folder):
    rows = ordered_ledger(spark, folder)
    return link_pages(rows, 0.77, label="name").select("event_id", "townland_linked")


_LINKED_CHECKS_SQL = CHECKS_SQL.removeprefix(LEDGER_SQL).replace("FROM seq WINDOW", "FROM linked_seq WINDOW")


@case(
    "ledger_analysis",
    f"""WITH {_LINK_SQL} {_LINKED_CHECKS_SQL},
    one AS (SELECT parish_effective, name, true AS single FROM linked_seq WHERE name <> '' GROUP BY ALL HAVING count(DISTINCT page_name) = 1),
    flagged AS (SELECT c.*, coalesce(single, false) AS single FROM checks c LEFT JOIN one ON one.parish_effective = c.parish_effective AND one.name = c.townland_linked)
    SELECT 'events' AS llm, (SELECT count(DISTINCT page_name) FROM ledger) AS pages_processed, (SELECT count(*) FROM ledger) AS entry_rows,
           count(*) AS townland_segments, count(*) FILTER (has_total_row) AS segments_with_total_row, count(*) FILTER (valuation_ok) AS valuation_pass_count,
           count(*) FILTER (single) AS one_page_townlands_segments, count(*) FILTER (NOT single) AS multi_page_townlands_segments,
           CAST(0 AS BIGINT) AS pages_missing_gv_join, CAST(0 AS BIGINT) AS gv_join_review_rows
    FROM flagged""",
)
def analyse_ledger(spark, folder):
    """The whole analysis, from unordered rows and a truth table to the summary."""
    return _ledger_analysis(ledger(spark, folder)).summary.select(
        "llm", "pages_processed", "entry_rows", "townland_segments", "segments_with_total_row", "valuation_pass_count",
        "one_page_townlands_segments", "multi_page_townlands_segments", "pages_missing_gv_join", "gv_join_review_rows",
    )


def _ledger_analysis(events):
    """``analyse_rows`` on ledger rows; the truth table lists every page with its own scope."""
    no_text = F.lit(None).cast("string")
    truth = events.select(
        "target_filename", F.col("county_effective").alias("county"), no_text.alias("county_gv"), F.col("barony_effective").alias("barony"),
        no_text.alias("barony_gv"), F.concat(F.lit("PARISH OF "), "parish_effective").alias("parish"), F.col("parish_effective").alias("parish_gv"),
        no_text.alias("townland"), F.lit(0).alias("row_no"),
    ).distinct()
    rows = events.select(
        "event_id", "page_name", "target_filename", F.lit("events").alias("llm"), F.lit(0).alias("parish_idx"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("entry_idx"), F.col("parish_effective").alias("parish"),
        F.col("name").alias("townland_filled"), "land_val", "total_val", "is_total", "occupier",
    )
    nothing = events.sparkSession.createDataFrame([], "page_name string, llm string, status string, text string")
    return analyse_rows(rows, nothing, materialize(truth), "events")


_CONTINUED_SQL = f"""{LEDGER_SQL},
    starts AS (
      SELECT *, CASE WHEN name = '' THEN 0 WHEN lag(name) OVER w = name THEN 0 ELSE 1 END AS s
      FROM seq WINDOW w AS (PARTITION BY page_name ORDER BY grn)),
    runs AS (SELECT *, sum(s) OVER (PARTITION BY page_name ORDER BY grn) AS r FROM starts),
    heads AS (SELECT page_name, r, arg_min(is_continued, grn) AS cont FROM runs WHERE name <> '' GROUP BY 1, 2),
    lasts AS (SELECT user_id, page_name, arg_max(name, grn) AS last_name FROM seq WHERE name <> '' GROUP BY 1, 2),
    priors AS (SELECT page_name, lag(last_name) OVER (PARTITION BY user_id ORDER BY page_name) AS prior FROM lasts),
    resolved AS (
      SELECT event_id, user_id, page_name,
             CASE WHEN runs.name <> '' AND cont > 0 AND lower(prior) = lower(runs.name) THEN prior ELSE runs.name END AS townland_gv
      FROM runs LEFT JOIN heads USING (page_name, r) LEFT JOIN priors USING (page_name))"""


def _continued_rows(spark, folder):
    return ledger(spark, folder).select(
        "event_id", "ts", "page_name", "is_continued", F.col("name").alias("townland_gv"),
        *[F.col(f"{c}_effective").alias(f"{c}_gv") for c in ("county", "barony", "parish")],
    )


@case("continuation", f"WITH {_CONTINUED_SQL} SELECT event_id, townland_gv FROM resolved")
def continue_ledger_names(spark, folder):
    return resolve_continued(_continued_rows(spark, folder), ["ts", "event_id"]).select("event_id", "townland_gv")


@case(
    "resolve_and_cluster",
    f"WITH {_CONTINUED_SQL} SELECT event_id, townland_gv, lower(townland_gv) AS townland_canonical FROM resolved",
)
def cluster_ledger_names(spark, folder):
    return resolve_and_cluster(_continued_rows(spark, folder), ["ts", "event_id"]).select(
        "event_id", "townland_gv", "townland_canonical"
    )


_ORDER_KEYS = ["l_orderkey"]


def _order_suppliers(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("supplier"), "l_linenumber", "l_partkey")


@case(
    "one_multi_scope",
    "SELECT l_orderkey, count(DISTINCT l_suppkey) AS page_count, count(DISTINCT l_suppkey) = 1 AS is_one_page FROM lineitem GROUP BY 1",
)
def suppliers_per_order(spark, folder):
    return page_scope(_order_suppliers(spark, folder), _ORDER_KEYS, "supplier")


@case(
    "one_page_flags",
    f"""WITH {LEDGER_SQL},
    one AS (SELECT parish_effective, name FROM ledger WHERE name <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_name) = 1)
    SELECT event_id, o.name IS NOT NULL AS is_one_page_townland FROM ledger l LEFT JOIN one o ON o.parish_effective = l.parish_effective AND o.name = l.name""",
)
def flag_ledger_rows(spark, folder):
    return flag_one_page(ledger(spark, folder), hash_salt(["event_id"])).select("event_id", "is_one_page_townland")


def _inventory_sql(test):
    return f"""SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) AS target_filename FROM lineitem
    WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) {test})"""


@case("one_page_inventory", _inventory_sql("= 1"))
def one_supplier_orders(spark, folder):
    return scope_inventory(_order_suppliers(spark, folder), True, _ORDER_KEYS, "supplier")


@case("multi_page_inventory", _inventory_sql("> 1"))
def many_supplier_orders(spark, folder):
    return scope_inventory(_order_suppliers(spark, folder), False, _ORDER_KEYS, "supplier")


@case(
    "entity_summary",
    """SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ', ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS pages,
           count(DISTINCT l_suppkey) AS page_count, count(DISTINCT l_suppkey) = 1 AS is_one_page FROM lineitem GROUP BY 1""",
)
def summarise_order_suppliers(spark, folder):
    rows = _order_suppliers(spark, folder)
    pages = entity_pages(rows, _ORDER_KEYS, "supplier")
    return with_page_cell(entity_summary(rows, _ORDER_KEYS, "supplier"), pages, _ORDER_KEYS, "supplier", "pages", ", ")


@case(
    "pages_to_check",
    """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS supplier FROM lineitem
    WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)""",
)
def suppliers_to_check(spark, folder):
    return pages_to_check(_order_suppliers(spark, folder), _ORDER_KEYS, "supplier")
