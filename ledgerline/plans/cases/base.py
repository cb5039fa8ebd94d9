"""Registry of runnable cases on the benchmark tables, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.functions.text import from_pence
from ledgerline.operators.ordering import BLOCK, ROW, order_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if SQL can express it, the SQL that must give the same rows."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


LEDGER_ORDER = ("page_name", "ts", "event_id")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Events as survey rows: one page per user and day, event types as names, values as money.

    Errors carry a blank name, low values an upper-case one; the ``k`` of the
    properties decides the flags.
    """
    return _survey_rows(_paged_events(spark, folder))


def _paged_events(spark: SparkSession, folder: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1
    page = F.concat(F.lit("EV_LOG_"), F.lpad("user_id", 7, "0"), F.lit("_"), F.lpad(day, 3, "0"), F.lit(".jpg"))
    return table(spark, folder, "events").select("event_id", "ts", "user_id", page.alias("page_name"), "event_type", "value", "props")


def _survey_rows(events: DataFrame) -> DataFrame:
    k, pence = F.col("k"), F.col("pence")
    label = (
        F.when(F.col("event_type") == "error", "").when(F.col("value") < 20, F.upper("event_type")).otherwise(F.col("event_type"))
    )
    order = [c for c in (BLOCK, ROW) if c in events.columns]
    events = events.withColumns({"k": F.get_json_object("props", "$.k").try_cast("int"), "pence": cents("value")})
    events = events.select(
        "event_id",
        "ts",
        "user_id",
        "page_name",
        F.concat(F.lit("c"), F.substring("user_id", -1, 1)).alias("county_effective"),
        F.lit("b").alias("barony_effective"),
        F.concat(F.lit("p"), F.col("user_id")).alias("parish_effective"),
        label.alias("name"),
        from_pence(F.floor(pence / 2)).alias("land_val"),
        from_pence(pence).alias("total_val"),
        F.when(k < 50, "").otherwise(F.concat(F.lit("u"), F.col("user_id"))).alias("occupier"),
        F.when(k >= 90, 1).when(k >= 85, 2).otherwise(0).alias("is_total"),
        F.when(k >= 50, 1).otherwise(0).alias("is_continued"),
        "event_type",
        "k",
        *order,
    )
    return events.withColumns({"target_filename": F.col("page_name"), "townland_linked": F.col("name")})


def ordered_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in order. Its columns are made of the ordered events, so that the exchange and the sampling of its ranges do without them."""
    return _survey_rows(order_rows(_paged_events(spark, folder), LEDGER_ORDER))


LEDGER_SQL = """
base AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CAST(round(value * 100) AS BIGINT) AS pence
  FROM events),
ledger AS (
  SELECT event_id, ts, user_id, event_type, k, pence,
         'EV_LOG_' || lpad(CAST(user_id AS VARCHAR), 7, '0') || '_'
           || lpad(CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS VARCHAR), 3, '0') || '.jpg' AS page_name,
         'c' || right(CAST(user_id AS VARCHAR), 1) AS county_effective,
         'b' AS barony_effective,
         'p' || user_id AS parish_effective,
         CASE WHEN event_type = 'error' THEN '' WHEN value < 20 THEN upper(event_type) ELSE event_type END AS name,
         pence // 2 AS land,
         CASE WHEN k < 50 THEN '' ELSE 'u' || user_id END AS occupier,
         CASE WHEN k >= 90 THEN 1 WHEN k >= 85 THEN 2 ELSE 0 END AS is_total,
         CASE WHEN k >= 50 THEN 1 ELSE 0 END AS is_continued
  FROM base),
seq AS (
  SELECT *, row_number() OVER (ORDER BY page_name, ts, event_id) - 1 AS grn FROM ledger)
"""

RUNS_SQL = (
    LEDGER_SQL
    + """,
starts AS (
  SELECT *, CASE WHEN name = '' THEN 0
                 WHEN lag(name) OVER w = name AND lag(parish_effective) OVER w = parish_effective THEN 0
                 ELSE 1 END AS s
  FROM seq WINDOW w AS (ORDER BY grn)),
runs AS (
  SELECT * EXCLUDE (s), CASE WHEN name = '' THEN NULL ELSE CAST(sum(s) OVER (ORDER BY grn) - 1 AS BIGINT) END AS run_no
  FROM starts)
"""
)


def money_sql(pence: str) -> str:
    """Text 'pounds shillings pence' of a non-negative whole number of pence."""
    return f"(({pence}) // 240) || ' ' || ((({pence}) % 240) // 12) || ' ' || (({pence}) % 12)"


CHECKS_SQL = (
    RUNS_SQL
    + f""",
raw_checks AS (
  SELECT run_no, arg_min(county_effective, grn) AS county_effective, arg_min(barony_effective, grn) AS barony_effective,
         arg_min(parish_effective, grn) AS parish_effective, arg_min(name, grn) AS townland_linked,
         min(grn) AS first_grn, max(grn) AS last_grn,
         count(DISTINCT page_name) AS page_count, string_agg(DISTINCT page_name, ',' ORDER BY page_name) AS page_names,
         count(*) AS row_count, count(*) FILTER (is_total = 1) AS total_row_count,
         CAST(coalesce(sum(land) FILTER (is_total = 0), 0) AS BIGINT) AS sl,
         CAST(coalesce(sum(pence) FILTER (is_total = 0), 0) AS BIGINT) AS st,
         arg_max(land, grn) FILTER (is_total = 1) AS tl, arg_max(pence, grn) FILTER (is_total = 1) AS tt
  FROM runs WHERE run_no IS NOT NULL GROUP BY run_no),
checks AS (
  SELECT *, total_row_count > 0 AS has_total_row,
         coalesce(tl <= 2 * sl AND sl <= 2 * tl AND tt <= 2 * st AND st <= 2 * tt, false) AS valuation_ok,
         CASE WHEN total_row_count > 1 THEN true END AS multiple_total_rows,
         CASE WHEN total_row_count > 0 THEN '' ELSE 'no_total_row' END AS failure_reason,
         CASE WHEN total_row_count > 0 THEN {money_sql('sl')} END AS sum_land_val,
         {money_sql('tl')} AS total_land_val,
         CASE WHEN total_row_count > 0 THEN {money_sql('st')} END AS sum_total_val,
         {money_sql('tt')} AS total_total_val
  FROM raw_checks)
"""
)

REPORT_SQL = (
    CHECKS_SQL
    + f""",
others AS (
  SELECT run_no, grn, occupier, pence, sum(pence) OVER g - pence AS rest, count(*) OVER g AS n,
         grn - min(grn) OVER g AS pos, grn = max(grn) OVER g AS is_last
  FROM runs WHERE run_no IN (SELECT run_no FROM checks WHERE NOT has_total_row)
  WINDOW g AS (PARTITION BY run_no)),
candidates AS (
  SELECT * FROM others
  WHERE n >= 3 AND pence > 0 AND rest > 0 AND pence <= 2 * rest AND rest <= 2 * pence
  QUALIFY row_number() OVER (PARTITION BY run_no ORDER BY abs(pence - rest), grn) = 1),
near AS (
  SELECT c.run_no, o.run_no < c.run_no AS is_prev, o.townland_linked AS neighbor, o.total_row_count AS neighbor_totals
  FROM checks c JOIN checks o ON o.run_no IN (c.run_no - 1, c.run_no + 1)
  WHERE NOT c.has_total_row AND o.has_total_row AND o.parish_effective = c.parish_effective
    AND upper(o.townland_linked) = upper(c.townland_linked)),
neighbours AS (
  SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY run_no ORDER BY is_prev DESC) = 1),
report AS (
  SELECT c.*, CASE WHEN d.run_no IS NOT NULL THEN 'unflagged_total' WHEN n.run_no IS NOT NULL THEN 'split_segment'
                   WHEN row_count <= 2 THEN 'tiny_segment' ELSE 'genuinely_missing' END AS category,
         CASE WHEN d.run_no IS NULL AND n.run_no IS NOT NULL THEN CASE WHEN is_prev THEN 'prev' ELSE 'next' END END AS neighbor_direction,
         CASE WHEN d.run_no IS NULL THEN neighbor END AS neighbor_townland,
         CASE WHEN d.run_no IS NULL THEN neighbor_totals END AS neighbor_total_rows,
         pos AS candidate_row_pos, d.grn AS candidate_grn, is_last AS candidate_is_last_row, d.occupier AS candidate_occupier,
         {money_sql('CAST(d.pence AS BIGINT)')} AS candidate_total_val,
         {money_sql('CAST(d.rest AS BIGINT)')} AS sum_other_rows_total_val
  FROM checks c LEFT JOIN candidates d USING (run_no) LEFT JOIN neighbours n USING (run_no)
  WHERE NOT has_total_row)
"""
)
