"""Line dedup by the number of distinct sites a line is spread over, in native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.llm.base import case, table
from ledgerline.storage import materialize

MIN_SITES = 5  # a line on this many sites is boilerplate
SKETCH_LG_K = 12
NEAR = 0.25  # estimates within this share of the limit are counted exactly


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; '' for a line without a word."""
    return F.btrim(F.regexp_replace(F.lower(line), "[\\x20\\x09-\\x0D]+", " "))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column) -> Column:
    """Hash of each normalised line in order; null for a line without a word."""
    return F.transform(
        F.transform(text_lines(text), normal_line), lambda x: F.when(x != "", F.xxhash64(x))
    )


def spread_lines(
    lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR, lg_k: int = SKETCH_LG_K
) -> DataFrame:
    """Line hashes found on at least ``min_sites`` distinct sites, with the smallest document that has them.

    ``lines`` has one row per document and distinct line: _h, _site, _doc.
    HyperLogLog sketches merge by aggregation, map side first. Hashes whose
    estimate lies within ``near`` of the limit are counted exactly, so the
    answer does not depend on the sketch error. Null sites count as no site.
    """
    found = lines.groupBy("_h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("_site", lg_k)).alias("_estimate"), F.min("_doc").alias("_first")
    )
    found = materialize(found.filter(F.col("_estimate") >= min_sites * (1 - near)))
    unsure = found.filter(F.col("_estimate") <= min_sites * (1 + near)).select("_h", "_first")
    exact = (
        lines.join(unsure, "_h").select("_h", "_first", "_site").distinct()
        .groupBy("_h", "_first").agg(F.count("_site").alias("_n"))
        .filter(F.col("_n") >= min_sites).select("_h", "_first")
    )
    sure = found.filter(F.col("_estimate") > min_sites * (1 + near)).select("_h", "_first")
    return sure.unionByName(exact)


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    near: float = NEAR,
    lg_k: int = SKETCH_LG_K,
    keep_first: bool = True,
) -> DataFrame:
    """Remove lines that are spread over many sites; all rows and columns stay.

    Lines are compared in normal form. The document with the smallest id that
    has a spread line keeps it, so no passage leaves the corpus (False removes it
    there too). Added: n_lines, n_removed (long). A null text stays null with
    0 lines; an empty text is one line; lines without a word stay; rows with a
    null id or site are treated like others (a null site is no site, a null id
    is never the first). Repeated rows lose the same lines. Columns of these
    names in the input are replaced.
    """
    clashing = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    rows = docs.drop(*clashing)
    own = rows.select(
        F.col(doc_id).alias("_doc"), F.col(site).cast("string").alias("_site"), F.xxhash64(text).alias("_text_key"),
        line_hashes(F.col(text)).alias("_hashes"),
    )
    own = materialize(own.filter(F.exists("_hashes", lambda h: h.isNotNull())))
    distinct_lines = own.select(
        "_doc", "_site", F.explode(F.array_compact(F.array_distinct("_hashes"))).alias("_h")
    )
    spread = spread_lines(distinct_lines, min_sites, near, lg_k)
    placed = own.select("_doc", "_text_key", F.posexplode("_hashes").alias("_pos", "_h")).filter("_h IS NOT NULL")
    hit = placed.join(spread, "_h")
    if keep_first:
        hit = hit.filter(~F.col("_doc").eqNullSafe(F.col("_first")))
    removed = hit.groupBy("_doc", "_text_key").agg(F.array_sort(F.collect_set("_pos")).alias("_removed"))
    keyed = rows.withColumn("_text_key", F.xxhash64(text))
    joined = keyed.alias("d").join(
        removed.alias("r"),
        F.col(f"d.{doc_id}").eqNullSafe(F.col("r._doc")) & (F.col("d._text_key") == F.col("r._text_key")), "left",
    )
    joined = joined.select("d.*", "r._removed").withColumn("_lines", F.when(F.col(text).isNotNull(), text_lines(F.col(text))))
    return joined.select(
        *[F.when(F.col("_removed").isNull(), F.col(text)).otherwise(F.array_join(_without("_lines", "_removed"), "\n")).alias(text) if c == text else F.col(c) for c in rows.columns],
        F.coalesce(F.size("_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def _without(items: str, removed: str) -> Column:
    """The array without the (sorted) positions: the slices between them, in one pass."""
    r = F.col(removed)
    between = F.transform(
        F.sequence(F.lit(0), F.size(r)),
        lambda j: F.slice(
            F.col(items),
            F.coalesce(F.get(r, j - 1), F.lit(-1)) + 2,
            F.coalesce(F.get(r, j), F.size(items)) - F.coalesce(F.get(r, j - 1), F.lit(-1)) - 1,
        ),
    )
    return F.flatten(between)


OP4_SQL = rf"""
WITH cut AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
normal AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS form FROM cut),
spread AS (
  SELECT form, min(doc_id) AS first_doc FROM normal WHERE form <> ''
  GROUP BY form HAVING count(DISTINCT source) >= {MIN_SITES}),
judged AS (
  SELECT n.*, s.form IS NOT NULL AND n.doc_id <> s.first_doc AS removed FROM normal n LEFT JOIN spread s USING (form)),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, p.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""


@case("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least five sites share."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")
