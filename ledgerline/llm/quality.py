"""Quality rules with cross-document line frequency, in native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.llm.base import WORD_SEPARATORS, case, table
from ledgerline.llm.lines import normal_line
from ledgerline.storage import materialize

NOT_SYMBOLS = "[^#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
MAX_DOCS_PER_HOST = 10  # a line in more documents of one host is removed
MIN_LEFT = 0.5  # a document that keeps a smaller share of its words is depleted


def words_of(text: Column) -> Column:
    """Array of words; empty for a text without a word."""
    trimmed = F.btrim(text, F.lit(WORD_SEPARATORS))
    return F.when(trimmed != "", F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def base_signals(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """Counts of every whole text, and its lines with a word as (hash, words).

    One row per input row: doc_id, _host, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, _lines. A null text counts as empty and has
    zero everywhere. Repeated windows: texts that hold two equal window hashes sort
    (hash, start) and count the union of the windows found more than once.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    rows = rows.withColumns(
        {
            "_words": words_of(F.col("_text")),
            "_with_word": F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SEPARATORS)) != ""),
        }
    )
    w = F.col("_words")
    grams = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    )
    rows = rows.withColumn("_grams", F.when(F.size(w) > WINDOW, grams).otherwise(F.array().cast("array<bigint>")))
    g = F.col("_grams")
    placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(F.size(F.array_distinct(g)) < F.size(g), placed))
    p = F.col("_placed")
    again = lambda x, k: F.coalesce(x["h"] == F.get(p, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, k + 1)["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter(p, again), lambda x: x["i"]))
    rows = rows.withColumn("_starts", starts)
    s = F.col("_starts")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(s) - 1),
        F.lit(0),
        lambda n, k: n + F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - F.get(s, k), F.lit(WINDOW))),
    )
    counts = F.transform(
        F.transform("_with_word", normal_line),
        lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")),
    )
    return rows.select(
        "doc_id",
        "_host",
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", NOT_SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        (F.size("_with_word") - F.size(F.array_distinct("_with_word"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.when(F.size(s) > 0, covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        counts.alias("_lines"),
    )


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_docs: int = MAX_DOCS_PER_HOST,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Base rules, then line frequency per host: doc_id, the counts, base_failed, n_line_words_removed, kept.

    A normalised line that more than ``max_docs`` documents (rows) of one host
    hold is removed; a document left with less than ``min_left`` of its words is
    rejected. Every input row gives one row. Null or empty texts fail the base
    rules; a null host is a host of its own; repeated rows count as documents.
    """
    base = base_signals(docs, doc_id, text, host).withColumn("_row", F.monotonically_increasing_id())
    base = materialize(base)  # the text is read and cut once; row numbers are fixed
    hosted = base.select("_row", F.xxhash64("_host").alias("_host"), "_lines")
    distinct_lines = hosted.select("_host", F.explode(F.array_distinct("_lines.h")).alias("_h"))
    frequent = distinct_lines.groupBy("_host", "_h").agg(F.count("*").alias("_docs")).filter(F.col("_docs") > max_docs)
    lines = hosted.select("_row", "_host", F.inline("_lines").alias("_h", "_n"))
    removed = lines.join(frequent.drop("_docs"), ["_host", "_h"]).groupBy("_row").agg(F.sum("_n").alias("_gone"))
    n, gone = F.col("n_words"), F.coalesce("_gone", F.lit(0)).cast("bigint")
    failed = (n < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return base.join(removed, "_row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.alias("n_line_words_removed"), failed.alias("base_failed"), (~failed & (n - gone >= min_left * n)).alias("kept"),
    )


OP7_SQL = rf"""
WITH cut AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS times
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM cut WHERE len(ws) >= 3)),
repeats AS (
  SELECT doc_id, count(DISTINCT pos) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM grams WHERE times > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS form
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM cut)),
filled AS (SELECT *, length(form) - length(replace(form, ' ', '')) + 1 AS n FROM lines WHERE form <> ''),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM filled GROUP BY doc_id),
frequent AS (SELECT source, form FROM filled GROUP BY source, form HAVING count(DISTINCT doc_id) > {MAX_DOCS_PER_HOST}),
gone AS (
  SELECT doc_id, sum(n) AS n FROM filled l JOIN frequent f ON l.form = f.form AND l.source IS NOT DISTINCT FROM f.source
  GROUP BY doc_id),
counted AS (
  SELECT c.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(g.n, 0) AS BIGINT) AS n_line_words_removed
  FROM cut c LEFT JOIN dups d USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN gone g USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND n_words - n_line_words_removed >= {MIN_LEFT} * n_words AS kept
FROM counted
"""


@case("op7_quality_rules", OP7_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and repetition counts of every document and the verdict of the line rule."""
    return quality_rules(table(spark, sf_dir, "documents"))
