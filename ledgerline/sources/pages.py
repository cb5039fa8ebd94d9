"""Scan page documents and flatten them to rows in document order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.functions.documents import FLAG_DEFAULTS, TEXT_FIELDS, can_flatten, is_marked_strict, is_whole, marked_json, raw_blocks, typed_document
from ledgerline.functions.text import clean_key, trim_text, with_once
from ledgerline.storage import materialize, materialize_counted

PAGE_GLOB = "*.jpg.json"
ROW_ORDER = ("page_name", "parish_idx", "entry_idx")


def scan_pages(spark: SparkSession, folder: str, model: str, glob: str = PAGE_GLOB) -> DataFrame:
    """One row per file: page_name, target_filename, llm, text, status and, if usable, the document.

    ``status`` is ok, empty, malformed, unflattenable or no_rows; rows that
    are not ok form the quarantine.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=glob)
    page = F.replace(F.col("_metadata.file_name"), F.lit(".json"), F.lit(""))
    return read_documents(files.select(page.alias("page_name"), F.col("value").alias("text")), model)


def read_documents(texts: DataFrame, model: str, page: str = "page_name", text: str = "text") -> DataFrame:
    """Classify and type page texts that are already in a table."""
    docs = texts.select(F.col(page).alias("page_name"), trim_text(text).alias("text"))
    docs = with_once(docs, _marked=marked_json(F.col("text")), _blocks=raw_blocks(F.col("text")))
    docs = docs.withColumn("_strict", is_marked_strict(F.col("_marked"), F.col("text")))
    # the few documents that the typed fields do not hold in full are looked at piece by piece
    whole = F.when(F.col("_strict"), is_whole(F.col("_blocks")) | can_flatten(F.try_variant_get("_marked", "$[0]", "variant")))
    docs = with_once(docs, _flat=whole)
    docs = with_once(docs.drop("_marked"), document=F.when(F.col("_flat"), typed_document(F.col("_blocks"))))
    entries = F.aggregate("document", F.lit(0), lambda n, p: n + F.size(p["entries"]))
    status = (
        F.when(F.col("text") == "", "empty")
        .when(~F.col("_strict"), "malformed")
        .when(~F.col("_flat"), "unflattenable")
        .when(entries == 0, "no_rows")
        .otherwise("ok")
    )
    return docs.select(
        "page_name", F.col("page_name").alias("target_filename"), F.lit(model).alias("llm"), "text",
        status.alias("status"), "document",
    )


def flatten_documents(docs: DataFrame) -> DataFrame:
    """One row per entry with its ordinals, without fill."""
    # Unusable pages have no document. The outer form keeps the optimizer from
    # testing the document before the explode, which would parse every text twice.
    blocks = docs.select(
        "page_name", "target_filename", "llm", F.posexplode_outer("document").alias("parish_idx", "_p")
    )
    entries = blocks.select(
        "page_name", "target_filename", "llm", "parish_idx", F.col("_p.parish").alias("parish"),
        F.posexplode_outer("_p.entries").alias("entry_idx", "_e"),
    ).filter("entry_idx is not null")
    return entries.select(
        "page_name", "target_filename", "llm", "parish_idx", "entry_idx", "parish",
        *[F.col(f"_e.{c}") for c in TEXT_FIELDS], *[F.col(f"_e.{c}") for c in FLAG_DEFAULTS],
        F.col("_e.townland").alias("townland_raw"),
    )


def fill_names(rows: DataFrame) -> DataFrame:
    """W1b and W1 on flattened pages: ``townland`` filled per block, ``townland_filled`` per (page, parish).

    A page is one document that one task has already held as a single record,
    so its rows are a bounded window; one exchange on the page serves both.
    Use ``forward_fill`` for groups without such a bound.
    """
    above = (Window.unboundedPreceding, 0)
    block = Window.partitionBy("page_name", "parish_idx").orderBy("entry_idx").rowsBetween(*above)
    label = Window.partitionBy("page_name", "parish").orderBy("parish_idx", "entry_idx").rowsBetween(*above)
    raw, text = F.col("townland_raw"), clean_key("townland_raw")
    down = lambda value, kept, window: F.last(F.when(kept, value), ignorenulls=True).over(window)
    return rows.repartition("page_name").withColumns(
        {
            "townland": down(raw, raw != "", block),
            "townland_filled": F.coalesce(down(text, text != "", label), F.lit("")),
        }
    )


def store_documents(docs: DataFrame) -> tuple[DataFrame, dict]:
    """Write a scan once; the text is kept only where the page goes to quarantine. Also A6, counted by the same job."""
    kept = docs.withColumn("text", F.when(F.col("status") != "ok", F.col("text")))
    return materialize_counted(kept, **_load_measures())


def load_pages(spark: SparkSession, folder: str, model: str, on_counts: Callable[[dict], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(filled rows, quarantine) of a folder of page documents.

    Each file is read once; its text is parsed once for its shape and once into typed fields, and
    kept only where the page goes to quarantine. ``on_counts`` is told A6: pages, entry_rows, skipped.
    """
    docs, counts = store_documents(scan_pages(spark, folder, model))
    if on_counts:
        on_counts(counts)
    quarantine = docs.filter("status <> 'ok'").select("page_name", "llm", "status", "text")
    return fill_names(flatten_documents(docs)), quarantine


def _load_measures() -> dict[str, Column]:
    ok = F.col("status") == "ok"
    rows = F.when(ok, F.aggregate("document", F.lit(0), lambda n, p: n + F.size(p["entries"])))
    return {"pages": F.count_if(ok), "entry_rows": F.coalesce(F.sum(rows), F.lit(0)), "skipped": F.count_if(~ok)}


def load_counts(docs: DataFrame) -> DataFrame:
    """A6 of a scan that is already stored: pages, rows and skipped files. ``store_documents`` counts them while it writes."""
    return docs.agg(*[c.alias(name) for name, c in _load_measures().items()])
