"""Collect file names and image jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.functions.text import (
    IMAGE_SUFFIX_PATTERN, basename, image_path, is_content_line, trim_text,
)
from ledgerline.operators.dedupe import keep_last

NAME = "target_filename"


def _names(df: DataFrame, value: Column) -> DataFrame:
    return df.select(basename(value).alias(NAME)).filter(F.col(NAME) != "")


def names_from_json(spark: SparkSession, path: str) -> DataFrame:
    """S6 of the files at a path; the driver lists them. Many small files are better kept as ``page_files``."""
    return names_in_json(spark.read.text(path, wholetext=True), "value", path)


def names_in_json(texts: DataFrame, text: str = "value", place: str = "a text") -> DataFrame:
    """A list of names, a list of {target_filename}, or one such object; other shapes fail."""
    value = F.try_parse_json(text)
    listed = F.try_variant_get(value, "$", "array<variant>")
    single = F.try_variant_get(value, "$.target_filename", "variant")
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    items = F.when(listed.isNotNull(), listed).when(is_object & single.isNotNull(), F.array(value))
    items = F.coalesce(items, F.raise_error(F.lit(f"unsupported JSON shape in {place}")).cast("array<variant>"))
    files = texts.select(F.explode(items).alias("item"))
    plain = F.when(F.schema_of_variant("item") == "STRING", F.col("item").cast("string"))
    nested = F.when(
        F.schema_of_variant("item").startswith("OBJECT"), F.try_variant_get("item", "$.target_filename", "string")
    )
    return _names(files, F.coalesce(plain, nested))


def names_from_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """One name per line; blank lines and # comments are dropped."""
    return _names(lines.filter(is_content_line(line)), F.col(line))


def names_from_list(spark: SparkSession, path: str) -> DataFrame:
    return names_from_lines(spark.read.text(path))


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Every image below a folder as (path, length); file content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length").filter(F.col("path").rlike(IMAGE_SUFFIX_PATTERN))


def names_from_scan(spark: SparkSession, root: str) -> DataFrame:
    return _names(list_images(spark, root), F.col("path"))


def image_listing(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, key, length); the key is the path below ``base``. Sort by key at the sink."""
    files = list_images(spark, root)
    key = F.regexp_replace("path", r"^\w+:/*", "/")
    prefix = base.rstrip("/") + "/"
    key = F.when(key.startswith(prefix), F.substring(key, F.lit(len(prefix) + 1), F.length(key))).otherwise(key)
    return files.select("path", key.alias("key"), "length")


def names_from_table(df: DataFrame, column: str | None = None) -> DataFrame:
    """Names from a table column, by default target_filename; null and blank names are dropped."""
    column = column or NAME
    if column not in df.columns:
        raise ValueError(f"column not found: {column!r}; available: {df.columns}")
    return _names(df.filter(F.col(column).isNotNull()), F.col(column))


def image_jobs(
    sources: Sequence[tuple[DataFrame, str, str]], root: str, existing: DataFrame | None = None
) -> DataFrame:
    """One job per image from several (table, name column, order column) sources.

    Later sources and rows win per custom_id; ``first_at`` keeps the place of
    the first one. A name with a folder keeps it as its path. ``existing``
    (path) holds paths whose key is the path itself; other keys are inferred.
    """
    parts = []
    for number, (df, column, order) in enumerate(sources):
        name = trim_text(column)
        rows = df.select(
            name.alias("name"),
            F.struct(F.lit(number).alias("source"), F.col(order).cast("bigint").alias("row")).alias("place"),
        )
        parts.append(rows.filter(is_content_line("name")))
    jobs = reduce(DataFrame.unionByName, parts)
    has_folder = F.col("name").contains("/")
    jobs = jobs.select(
        basename("name").alias("custom_id"),
        F.when(has_folder, F.col("name")).otherwise(image_path("name", root)).alias("local_path"),
        "place",
    )
    inferred = image_path("custom_id", root)
    jobs = keep_last(jobs, ["custom_id"], "place")
    if existing is None:
        return jobs.select("custom_id", "local_path", inferred.alias("r2_key"), "first_at")
    found = existing.select(F.col("path").alias("local_path"), F.lit(True).alias("_found")).distinct()
    jobs = jobs.join(found, "local_path", "left")
    key = F.when(F.col("_found"), F.col("local_path")).otherwise(inferred)
    return jobs.select("custom_id", "local_path", key.alias("r2_key"), "first_at")
