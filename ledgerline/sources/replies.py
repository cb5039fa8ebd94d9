"""Scan stored batch replies of the two layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.functions.text import trim_text
from ledgerline.operators.dedupe import keep_last

_FALSY = ("", "null", "{}", "[]", "0", "false")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with an order that does not depend on how files are packed into partitions."""
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_order"),
    )
    return lines.filter(trim_text("value") != "")


def _once(df: DataFrame, *columns: Column, keep: tuple[str, ...]) -> DataFrame:
    """The columns, each evaluated once a line: no later step can pull their expressions over the generator."""
    return df.select(F.inline(F.array(F.struct(*columns))), *keep)


def _parsed(lines: DataFrame, line: str, order: str) -> DataFrame:
    """(value, line_order), each line parsed once."""
    return lines.select(F.explode(F.array(F.try_parse_json(line))).alias("value"), F.col(order).alias("line_order"))


def _id(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string").alias("custom_id")


def _as_rows(parts: DataFrame, text: Column, problem: Column) -> DataFrame:
    """The reply columns as rows, the text of those without a problem; a filter on them stays behind it."""
    rows = _once(parts, problem.alias("error"), keep=tuple(parts.columns))
    shown = _once(rows, F.when(F.col("error").isNull(), text).alias("text"), keep=("custom_id", "error", "line_order"))
    return shown.select("custom_id", "text", "error", "line_order")


def _truthy(value: Column) -> Column:
    return ~F.coalesce(value.cast("string"), F.lit("")).isin(*_FALSY)


def _part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def parse_chat_replies(lines: DataFrame, line: str = "value", order: str = "line_order") -> DataFrame:
    """Form A: id, text, error (JSON or message), order; text and error may both be null for empty replies.

    A content shows that there are a response and a body; only without one are they looked at, which writes them out as text.
    """
    lines, value = _parsed(lines, line, order), F.col("value")
    content, error = _part(value, "$.response.body.choices[0].message.content"), _part(value, "$.error")
    parts = _once(lines, _id(value, "$.custom_id"), content.alias("content"), error.alias("failed"), keep=("value", "line_order"))
    response, body = _part(value, "$.response"), _part(value, "$.response.body")
    problem = (
        F.when(value.isNull(), "malformed line")
        .when(_truthy(F.col("failed")), F.to_json("failed"))
        .when(F.col("content").isNotNull(), F.lit(None))
        .when(~_truthy(response), "no response field")
        .when(~_truthy(body), "no response.body")
        .otherwise("parse choices")
    )
    return _as_rows(parts, F.try_variant_get("content", "$", "string"), problem)


def parse_generate_replies(lines: DataFrame, line: str = "value", order: str = "line_order") -> DataFrame:
    """Form B: all text parts of the first candidate, joined; the response may sit under either name.

    Parts show that there is a response; only without them is it looked at, which writes it out as text.
    """
    lines, value = _parsed(lines, line, order), F.col("value")
    first, second, error = _part(value, "$.response"), _part(value, "$.generateContentResponse"), _part(value, "$.error")
    response = F.when(F.coalesce(first.cast("string"), F.lit("null")) != "null", first).otherwise(second)
    listed = lambda v, path: F.try_variant_get(v, f"{path}.candidates[0].content.parts", "array<variant>")
    found = F.coalesce(listed(value, "$.response"), listed(response, "$"))
    parts = _once(lines, _id(value, "$.key"), found.alias("parts"), error.alias("failed"), keep=("value", "line_order"))
    texts = F.transform("parts", lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    problem = (
        F.when(value.isNull(), "malformed line")
        .when(_truthy(F.col("failed")), F.to_json("failed"))
        .when(F.col("parts").isNotNull(), F.lit(None))
        .when(~_truthy(response), "no response")
        .otherwise("parse response")
    )
    return _as_rows(parts, F.array_join(texts, ""), problem)


def latest_replies(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one text per id, the later line wins; rows for the dead-letter table)."""
    usable = parsed.filter("error is null and custom_id <> '' and text <> ''")
    good = keep_last(usable.select("custom_id", "text", "line_order"), ["custom_id"], "line_order")
    return good.select("custom_id", "text"), parsed.filter("error is not null").select("custom_id", "error")
