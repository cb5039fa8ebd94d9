"""Writers. Each is one distributed write of a DataFrame; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.documents import FLAG_DEFAULTS, TEXT_FIELDS
from ledgerline.functions.payload import request_line
from ledgerline.functions.text import to_int

SHOWN_LEVELS = ("townland", "sublocation_1", "sublocation_2")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line in every file, also when there are no rows; text keeps its outer blanks."""
    df.write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3/K5-K7: JSON lines that keep empty fields."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def with_page_cell(
    df: DataFrame, pages: DataFrame, keys: Sequence[str], page: str, name: str, separator: str = ","
) -> DataFrame:
    """A1/A3 as files show them: the distinct pages of each row's group, sorted, in one text cell.

    ``pages`` is the long form (keys, page). Only for a file that wants such a cell: it grows with the group.
    """
    cells = pages.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(page)), separator).alias(name))
    return df.join(cells, list(keys), "left").withColumn(name, F.coalesce(name, F.lit("")))


def with_whole_flags(df: DataFrame) -> DataFrame:
    """K1: flags as BIGINT, unreadable ones 0."""
    return df.withColumns({c: to_int(c, 0).cast("bigint") for c in FLAG_DEFAULTS if c in df.columns})


def write_combined(df: DataFrame, path: str, model: str = "llm", mode: str = "overwrite") -> None:
    """K1: combined table as Parquet (by model) and CSV."""
    with_whole_flags(df).write.mode(mode).partitionBy(model).parquet(f"{path}/parquet")
    write_csv(df, f"{path}/csv", mode)


def page_display(rows: DataFrame) -> DataFrame:
    """K8: page tables with repeated names shown once, in document order.

    A page is one document that a task has held as a single record, so its blocks are bounded windows
    (``fill_names`` has the rows in these partitions already). ``suppress_repeats`` does the same for groups without such a bound.
    """
    block = Window.partitionBy("page_name", "parish_idx").orderBy("entry_idx")
    shown = rows.withColumn("townland", F.col("townland_raw"))
    changed = F.row_number().over(block) == 1
    for level in SHOWN_LEVELS:
        changed = changed | ~F.lag(level).over(block).eqNullSafe(F.col(level))
        text = F.coalesce(F.col(level).cast("string"), F.lit(""))
        shown = shown.withColumn(f"shown_{level}", F.when(changed, text).otherwise(""))
    columns = ["page_name", "parish_idx", "entry_idx", "parish"]
    columns += [F.col(f"shown_{c}").alias(c) if c in SHOWN_LEVELS else F.col(c) for c in TEXT_FIELDS]
    return shown.select(*columns, *FLAG_DEFAULTS)


def write_page_display(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K8: CSV sorted by page over all files, rows in document order, with the page's name as a column."""
    order = ["page_name", "parish_idx", "entry_idx"]
    shown = page_display(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    write_csv(shown.drop("parish_idx", "entry_idx"), path, mode)


def request_rows(
    jobs: DataFrame, layout: str, prompt: str, base_url: str | None = None, model: str = "",
    images: DataFrame | None = None,
) -> DataFrame:
    """Jobs with public_url and the request line; ``images`` (path, content) makes them inline."""
    if base_url is not None:
        url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("r2_key"))
        line = request_line(layout, F.col("custom_id"), url, prompt, model)
        return jobs.withColumns({"public_url": url, "request": line})
    if images is None:
        raise ValueError("give base_url or images")
    content = images.select(F.col("path").alias("local_path"), F.base64("content").alias("_b64"))
    joined = jobs.join(content, "local_path", "left")
    present = F.when(F.col("_b64").isNotNull(), F.col("_b64")).otherwise(
        F.raise_error(F.concat(F.lit("missing image: "), F.col("local_path"))).cast("string")
    )
    line = request_line(layout, F.col("custom_id"), present, prompt, model, inline=True)
    return joined.withColumns({"public_url": F.lit(None).cast("string"), "request": line}).drop("_b64")


def write_requests(requests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K9: one request per line."""
    requests.select("request").write.mode(mode).text(path)


def manifest_rows(requests: DataFrame, **run: str) -> DataFrame:
    """One row per job with the run's settings beside it."""
    settings = {k: F.lit(v) for k, v in run.items()}
    return requests.select(
        "custom_id", "local_path", "r2_key", "public_url", *[v.alias(k) for k, v in settings.items()]
    )


def write_documents(finalised: DataFrame, path: str, provider: str, mode: str = "append") -> None:
    """One row per page document, by model."""
    done = finalised.filter("status = 'written'").select("page_file", "document", F.lit(provider).alias("llm"))
    done.write.mode(mode).partitionBy("llm").json(path)


def append_failures(records: DataFrame, path: str) -> None:
    """Append failure records, stamped now unless they carry a time."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    kept: Column = F.coalesce(F.col("ts"), stamp) if "ts" in records.columns else stamp
    write_json(records.withColumn("ts", kept), path, mode="append")
