"""Turn reply texts into page documents with one status per reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.documents import repair_shape
from ledgerline.functions.salvage import extract_json
from ledgerline.functions.text import result_name
from ledgerline.storage import materialize_counted

STATUSES = ("written", "skipped_existing", "parse_failed", "normalize_failed")


def finalise_replies(replies: DataFrame, existing: DataFrame | None = None, only_missing: bool = False) -> DataFrame:
    """The rows of ``finalise_counted``."""
    return finalise_counted(replies, existing, only_missing)[0]


def finalise_counted(replies: DataFrame, existing: DataFrame | None = None, only_missing: bool = False) -> tuple[DataFrame, dict]:
    """One row per reply (custom_id, text): page file name, status, tier, recovered, document JSON.

    With ``only_missing`` the ids whose page is in ``existing`` (page_file)
    are skipped before any parsing; without it every reply is written again.
    The result is written once: documents and failures read it, and no filter on the status repeats the
    parsing. Beside it A6, gathered by the job that writes: a count per status, and attempted.
    """
    todo = replies.withColumn("page_file", result_name("custom_id")).withColumn("_skip", F.lit(False))
    if only_missing and existing is not None:
        present = existing.select("page_file", F.lit(True).alias("_there")).distinct()
        todo = todo.join(present, "page_file", "left").withColumn("_skip", F.col("_there").isNotNull()).drop("_there")
    todo = todo.withColumn("_text", F.when(~F.col("_skip"), F.col("text")))
    read = extract_json(todo, "_text", "reply")
    shaped = repair_shape(read.withColumn("_json", F.col("reply.json")), "_json", "document")
    status = (
        F.when(F.col("_skip"), "skipped_existing")
        .when(F.col("reply.json").isNull(), "parse_failed")
        .when(F.col("document").isNull(), "normalize_failed")
        .otherwise("written")
    )
    counts = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    result = shaped.select("custom_id", "page_file", status.alias("status"), "reply.tier", "reply.recovered", "document")
    return materialize_counted(result, **counts, attempted=F.count("*"))


def finalise_counts(finalised: DataFrame) -> DataFrame:
    """A6 of a stored result: count per status and attempted, one row. ``finalise_counted`` has them without another pass."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return finalised.agg(*counts, F.count("*").alias("attempted"))


def dead_letters(finalised: DataFrame, provider: str, jobs: DataFrame | None = None) -> DataFrame:
    """Failure records (K12) of the replies that could not be written; ``jobs`` supplies their image path."""
    failed = finalised.filter(F.col("status").isin("parse_failed", "normalize_failed"))
    path = F.col("custom_id")
    if jobs is not None:
        failed = failed.join(jobs.select("custom_id", F.col("local_path").alias("_path")), "custom_id", "left")
        path = F.coalesce("_path", "custom_id")
    error = F.when(F.col("status") == "parse_failed", "no JSON found in reply").otherwise("document shape rejected")
    return failed.select(
        F.lit("finalize").alias("stage"), F.lit(provider).alias("provider"), "custom_id", error.alias("error"),
        path.alias("local_path"),
    )
