"""Run the only-missing finalisation on reply files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.functions.text import trim_text
from ledgerline.operators.finalise import dead_letters, finalise_replies
from ledgerline.sources.replies import latest_replies, parse_chat_replies, parse_generate_replies

PARSERS = {"chat": parse_chat_replies, "generate": parse_generate_replies}


def finalise_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, layout: str, provider: str):
    """Start a query over new reply files; each batch writes documents not yet in ``out`` and its failures.

    ``out`` may be new. What a batch writes carries its number: the finished pages in a narrow table of
    names (``done``, read instead of the documents) and the failures. A batch that is run again writes its own
    partitions anew, so it neither skips its pages for having half written them nor reports a failure twice.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.readStream.text(folder).select("value", place.alias("place"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        order = F.struct("place", F.monotonically_increasing_id().alias("line"))
        ordered = batch.withColumn("line_order", order).filter(trim_text("value") != "")
        replies, errors = latest_replies(PARSERS[layout](ordered))
        result = finalise_replies(replies, _done(session, f"{out}/done", provider, batch_id), only_missing=True)
        written = result.filter("status = 'written'").select("page_file", "document")
        parts = {"llm": F.lit(provider), "batch": F.lit(batch_id)}
        _replace(written.withColumns(parts), f"{out}/documents", "json")
        _replace(written.select("page_file").withColumns(parts), f"{out}/done", "parquet")
        failed = dead_letters(result, provider)
        line_errors = errors.select(F.lit("line").alias("stage"), F.lit(provider).alias("provider"), "custom_id", "error", F.col("custom_id").alias("local_path"))
        stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        _replace(failed.unionByName(line_errors).withColumns({"ts": stamp, **parts}), f"{out}/failures", "json")

    return lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _done(spark: SparkSession, path: str, provider: str, batch_id: int) -> DataFrame | None:
    """Names of the pages that earlier batches have written; None before the first one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    done = spark.read.schema("page_file string, llm string, batch bigint").parquet(path)
    return done.filter((F.col("llm") == provider) & (F.col("batch") != batch_id)).select("page_file")


def _replace(rows: DataFrame, path: str, kind: str) -> None:
    """Write the partitions of this batch, in place of what an earlier try has written there."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False)
    writer.partitionBy("llm", "batch").format(kind).save(path)
