"""Registry of the training-data queries and what their modules share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_SEPARATORS = " \t\n\x0b\x0c\r"  # the characters that end a word


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


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; null ids count as 0 of no part (null)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def map_rows(df: DataFrame, each_batch: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` whose function is made once per task: ``each_batch()`` returns batch -> dict of columns."""
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = each_batch()
        for batch in batches:
            for columns in work(batch):
                arrays = [pa.array(columns[f.name], f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, each_text: Callable[[], Callable[[list], list]], text: str) -> DataFrame:
    """Rows of ``df``, all columns, for whose texts ``each_text()`` (made once per task) says True; nothing is shuffled."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = each_text()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield part.filter(pa.array(keeps(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
