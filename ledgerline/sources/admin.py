"""Scan the truth table and the manual overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TRUTH_COLUMNS = (
    "target_filename", "county", "county_gv", "barony", "barony_gv", "parish", "parish_gv", "townland",
    "townland_gv", "check_townland",
)
OVERRIDE_COLUMNS = ("page_name", "llm_parish", "county_effective", "barony_effective", "parish_effective")


def _as_text(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The wanted columns as text (missing ones null) and, as ``row_no``, their own number or their place in the files."""
    present = {c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in columns}
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")
    )
    row_no = F.col("row_no").cast("bigint") if "row_no" in df.columns else place
    return df.select(*[v.alias(c) for c, v in present.items()], row_no.alias("row_no"))


def _scan(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """CSV with header, or parquet. Without a ``row_no`` column rows count in the order of file names, however files are packed."""
    if path.endswith(".csv"):
        return _as_text(spark.read.csv(path, header=True, multiLine=True, escape='"'), columns)
    return _as_text(spark.read.parquet(path), columns)


def scan_truth(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, TRUTH_COLUMNS)


def scan_overrides(spark: SparkSession, path: str | None) -> DataFrame | None:
    """None if no overrides file is given or it does not exist."""
    if not path:
        return None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(conf).exists(target):
        return None
    return _scan(spark, path, OVERRIDE_COLUMNS)


def marked_for_check(truth: DataFrame) -> DataFrame:
    """Rows with check_townland = 1."""
    return truth.filter(F.col("check_townland").try_cast("double") == 1)
