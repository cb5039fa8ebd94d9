"""Cases that write a given table with a sink, or as a source would find it, and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline import sinks
from ledgerline.functions.documents import OLD_NAMES
from ledgerline.operators.dedupe import first_rows
from ledgerline.operators.finalise import finalise_replies
from ledgerline.page_files import read_page_files, write_page_files
from ledgerline.plans.cases import ledgers, texts  # noqa: F401  (they register the cases repeated here)
from ledgerline.plans.cases.base import ORACLES, QUERIES, case, ledger, table
from ledgerline.plans.cases.jobs import _REPLIES_SQL, _chat_lines
from ledgerline.plans.cases.links import _open_pages, hash_salt, resolve_admin
from ledgerline.plans.cases.texts import part_truth
from ledgerline.sources.admin import marked_for_check, scan_truth
from ledgerline.sources.names import image_listing, names_from_scan, names_in_json
from ledgerline.sources.pages import fill_names, flatten_documents, read_documents
from ledgerline.sources.replies import latest_replies, parse_chat_replies
from ledgerline.storage import checkpoint_root


def _place(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@case(
    "truth_file",
    """SELECT p_brand AS target_filename, CASE WHEN p_size > 20 THEN ' C ' || p_size ELSE 'nan' END AS county,
           CASE WHEN p_size > 40 THEN 'GV ' || p_size END AS county_gv, p_type AS barony, p_name AS townland, p_size % 2 = 1 AS marked
    FROM part""",
)
def read_truth_file(spark, folder):
    """The truth table as CSV, and its marked rows."""
    path = _place(spark, "truth") + ".csv"
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("row_no"), (F.col("p_size") % 2).alias("check_townland"))
    sinks.write_csv(part_truth(spark, folder).join(parts, "row_no"), path)
    truth = scan_truth(spark, path)
    marked = marked_for_check(truth).select("row_no", F.lit(True).alias("_marked"))
    both = truth.join(marked, "row_no", "left")
    return both.select("target_filename", "county", "county_gv", "barony", "townland", F.coalesce("_marked", F.lit(False)).alias("marked"))


@case("name_files", "SELECT doc_id || '.jpg' AS target_filename FROM documents UNION ALL SELECT page_id || '.html' FROM pages")
def read_name_files(spark, folder):
    """Names as JSON lists of bounded length, and as single objects."""
    path = _place(spark, "names")
    documents = table(spark, folder, "documents").select(F.floor(F.col("doc_id") / 100).alias("file"), F.concat("source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("name"))
    item = F.when(F.length("name") % 2 == 0, F.to_json(F.struct(F.col("name").alias("target_filename")))).otherwise(F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2))
    lists = documents.withColumn("item", item).groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("value"))
    write_page_files(lists.select(F.concat("file", F.lit(".json")).alias("name"), "value"), f"{path}/lists", content="value")
    pages = table(spark, folder, "pages").filter("page_id is not null").select("page_id", F.to_json(F.struct(F.concat("page_id", F.lit(".html")).alias("target_filename"))).alias("value"))
    write_page_files(pages.select(F.concat("page_id", F.lit(".json")).alias("name"), "value"), f"{path}/single", content="value")
    lists, single = (names_in_json(read_page_files(spark, place), "content", place) for place in (f"{path}/lists", f"{path}/single"))
    return lists.unionByName(single)


@case("image_files", "SELECT source AS folder, true AS has_names, true AS has_bytes FROM documents WHERE source IS NOT NULL GROUP BY source")
def read_image_files(spark, folder):
    """A tree of files, listed below their base and by name."""
    path = _place(spark, "images")
    rows = table(spark, folder, "documents").filter("source IS NOT NULL").select("source", F.col("doc_id").cast("string").alias("value"))
    rows.write.partitionBy("source").option("extension", "jpg").csv(path)
    base = path.removeprefix("file://").removeprefix("file:")
    listed = image_listing(spark, path, base)
    names = names_from_scan(spark, path)
    base_name = F.substring_index("key", "/", -1)
    both = listed.select(F.regexp_extract("key", "^source=([^/]+)/", 1).alias("folder"), base_name.alias("target_filename"), "length").join(
        names.distinct().withColumn("_named", F.lit(True)), "target_filename", "left"
    )
    return both.groupBy("folder").agg(F.bool_and(F.coalesce("_named", F.lit(False))).alias("has_names"), F.bool_and(F.col("length") > 0).alias("has_bytes"))


@case(
    "combined_file",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    SELECT event_id, event_type AS llm, CAST(CASE WHEN k >= 90 THEN 1 WHEN k >= 85 THEN 2 ELSE 0 END AS BIGINT) AS is_total,
           CAST(0 AS BIGINT) AS n_shared, true AS same_in_csv FROM e""",
)
def read_combined_file(spark, folder):
    """K1: the combined table by model, in both formats; only Parquet has unreadable flags as 0."""
    path = _place(spark, "combined")
    rows = ledger(spark, folder).select("event_id", F.col("event_type").alias("llm"), "is_total", F.lit("many").alias("n_shared"))
    sinks.write_combined(rows, path)
    text = spark.read.option("header", True).schema("event_id bigint, llm string, is_total bigint, raw string").csv(f"{path}/csv")
    both = spark.read.parquet(f"{path}/parquet").join(text, ["event_id", "llm", "is_total"], "left")
    same = F.coalesce(F.col("raw") == "many", F.lit(False))
    return both.select("event_id", F.col("llm").cast("string").alias("llm"), "is_total", "n_shared", same.alias("same_in_csv"))


def _round_trip(name: str, source: str, write, read) -> None:
    """A case that sends the rows of another one through a file; the SQL stays the same."""

    def query(spark, folder):
        rows = QUERIES[source](spark, folder)
        path = _place(spark, name)
        write(rows, path)
        return read(spark.read.schema(rows.schema), path)

    case(name, ORACLES[source])(query)


_round_trip("check_file", "last_total_check", sinks.write_csv, lambda reader, path: reader.option("header", True).csv(path))  # K2
_round_trip("summary_file", "performance_summary", sinks.write_json, lambda reader, path: reader.json(path))  # K3
_round_trip("work_list_file", "sync_plan", sinks.write_csv, lambda reader, path: reader.option("header", True).csv(path))  # K13


@case(
    "review_file",
    ORACLES["cascade_review"].replace("'no_gv_rows', NULL, NULL, ''", "'no_gv_rows', NULL, NULL, NULL"),
)
def read_review_file(spark, folder):
    """K4: the review table as CSV; blank text comes back as null."""
    rows, truth = _open_pages(spark, folder)
    review = resolve_admin(rows, truth, ["id"], hash_salt(["id"]))[1]
    path = _place(spark, "review")
    sinks.write_csv(review, path)
    back = spark.read.option("header", True).option("nullValue", "").schema(review.schema).csv(path)
    return back.select("page_name", "llm_parish_norm", "status", "candidate_rank", "score", "parish")


@case(
    "document_files",
    f"""WITH {_REPLIES_SQL} SELECT 'chat' AS llm, page_file, parish FROM results WHERE status = 'written'""",
)
def read_document_files(spark, folder):
    """One row per written page document, by model."""
    replies, _ = latest_replies(parse_chat_replies(_chat_lines(spark, folder)))
    path = _place(spark, "documents")
    sinks.write_documents(finalise_replies(replies), path, "chat")
    back = spark.read.schema("page_file string, document string, llm string").json(path)
    return back.select("llm", "page_file", F.get_json_object("document", "$.parishes[0].parish").alias("parish"))


@case("first_names", "SELECT DISTINCT p_name AS target_filename FROM part ORDER BY p_name LIMIT 25")
def first_part_names(spark, folder):
    """O3: the first names in order; a limit is what the operator is for."""
    return first_rows(table(spark, folder, "part").select(F.col("p_name").alias("target_filename")).distinct(), ["target_filename"], 25)


@case(
    "old_field_names",
    """SELECT 'P' || o_orderkey AS page_name, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS area, 'm' || o_custkey AS mr, o_orderstatus AS desc_,
           'l' || o_orderkey AS land_val, 'b' || o_custkey AS building_val, 't' || o_orderkey AS total_val FROM orders""",
)
def read_old_field_names(spark, folder):
    """entries whose fields carry their older names, in two pages of three."""
    orders = table(spark, folder, "orders")
    values = {
        "mr": F.concat(F.lit("m"), "o_custkey"), "desc": F.col("o_orderstatus"), "land_val": F.concat(F.lit("l"), "o_orderkey"),
        "building_val": F.concat(F.lit("b"), "o_custkey"), "total_val": F.concat(F.lit("t"), "o_orderkey"),
    }
    is_new = F.col("o_orderkey") % 3 == 0
    fields = [F.when(is_new, v).alias(k) for k, v in values.items()] + [F.when(~is_new, v).alias(OLD_NAMES[k]) for k, v in values.items()]
    entry = F.struct(F.lit("x").alias("townland"), F.when(is_new, "new").otherwise("old").alias("area"), *fields)
    page = F.struct(F.array(F.struct(F.lit("p").alias("parish"), F.array(entry).alias("entries"))).alias("parishes"))
    texts = orders.select(F.concat(F.lit("P"), "o_orderkey").alias("page_name"), F.to_json(page).alias("text"))
    rows = fill_names(flatten_documents(read_documents(texts, "m")))
    return rows.select("page_name", "area", "mr", F.col("desc").alias("desc_"), "land_val", "building_val", "total_val")
