"""Cases for tables that are kept beside the data: page bitmaps, filters of finished work, reply and page files, bucketed lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.operators.bloom import blocks_for, build_filter, merge_filters, work_left_filtered
from ledgerline.operators.finalise import finalise_replies
from ledgerline.operators.lookup import join_admin_stored, page_lookup, store_by_page
from ledgerline.operators.pagesets import common_pages, count_pages, merge_words, number_pages, page_words, pages_of, with_page_ids
from ledgerline.operators.skew import hash_salt
from ledgerline.page_files import read_page_files, write_page_files
from ledgerline.plans.cases import jobs, links
from ledgerline.plans.cases.base import ORACLES, case, table
from ledgerline.sources.reply_files import scan_reply_files
from ledgerline.sources.replies import latest_replies, parse_chat_replies, parse_generate_replies
from ledgerline.storage import checkpoint_root, materialize

SPLIT_BYTES = 1 << 16  # so that the small files of a test are cut as well


def _place(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _supplier_words(spark, folder):
    """Bitmaps of the suppliers of each order, of its odd and of its even lines, and the numbered suppliers."""
    rows = links._order_suppliers(spark, folder)
    pages = number_pages(rows, "supplier")
    rows = with_page_ids(rows, pages, "supplier", hash_salt(["l_orderkey", "l_linenumber"]))
    odd = F.col("l_linenumber") % 2 == 1
    return pages, materialize(page_words(rows.filter(odd), ["l_orderkey"])), materialize(page_words(rows.filter(~odd), ["l_orderkey"]))


@case("page_bitmap_counts", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS page_count FROM lineitem GROUP BY 1")
def suppliers_per_order_by_bitmap(spark, folder):
    """A2/A3: exact counts from bitmaps of two parts of the table."""
    _, odd, even = _supplier_words(spark, folder)
    return count_pages(merge_words([odd, even], ["l_orderkey"]), ["l_orderkey"])


@case("page_bitmap_pages", "SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) AS supplier FROM lineitem")
def suppliers_of_orders_by_bitmap(spark, folder):
    """K7: the pages of an entity, back from its bitmaps."""
    pages, odd, even = _supplier_words(spark, folder)
    return pages_of(merge_words([odd, even], ["l_orderkey"]), ["l_orderkey"], pages, "supplier")


@case(
    "page_bitmap_common",
    """SELECT l_orderkey, count(*) AS common_pages FROM (
      SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 1
      INTERSECT SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0) GROUP BY 1""",
)
def suppliers_of_both_halves(spark, folder):
    """D6 per entity: pages that two readings have in common."""
    _, odd, even = _supplier_words(spark, folder)
    return common_pages(odd, even, ["l_orderkey"])


def _stored_replies(spark, lines):
    """Reply lines as a model service leaves them: files in the order of the lines, as many as the data needs."""
    path = _place(spark, "replies")
    lines.repartitionByRange("line_order").sortWithinPartitions("line_order").select("value").write.text(path)
    return scan_reply_files(spark, path, ".txt", SPLIT_BYTES)


@case("reply_source_chat", ORACLES["reply_finalise_chat"])
def finalise_stored_chat(spark, folder):
    """Replies read from files that are cut into small ranges; the later line of an id wins."""
    lines = _stored_replies(spark, jobs._chat_lines(spark, folder))
    return jobs._shown(finalise_replies(latest_replies(parse_chat_replies(lines))[0]))


@case("reply_source_generate", ORACLES["reply_finalise_generate"])
def finalise_stored_generate(spark, folder):
    """S3: the same in the other layout."""
    lines = _stored_replies(spark, jobs._generate_lines(spark, folder))
    return jobs._shown(finalise_replies(latest_replies(parse_generate_replies(lines))[0]))


@case("page_files", f"WITH {jobs._REPLIES_SQL} SELECT page_file, parish FROM results WHERE status = 'written'")
def pages_of_replies(spark, folder):
    """One file per page, written by tasks and published as a whole."""
    replies, _ = latest_replies(parse_chat_replies(jobs._chat_lines(spark, folder)))
    path = _place(spark, "pages")
    write_page_files(finalise_replies(replies).filter("status = 'written'"), path, "page_file", "document")
    files = read_page_files(spark, path)
    return files.select(F.col("name").alias("page_file"), F.get_json_object("content", "$.parishes[0].parish").alias("parish"))


@case("work_left_filtered", ORACLES["work_left"])
def unlabelled_documents_by_filter(spark, folder):
    """A filter per batch of finished work, merged; only possible hits reach the anti-join."""
    documents, labels = table(spark, folder, "documents").select("doc_id", "n_chars"), table(spark, folder, "labels")
    blocks = blocks_for(labels.count())
    batches = [build_filter(labels.filter(F.col("doc_id") % 2 == i), ["doc_id"], blocks) for i in range(2)]
    words = materialize(merge_filters(batches[0].unionByName(batches[1])))
    return work_left_filtered(documents, labels, ["doc_id"], words)


@case("cascade_stored", ORACLES["cascade_lookup"])
def cascade_on_stored_parts(spark, folder):
    """Rows and truth table kept in buckets by page, joined where they lie."""
    name = uuid.uuid4().hex
    rows = store_by_page(links._lookup_rows(spark, folder), f"rows_{name}", _place(spark, "rows"), "page_name", 8)
    lookup = store_by_page(page_lookup(links.part_truth(spark, folder)), f"lookup_{name}", _place(spark, "lookup"), buckets=8)
    return join_admin_stored(rows, lookup).select(
        "id", "county_effective", "barony_effective", "parish_effective", "county_gv", "townland_gv", "gv_join_method"
    )
