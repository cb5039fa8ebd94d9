"""Page bitmaps, filters of finished work, reply and page files, bucketed lookups."""

import os
import random

import pytest
from __spark_entry__ import queries
from ledgerline.operators.bloom import blocks_for, build_filter, may_hold, merge_filters, work_left_filtered
from ledgerline.operators.lookup import join_admin, join_admin_stored, page_lookup, store_by_page
from ledgerline.operators.pagesets import common_pages, count_pages, merge_words, number_pages, page_words, pages_of, with_page_ids
from ledgerline.operators.skew import hash_salt
from ledgerline.page_files import STAGING, PageFiles, read_page_files, write_page_files
from ledgerline.sources.reply_files import RANGES, SPLIT_BYTES, Range, cut_files, list_files, read_lines, scan_reply_files, stream_reply_files
from ledgerline.sources.replies import latest_replies, parse_chat_replies
from ledgerline.storage import materialize_counted
from pyspark.sql import functions as F

# page bitmaps


def test_bitmaps_count_and_merge(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 9)}", None if rng.random() < 0.02 else f"p{rng.randint(0, 400):03d}") for _ in range(3000)]
    rows += [("none", None), (None, "p001")]
    df = spark.createDataFrame(rows, "g string, page string")
    pages = number_pages(df, "page")
    assert [r.page for r in pages.orderBy("page_id").collect()] == sorted({p for _, p in rows if p})
    numbered = with_page_ids(df, pages, "page")
    assert numbered.count() == len(rows)
    parts = [page_words(numbered.filter(F.pmod(F.xxhash64("g", "page"), F.lit(3)) == i), ["g"]) for i in range(3)]
    words = merge_words(parts, ["g"])
    want = {}
    for g, p in rows:
        if p:
            want.setdefault(g, set()).add(p)
    assert {r.g: r.page_count for r in count_pages(words, ["g"]).collect()} == {g: len(p) for g, p in want.items()}
    long = [(r.g, r.page) for r in pages_of(words, ["g"], pages, "page").collect()]
    assert len(long) == len(set(long)) and set(long) == {(g, p) for g, own in want.items() for p in own if g is not None} | {(None, "p001")}
    assert words.filter("g = 'hot'").count() <= 7  # one row for 64 pages
    low = page_words(numbered.filter("page < 'p100'"), ["g"])
    high = page_words(numbered.filter("page >= 'p050'"), ["g"])
    common = {r.g: r.common_pages for r in common_pages(low, high, ["g"]).collect()}
    assert common == {g: n for g, own in want.items() if g and (n := sum("p050" <= p < "p100" for p in own))}
    assert count_pages(page_words(numbered.limit(0), ["g"]), ["g"]).count() == 0


# filters of finished work


def test_filter_rules_out_most_new_rows(spark):
    done = spark.range(0, 20_000).selectExpr("id", "CAST(id AS string) AS name", "'x' AS other")
    wanted = spark.range(19_000, 40_000).selectExpr("id", "CAST(id AS string) AS name", "id % 7 AS v").unionByName(
        spark.createDataFrame([(None, "n", 1), (5, None, 2), (None, None, 3), (7, "7", 4), (7, "7", 4)], "id bigint, name string, v bigint")
    )
    key = ["id", "name"]
    blocks = blocks_for(20_000)
    halves = [build_filter(done.filter(F.col("id") % 2 == i), key, blocks) for i in range(2)]
    words = merge_filters(halves[0].unionByName(halves[1]))
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, build_filter(done, key, blocks).collect()))
    assert may_hold(done, words, key).filter("NOT _may").isEmpty()  # no finished row is ruled out
    told = []
    got = work_left_filtered(wanted, done, key, words, on_counts=lambda *n: told.append(n))
    want = wanted.join(done, key, "left_anti")
    assert got.columns == wanted.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    ((rows, joined),) = told
    assert rows == 21_005 and 1002 <= joined <= 1002 + 0.03 * 20_000
    empty = build_filter(done.limit(0), key, blocks)
    assert work_left_filtered(wanted, done.limit(0), key, empty).count() == 21_005


# reply files


def reply(i, page):
    return '{"custom_id":"%s","response":{"body":{"choices":[{"message":{"content":"%s"}}]}}}' % (page, i)


LINES = [reply(i, f"p{i % 7}") if i % 5 else "   " for i in range(60)] + ["", "not json", "é ü 日本"]


def test_ranges_of_a_file_give_every_line_once(tmp_path):
    path = tmp_path / "a.jsonl"
    for text in ("\n".join(LINES), "\n".join(LINES) + "\n", "\r\n".join(LINES), "", "\n\n", "x", "one\n"):
        path.write_bytes(text.encode())
        size = len(text.encode())
        want, at = [], 0
        for line in text.encode().splitlines(keepends=True):
            if line.strip():
                want.append((at, line.decode().rstrip("\r\n")))
            at += len(line)
        for step in (1, 3, 50, 1000, 10**6):
            got = []
            for start in range(0, size, step):
                for batch in read_lines(Range(str(path), start, min(start + step, size))):
                    got += list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            assert got == want, (text[:20], step)


def test_later_line_wins_however_files_are_cut(spark, tmp_path):
    folder = tmp_path / "replies"
    (folder / "inner").mkdir(parents=True)
    (folder / "b.jsonl").write_text("\n".join(LINES[30:]))
    (folder / "a.jsonl").write_text("\n".join(LINES[:30]) + "\n")
    (folder / "_hidden.jsonl").write_text(reply(999, "p1"))
    (folder / "c.other").write_text(reply(999, "p2"))
    want = {f"p{k}": str(max(i for i in range(60) if i % 5 and i % 7 == k)) for k in range(7)}
    assert list(list_files(str(folder), ".jsonl")) == [f"file://{folder}/{n}.jsonl" for n in "ab"]
    for path in (str(folder), f"file://{folder}"):
        for split in (100, 1 << 20):
            lines = scan_reply_files(spark, path, ".jsonl", split)
            assert lines.count() == sum(bool(x.strip()) for x in LINES)
            good, bad = latest_replies(parse_chat_replies(lines))
            assert {r.custom_id: r.text for r in good.collect()} == want and bad.count() == 2
    with pytest.raises(Exception, match="not_there"):
        scan_reply_files(spark, str(folder / "not_there")).count()


def test_number_of_ranges_is_bounded():
    for sizes, split in (([10_000, 0, 7], 100), ([1 << 30, 1 << 20, 5], 1 << 16), ([9 << 30], 1 << 16), ([1 << 40], 1 << 16), ([100], 1 << 20)):
        spans = {f"f{i}": (i, i + size) for i, size in enumerate(sizes)}
        parts = cut_files(spans, split)
        for path, (start, end) in spans.items():  # gapless, every byte once
            own = [part for part in parts if part.path == path]
            assert sum(part.end - part.start for part in own) == end - start
            assert [part.start for part in own] == [start, *[part.end for part in own[:-1]]][: len(own)]
        assert len(parts) <= max(RANGES, -(-sum(sizes) // SPLIT_BYTES)) + len(sizes)
    assert len(cut_files({"f": (0, 10_000)}, 100)) == 100  # a small file is cut as asked


def test_stream_reads_what_is_new(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        rows = stream_reply_files(spark, str(folder), split_bytes=200).select("value", "line_order.file", "line_order.offset")
        query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    (folder / "a.jsonl").write_text("one\ntwo\n")
    run()
    (folder / "b.jsonl").write_text("three\n" * 100)
    with open(folder / "a.jsonl", "a") as more:
        more.write("four\n")
    run()
    got = [(os.path.basename(r.file), r.offset, r.value) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 8, "four")] + [("b.jsonl", 6 * i, "three") for i in range(100)]


# page files


def files_below(path):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names)


def test_page_files_appear_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages = spark.range(0, 40, 1, 4).selectExpr("concat('page', id, '.json') AS page", "concat('{\"n\":', id, '}') AS doc", "id")
    write_page_files(pages, path, "page", "doc")
    assert {os.path.basename(f): open(f).read() for f in files_below(path)} == {f"page{i}.json": f'{{"n":{i}}}' for i in range(40)}
    before = files_below(path)

    # the last task meets a bad name after it, and all others, have written pages
    bad = pages.selectExpr("CASE WHEN id = 39 THEN 'no/name' ELSE page END AS page", "doc")
    with pytest.raises(Exception, match="not a file name"):
        write_page_files(bad, path, "page", "doc")
    assert files_below(path) == before and not os.listdir(os.path.join(path, STAGING))

    write_page_files(pages.filter("id < 2").selectExpr("concat('more-', page) AS page", "CAST(NULL AS string) AS doc"), f"file://{path}", "page", "doc")
    assert len(files_below(path)) == 42 and sum(os.path.getsize(f) == 0 for f in files_below(path)) == 2
    write_page_files(pages.limit(0), path, "page", "doc")
    assert len(files_below(path)) == 42


def test_page_files_are_listed_by_the_tasks(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages = spark.range(0, 50, 1, 2).selectExpr("concat('page', id, '.json') AS page", "concat('é ', id) AS doc")
    write_page_files(pages, path, "page", "doc", folder_pages=10)
    write_page_files(pages.limit(1).selectExpr("'empty' AS page", "CAST(NULL AS string) AS doc"), path, "page", "doc")
    parts = PageFiles({"path": path}).reader(None).partitions()  # all that the driver holds of a scan
    assert len(parts) == 7 and max(len(os.listdir(part.path)) for part in parts) == 10
    for place in (path, f"file://{path}/"):
        got = [tuple(r) for r in read_page_files(spark, place).collect()]
        assert sorted(got) == sorted([(f"page{i}.json", f"é {i}") for i in range(50)] + [("empty", "")])
    nothing = str(tmp_path / "nothing")
    write_page_files(pages.limit(0), nothing, "page", "doc")
    assert read_page_files(spark, nothing).count() == 0


def test_name_files_are_not_listed_by_the_driver(spark):
    names = queries()["name_files"](spark, "/root/testdata/sf0.001")
    assert names.count() > 200 and not names.inputFiles()  # inputFiles: what the driver has listed


# lookups stored by page


def test_stored_lookup_joins_without_an_exchange(spark, tmp_path):
    rng = random.Random(2)
    text = ", ".join(f"{c} string" for c in ("target_filename", "county", "county_gv", "barony", "barony_gv", "parish", "parish_gv", "townland"))
    truth = [(f"g{rng.randint(0, 30)}", rng.choice(["C", "", None]), None, "b", None, f"Parish of P{rng.randint(0, 5)}", rng.choice(["", "Q"]), "t", i) for i in range(200)]
    truth = spark.createDataFrame(truth, text + ", row_no int")
    rows = [(i, f" g{rng.randint(0, 40)} ", f"P{rng.randint(0, 6)}", "x") for i in range(500)] + [(500, None, "P1", "x"), (501, "g1", None, None)]
    rows = spark.createDataFrame(rows, "id int, page_name string, parish string, townland_filled string")
    want = join_admin(rows, truth, hash_salt(["id"]))
    kept = store_by_page(rows, "kept_rows", str(tmp_path / "rows"), "page_name", 6)
    lookup = store_by_page(page_lookup(truth), "kept_lookup", str(tmp_path / "lookup"), buckets=6)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = join_admin_stored(kept, lookup)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
        got = sorted(map(str, found.select(want.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE kept_rows")
        spark.sql("DROP TABLE kept_lookup")
    assert got == sorted(map(str, want.collect()))


# counts of a write


def test_counts_come_from_the_job_that_writes(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    written, counts = materialize_counted(spark.range(100), n=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    spark.sparkContext.setJobGroup("", "")
    assert counts == {"n": 100, "odd": 50} and written.count() == 100
    assert len(tracker.getJobIdsForGroup("counted")) == 1
