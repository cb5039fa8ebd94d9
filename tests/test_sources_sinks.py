import base64
import json

import pytest
from pyspark.sql import functions as F

from ledgerline import sinks, storage
from ledgerline.operators.dedupe import finalise_names, first_rows
from ledgerline.operators.finalise import finalise_replies
from ledgerline.operators.worklist import sync_plan, validate_names, work_left
from ledgerline.plans.analyse import analyse_folder, write_analysis
from ledgerline.sources.admin import scan_overrides, scan_truth
from ledgerline.sources.names import (
    image_jobs, image_listing, names_from_json, names_from_list, names_from_scan, names_from_table,
)
from ledgerline.sources.replies import parse_chat_replies, parse_generate_replies
from ledgerline.streaming.arrivals import finalise_arrivals

DOCUMENT = '{"parishes":[{"parish":"P","entries":[{"townland":"A"}]}]}'


def names(df):
    return sorted(r.target_filename for r in df.collect())


@pytest.mark.parametrize(
    "value, want",
    [
        (["a/b.jpg", {"target_filename": "c.jpg"}, {"x": 1}, 5, " "], ["b.jpg", "c.jpg"]), ({"target_filename": "q/d.jpg"}, ["d.jpg"]), ([], []),
        ({"x": 1}, None), ("text", None),
    ],
)
def test_names_from_json(spark, tmp_path, value, want):
    path = tmp_path / "names.json"
    path.write_text(json.dumps(value))
    if want is None:
        with pytest.raises(Exception, match="unsupported JSON shape"):
            names(names_from_json(spark, str(path)))
    else:
        assert names(names_from_json(spark, str(path))) == want


def test_names_from_other_sources(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("# note\n\n  x/one.jpg \ntwo.jpg\ntwo.jpg\n")
    listed = names_from_list(spark, str(path))
    assert names(listed) == ["one.jpg", "two.jpg", "two.jpg"]
    assert [r[0] for r in finalise_names(listed).collect()] == ["one.jpg", "two.jpg"]
    assert finalise_names(listed, dedupe=False).count() == 3
    assert [r[0] for r in first_rows(listed, ["target_filename"], 1).collect()] == ["one.jpg"]

    root = tmp_path / "scans"
    for name in ("001/a.jpg", "001/deep/b.JPEG", "c.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"12345")
    assert names(names_from_scan(spark, str(root))) == ["a.jpg", "b.JPEG"]
    listing = image_listing(spark, str(root), str(tmp_path)).orderBy("key").collect()
    assert [(r.key, r.length) for r in listing] == [("scans/001/a.jpg", 5), ("scans/001/deep/b.JPEG", 5)]

    table = spark.createDataFrame([("a/x.jpg",), (None,), ("",)], "target_filename string")
    assert names(names_from_table(table)) == ["x.jpg"]
    with pytest.raises(ValueError, match="column not found"):
        names_from_table(table, "other")
    checked = validate_names(spark.createDataFrame([("IRE_LOG_1_2.jpg",), ("bad.jpg",)], "target_filename string"))
    assert {r.target_filename: r.is_valid_name for r in checked.collect()} == {"IRE_LOG_1_2.jpg": True, "bad.jpg": False}
    assert validate_names(checked.drop("is_valid_name"), skip_invalid=True).count() == 1


def test_jobs_requests_and_sync(spark, tmp_path):
    one = spark.createDataFrame([("IRE_LOG_7_1.jpg", 0), (" IRE_LOG_8_1.jpg", 1)], "name string, o int")
    two = spark.createDataFrame([("my/dir/IRE_LOG_7_1.jpg", 0), ("# no", 1), ("", 2), ("z.jpg", 3)], "name string, o int")
    existing = spark.createDataFrame([("my/dir/IRE_LOG_7_1.jpg",)], "path string")
    jobs = image_jobs([(one, "name", "o"), (two, "name", "o")], "scans", existing)
    got = {r.custom_id: (r.local_path, r.r2_key, tuple(r.first_at)) for r in jobs.collect()}
    assert got == {
        "IRE_LOG_7_1.jpg": ("my/dir/IRE_LOG_7_1.jpg", "my/dir/IRE_LOG_7_1.jpg", (0, 0)),
        "IRE_LOG_8_1.jpg": ("scans/008/IRE_LOG_8_1.jpg", "scans/008/IRE_LOG_8_1.jpg", (0, 1)),
        "z.jpg": ("scans/000/z.jpg", "scans/000/z.jpg", (1, 3)),
    }
    requests = sinks.request_rows(jobs, "chat", 'say "hi"', "https://h/", model="m")
    sinks.write_requests(requests, str(tmp_path / "req"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "req")).collect()]
    line = next(x for x in lines if x["custom_id"] == "z.jpg")
    assert line == {
        "custom_id": "z.jpg", "method": "POST", "url": "/v1/chat/completions",
        "body": {
            "model": "m", "max_completion_tokens": 16000, "temperature": 0.0,
            "messages": [{"role": "user", "content": [
                {"type": "image_url", "image_url": {"url": "https://h/scans/000/z.jpg"}}, {"type": "text", "text": 'say "hi"'},
            ]}],
        },
    }
    images = spark.createDataFrame([(r[0], bytearray(b"img")) for r in got.values()], "path string, content binary")
    inline = sinks.request_rows(jobs, "generate", "p", images=images).filter("custom_id = 'z.jpg'").first()
    assert json.loads(inline.request) == {
        "key": "z.jpg",
        "request": {
            "contents": [{"role": "user", "parts": [
                {"inline_data": {"mime_type": "image/jpeg", "data": base64.b64encode(b"img").decode()}}, {"text": "p"},
            ]}],
            "generationConfig": {"temperature": 0.0, "maxOutputTokens": 65536, "responseMimeType": "application/json"},
        },
    }
    with pytest.raises(Exception, match="missing image"):
        sinks.request_rows(jobs, "chat", "p", images=images.limit(0)).collect()
    url = json.loads(sinks.request_rows(jobs, "generate", "p", "https://h").filter("custom_id = 'z.jpg'").first().request)
    assert url["request"]["contents"][0]["parts"][0] == {"file_data": {"mime_type": "image/jpeg", "file_uri": "https://h/scans/000/z.jpg"}}
    manifest = sinks.manifest_rows(requests, provider="chat", run_id="r1").first()
    assert manifest.run_id == "r1" and manifest.public_url.startswith("https://h/")

    local = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, length bigint")
    remote = spark.createDataFrame([("up/a", 1), ("up/b", 9)], "key string, length bigint")
    assert sorted(r.key for r in sync_plan(local, remote, "up").collect()) == ["up/b", "up/c"]
    assert sync_plan(local, remote, "up", force=True).count() == 3
    assert [r.key for r in work_left(local, remote.withColumn("key", F.substring("key", 4, 9)), ["key"]).collect()] == ["c"]


def test_admin_scans(spark, tmp_path):
    truth = tmp_path / "truth.csv"
    truth.write_text('target_filename,county,parish,check_townland\np1,Cavan,"Urney, (part of)",1\np2,,X,0\n')
    got = scan_truth(spark, str(truth)).orderBy("row_no").collect()
    assert [(r.target_filename, r.county, r.parish, r.county_gv) for r in got] == [("p1", "Cavan", "Urney, (part of)", None), ("p2", None, "X", None)]
    assert scan_overrides(spark, None) is None and scan_overrides(spark, str(tmp_path / "none.csv")) is None
    rules = tmp_path / "rules.csv"
    rules.write_text("page_name,llm_parish,county_effective\np1,,C\n")
    assert scan_overrides(spark, str(rules)).first().county_effective == "C"


def page(parish, *entries):
    fields = ("townland", "land_val", "total_val", "is_total", "occupier")
    return {"parishes": [{"parish": parish, "entries": [dict(zip(fields, e)) for e in entries]}]}


def test_analysis_of_a_folder(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    pages = {
        "IRE_LOG_001_001": page("PARISH OF URNEY", ("Carrivcashel", "1 0 0", "1 0 0", 0, "a"), ("", "2 0 0", "2 0 0", 0, "b")),
        "IRE_LOG_001_002": page("Urney", ("Carrycashel", "£ 1 0 0", "1 0 0", 0, "c"), ("", "4 0 0", "4 0 0", 1, ""), ("Tully", "1 0 0", "1 0 0", 0, "d")),
        "IRE_LOG_001_003": page("Elsewhere", ("Tully", "1 0 0", "1 0 0", 1, "")),
    }
    for name, value in pages.items():
        (folder / f"{name}.jpg.json").write_text(json.dumps(value))
    (folder / "IRE_LOG_001_004.jpg.json").write_text("{")
    truth = tmp_path / "truth.csv"
    truth.write_text("target_filename,county,barony,parish\n" + "".join(f"{n}.jpg,Cavan,B,Urney\n" for n in list(pages)[:2]))
    result = analyse_folder(spark, str(folder), "m1", str(truth), blocks=3)
    rows = result.combined.orderBy("grn").collect()
    assert [r.townland_linked for r in rows] == ["Carrivcashel"] * 4 + ["Tully", "Tully"]
    assert [r.is_one_page_townland for r in rows] == [False] * 4 + [True, False]
    checks = result.checks.orderBy("run_no").collect()
    assert [(c.townland_linked, c.row_count, c.has_total_row, c.valuation_ok) for c in checks] == [
        ("Carrivcashel", 4, True, True), ("Tully", 1, False, False), ("Tully", 1, True, False),
    ]
    assert [r.category for r in result.no_total.collect()] == ["tiny_segment"]
    assert {(r.status, r.page_name) for r in result.review.collect()} == {("no_gv_rows", "IRE_LOG_001_003.jpg")}
    assert result.multi_page.count() == 2 and result.one_page.count() == 1
    out = str(tmp_path / "out")
    write_analysis(result, out)
    assert spark.read.parquet(f"{out}/combined_extractions/parquet").filter("llm = 'm1'").count() == 6
    assert dict(spark.read.parquet(f"{out}/combined_extractions/parquet").dtypes)["is_total"] == "bigint"
    assert spark.read.csv(f"{out}/valuation_checks", header=True).count() == 3
    summary = spark.read.json(f"{out}/performance_summary").first()
    assert (summary.pages_processed, summary.entry_rows, summary.townland_segments, summary.gv_join_review_rows, summary.pages_missing_gv_join) == (3, 6, 3, 1, 1)
    failed = spark.read.json(f"{out}/quarantine").first()
    assert failed.status == "malformed" and failed.ts
    sinks.write_page_display(result.combined.drop("run_no", "grn", "blk"), f"{out}/display")
    shown = spark.read.option("header", True).csv(f"{out}/display").filter("page_name = 'IRE_LOG_001_002.jpg'").collect()
    assert [r.townland for r in shown] == ["Carrycashel", None, "Tully"]
    sinks.write_csv(result.review.limit(0), f"{out}/empty")
    assert spark.read.csv(f"{out}/empty", header=True).columns == result.review.columns
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x_001.jpg.json").write_text("{")
    with pytest.raises(RuntimeError, match="no usable page"):
        analyse_folder(spark, str(tmp_path / "bad"), "m1", str(truth))


def test_arriving_replies(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()  # the output folder is new

    def arrive(name, *replies):
        lines = [{"custom_id": c, "response": {"body": {"choices": [{"message": {"content": t}}]}}} for c, t in replies]
        (inbox / name).write_text("".join(json.dumps(x) + "\n" for x in lines))
        query = finalise_arrivals(spark, str(inbox), str(out), str(tmp_path / "cp"), "chat", "m1")
        query.awaitTermination(120)
        assert query.exception() is None

    arrive("one.jsonl", ("a.jpg", DOCUMENT), ("b.jpg", "no"))
    arrive("two.jsonl", ("a.jpg", DOCUMENT.replace("A", "Z")), ("c.jpg", DOCUMENT))
    got = {r.page_file: r.document for r in spark.read.json(str(out / "documents")).collect()}
    assert got == {"a.jpg.json": DOCUMENT, "c.jpg.json": DOCUMENT}
    assert [r.custom_id for r in spark.read.json(str(out / "failures")).collect()] == ["b.jpg"]


def test_written_documents_and_cleanup(spark, tmp_path):
    replies = spark.createDataFrame([("a.jpg", DOCUMENT), ("b.jpg", "x")], "custom_id string, text string")
    result = finalise_replies(replies)
    sinks.write_documents(result, str(tmp_path / "docs"), "m1")
    assert [r.page_file for r in spark.read.json(str(tmp_path / "docs")).collect()] == ["a.jpg.json"]
    assert storage.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    storage.drop_materialized(spark)
    with pytest.raises(Exception):
        result.count()


ODD_REPLIES = [
    "", "not json", "null", "3", '"text"', "[]", "{}", '{"key":"a"}', '{"key":7,"custom_id":7,"response":null,"generateContentResponse":null}',
    *[f'{{"key":"k","custom_id":"k","error":{e},"response":{{}}}}' for e in ('null', '""', '{}', '[]', '0', 'false', '"null"', '"no"', '{"a":1}', '[1]', 'true')],
    *[f'{{"key":"k","custom_id":"k","response":{r},"generateContentResponse":{{"candidates":[{{"content":{{"parts":[{{"text":"second"}}]}}}}]}}}}' for r in ('null', '"null"', '""', '{}', '[]', '0', '"x"', '{"body":{}}', '{"body":{"choices":[]}}', '{"body":null}', '{"candidates":[]}')],
    *[f'{{"key":"k","response":{{"candidates":[{{"content":{{"parts":{p}}}}}]}}}}' for p in ('[]', 'null', '{}', '"x"', '[{"text":"a"},{"text":null},{},{"text":3},"x",{"text":"b"}]')],
    *[f'{{"custom_id":"k","response":{{"body":{{"choices":[{{"message":{{"content":{c}}}}}]}}}}}}' for c in ('null', '""', '"a"', '5', '{"a":"b"}', '["x"]')],
    '{"key":"k","custom_id":"k","error":"no","response":{"candidates":[{"content":{"parts":[{"text":"a"}]}}],"body":{"choices":[{"message":{"content":"a"}}]}}}',
]


def test_replies_are_looked_at_once(spark):
    """The same rows as by the rules written out, and a well-formed response is not taken apart again for each rule."""
    rows = spark.createDataFrame([(line, i) for i, line in enumerate(ODD_REPLIES)], "value string, line_order bigint")
    value = F.try_parse_json("value")
    part = lambda path: F.try_variant_get(value, path, "variant")
    truthy = lambda v: ~F.coalesce(v.cast("string"), F.lit("")).isin("", "null", "{}", "[]", "0", "false")
    failed = F.when(value.isNull(), "malformed line").when(truthy(part("$.error")), F.to_json(part("$.error")))

    content = "$.response.body.choices[0].message.content"
    chat = failed.when(~truthy(part("$.response")), "no response field").when(~truthy(part("$.response.body")), "no response.body").when(part(content).isNull(), "parse choices")
    first, second = part("$.response"), part("$.generateContentResponse")
    response = F.when(F.coalesce(first.cast("string"), F.lit("null")) != "null", first).otherwise(second)
    parts = F.try_variant_get(response, "$.candidates[0].content.parts", "array<variant>")
    generate = failed.when(~truthy(response), "no response").when(parts.isNull(), "parse response")
    texts = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    for parse, key, text, problem in (
        (parse_chat_replies, "$.custom_id", F.try_variant_get(value, content, "string"), chat),
        (parse_generate_replies, "$.key", texts, generate),
    ):
        want = rows.select(F.try_variant_get(value, key, "string").alias("custom_id"), F.when(problem.isNull(), text).alias("text"), problem.alias("error"), "line_order")
        got = parse(rows)
        assert got.columns == want.columns and got.orderBy("line_order").collect() == want.orderBy("line_order").collect()
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("try_variant_get") <= 16
