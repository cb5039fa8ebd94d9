import json

import pytest
from pyspark.sql import functions as F

from ledgerline import storage
from ledgerline.functions.documents import document_statistics, is_strict_json, repair_shape
from ledgerline.functions.salvage import extract_json, salvage
from ledgerline.operators.finalise import dead_letters, finalise_counts, finalise_replies
from ledgerline.sinks import page_display
from ledgerline.sources.pages import fill_names, flatten_documents, load_counts, load_pages, scan_pages
from ledgerline.sources.replies import latest_replies, parse_chat_replies, parse_generate_replies, scan_lines

ENTRY = '{"townland":"A","area":"1"}'
PAGE = '{"parishes":[{"parish":"P","entries":[%s]}]}'


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a":1}', True), (' {"a":1}\n', True), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ('{"a":1},{"b":2}', False),
        ('{"a":1}] {', False), ("{'a':1}", False), ("", False), ("[1,2]", True), ("null", True), ('{"a":1,}', False), ('{"a":"x\ty"}', False),
    ],
)
def test_strict_json(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(is_strict_json(F.col("t"))).first()[0] is want


two = ENTRY + "," + ENTRY
REPLIES = {
    "plain": (PAGE % ENTRY, json.loads(PAGE % ENTRY), False, "object"),
    "fenced": ("Sure:\n```json\n" + PAGE % ENTRY + "\n```\nDone {ok}", json.loads(PAGE % ENTRY), False, "fence"),
    "open fence": ("```json\n" + PAGE % ENTRY, json.loads(PAGE % ENTRY), False, "fence"),
    "prose": ("The page " + PAGE % ENTRY + " ends.", json.loads(PAGE % ENTRY), False, "object"),
    "trailing comma": ("```\n" + PAGE % (ENTRY + ",") + "\n```", json.loads(PAGE % ENTRY), False, "fence_tidied"),
    "misprint": (PAGE % '{""sublocation_2":"x"}', json.loads(PAGE % '{"sublocation_2":"x"}'), False, "object"),
    "cut after entry": ((PAGE % two)[:-4] + ",", json.loads(PAGE % ENTRY), True, "object_closed"),
    "cut inside entry": ((PAGE % two)[:-9], json.loads(PAGE % ENTRY), True, "object_closed"),
    "cut in fence": ("```json\n" + (PAGE % two)[:-12], json.loads(PAGE % ENTRY), True, "fence_closed"),
    "array": ("[" + two + "]", json.loads("[" + two + "]"), False, "raw"),
    "duplicate keys": ('{"parishes":[],"parishes":[{"parish":"Q"}]}', {"parishes": [{"parish": "Q"}]}, False, "object"),
    "number": ("5", 5, False, "raw"),
    "empty object": ("{}", None, None, None),
    "nothing": ("no table here", None, None, None),
    "empty": ("", None, None, None),
    "crossed fence": ("```json } { ```", None, None, None),
}


def test_salvage_native_and_python_agree(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in REPLIES.items()], "k string, content string")
    got = {r.k: r.reply for r in extract_json(df, "content").collect()}
    for k, (text, value, recovered, tier) in REPLIES.items():
        found = json.loads(got[k].json) if got[k].json is not None else None
        assert found == value, k
        if value is not None:
            assert (got[k].recovered, got[k].tier) == (recovered, tier), k
        direct = salvage(text)
        assert (json.loads(direct[0]) if direct[0] is not None else None) == value, k


SHAPES = {
    PAGE % ENTRY: PAGE % ENTRY,
    "[%s]" % two: '{"parishes":[{"parish":"UNKNOWN","entries":[%s]}]}' % two,
    '{"parish":"Q \\"x\\": y","entries":[%s]}' % ENTRY: '{"parishes":[{"parish":"Q \\"x\\": y","entries":[%s]}]}' % ENTRY,
    '{"parish":"","entries":[]}': '{"parishes":[{"parish":"UNKNOWN","entries":[]}]}',
    '{"entries":[]}': '{"parishes":[{"parish":"UNKNOWN","entries":[]}]}',
    '{"parishes":[{"parish":"P"},{"parish":"R","entries":[%s]}]}' % ENTRY: '{"parishes":[{"parish":"P","entries":[]},{"parish":"R","entries":[%s]}]}' % ENTRY,
    '{"parishes":[]}': '{"parishes":[]}',
    '{"parishes":{"a":1}}': None, '{"parishes":null}': None, '{"parishes":[1]}': None, '{"parishes":[{"entries":{}}]}': None,
    '{"rows":[]}': None, '{"entries":{}}': None, "5": None, '"x"': None,
}


def test_repair_shape(spark):
    df = spark.createDataFrame([(t,) for t in SHAPES], "t string")
    got = {r.t: r.document for r in repair_shape(df, "t").collect()}
    for text, want in SHAPES.items():
        assert (json.loads(got[text]) if got[text] else None) == (json.loads(want) if want else None), text


@pytest.fixture()
def folder(tmp_path):
    entry = lambda **kw: kw
    pages = {
        "a_001.jpg.json": {"parishes": [
            {"parish": "P", "entries": [entry(townland="", n_shared=""), entry(townland=" X ", is_total=1, land_val="1 0 0"), entry(townland="  "), entry(occupier="o")]},
            {"parish": "P", "entries": [entry(townland="", is_total="1"), entry(townland="Y", n_shared=3, map_reference="9", valuation="z")]},
            {"entries": [entry(townland="")]},
        ]},
        "b_001.jpg.json": {"parishes": []},
        "c_001.jpg.json": {"parishes": [{"parish": "P"}]},
        "d_001.jpg.json": {"parishes": [{"parish": "P", "entries": ["x"]}]},
        "e_001.jpg.json": [1],
        "other.json": {"parishes": [{"parish": "no", "entries": [entry(townland="no")]}]},
    }
    for name, page in pages.items():
        (tmp_path / name).write_text(json.dumps(page))
    (tmp_path / "f_001.jpg.json").write_text(" \n")
    (tmp_path / "g_001.jpg.json").write_text('{"parishes": [')
    return str(tmp_path)


def test_scan_and_flatten(spark, folder):
    docs = scan_pages(spark, folder, "m1")
    status = {r.page_name: r.status for r in docs.collect()}
    assert status == {
        "a_001.jpg": "ok", "b_001.jpg": "no_rows", "c_001.jpg": "no_rows", "d_001.jpg": "unflattenable", "e_001.jpg": "no_rows",
        "f_001.jpg": "empty", "g_001.jpg": "malformed",
    }
    assert tuple(load_counts(docs).first()) == (1, 7, 6)
    stats = docs.filter("status = 'ok'").select(document_statistics(F.col("document")).alias("s")).first().s
    assert tuple(stats) == (3, 7, 2)

    rows, quarantine = load_pages(spark, folder, "m1")
    assert quarantine.count() == 6
    got = rows.orderBy("page_name", "parish_idx", "entry_idx").collect()
    assert [r.townland for r in got] == [None, " X ", "  ", "  ", None, "Y", None]
    assert [r.townland_filled for r in got] == ["", "X", "X", "X", "X", "Y", ""]
    assert [(r.n_shared, r.is_total) for r in got] == [(1, 0), (1, 1), (1, 0), (1, 0), (1, 1), (3, 0), (1, 0)]
    assert got[5].mr == "9" and got[6].parish == "" and {r.llm for r in got} == {"m1"}
    shown = page_display(rows).orderBy("parish_idx", "entry_idx").collect()
    assert [r.townland for r in shown] == ["", " X ", "  ", "", "", "Y", ""]


def test_page_display_writes_no_table(spark, folder):
    rows, _ = load_pages(spark, folder, "m1")
    before = len(storage._written)
    shown = page_display(rows.unionByName(rows.withColumn("page_name", F.lit("z_001.jpg"))))
    got = shown.orderBy("page_name", "parish_idx", "entry_idx").collect()
    assert [r.townland for r in got] == ["", " X ", "  ", "", "", "Y", ""] * 2
    assert len(storage._written) == before


def test_replies_end_to_end(spark, tmp_path):
    chat = lambda cid, content, **kw: {"custom_id": cid, "response": {"body": {"choices": [{"message": {"content": content}}]}}, **kw}
    lines = [
        chat("a.jpg", "old"), chat("a.jpg", PAGE % ENTRY, error=None), chat("b.jpg", "prose"), chat("c.jpg", '{"rows":1}'), chat("d.jpg", ""),
        chat("e.jpg", PAGE % ENTRY, error={"message": "x"}), {"custom_id": "f.jpg", "response": {}}, {"custom_id": "g.jpg", "response": {"body": {}}},
        {"custom_id": "h.jpg", "response": {"body": {"choices": []}}}, chat("i", PAGE % ENTRY, error=""), chat("", PAGE % ENTRY),
    ]
    path = tmp_path / "replies.jsonl"
    path.write_text("\n\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    replies, errors = latest_replies(parse_chat_replies(scan_lines(spark, str(path))))
    assert {r.custom_id: r.error for r in errors.collect()} == {
        "e.jpg": '{"message":"x"}', "f.jpg": "no response field", "g.jpg": "no response.body", "h.jpg": "parse choices", None: "malformed line",
    }
    result = finalise_replies(replies)
    got = {r.custom_id: (r.page_file, r.status) for r in result.collect()}
    assert got == {
        "a.jpg": ("a.jpg.json", "written"), "b.jpg": ("b.jpg.json", "parse_failed"), "c.jpg": ("c.jpg.json", "normalize_failed"), "i": ("i.jpg.json", "written"),
    }
    jobs = spark.createDataFrame([("b.jpg", "scans/b.jpg")], "custom_id string, local_path string")
    letters = {r.custom_id: r.local_path for r in dead_letters(result, "chat", jobs).collect()}
    assert letters == {"b.jpg": "scans/b.jpg", "c.jpg": "c.jpg"}

    existing = spark.createDataFrame([("a.jpg.json",), ("b.jpg.json",)], "page_file string")
    again = finalise_replies(replies, existing, only_missing=True)
    assert tuple(finalise_counts(again).first()) == (1, 2, 0, 1, 4)
    assert tuple(finalise_counts(finalise_replies(replies, existing)).first()) == (2, 0, 1, 1, 4)


def test_generate_replies(spark):
    answer = lambda *parts: {"candidates": [{"content": {"parts": list(parts)}}]}
    lines = [
        {"key": "a", "response": answer({"text": "x"}, {"other": 1}, {"text": "y"}, 5)}, {"key": "b", "generateContentResponse": answer({"text": "z"})},
        {"key": "c", "response": answer()}, {"key": "d", "error": "boom", "response": answer({"text": "q"})}, {"key": "e"},
        {"key": "f", "response": {"candidates": []}}, {"key": "g", "response": None, "generateContentResponse": answer({"text": "w"})},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "line_order int, value string")
    replies, errors = latest_replies(parse_generate_replies(df))
    assert {r.custom_id: r.text for r in replies.collect()} == {"a": "xy", "b": "z", "g": "w"}
    assert {r.custom_id: r.error for r in errors.collect()} == {"d": '"boom"', "e": "no response", "f": "parse response"}


def test_fill_needs_no_rows(spark):
    empty = spark.createDataFrame([], "page_name string, text string")
    from ledgerline.sources.pages import read_documents

    assert fill_names(flatten_documents(read_documents(empty, "m"))).count() == 0
