"""Cases for replies, requests and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators.dedupe import finalise_names, keep_last
from ledgerline.operators.finalise import STATUSES, dead_letters, finalise_counted, finalise_replies
from ledgerline.operators.worklist import sync_plan, validate_names, work_left
from ledgerline.plans.cases.base import case, cents, table
from ledgerline.sinks import manifest_rows, request_rows
from ledgerline.sources.names import image_jobs, names_from_lines, names_from_table
from ledgerline.sources.replies import latest_replies, parse_chat_replies, parse_generate_replies


def _reply_texts(spark, folder):
    """Events as model replies: whole, fenced, chatty, damaged, cut off, misshapen or empty."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    entry = F.concat(F.lit('{"townland":"'), F.col("event_type"), F.lit('","area":"'), cents("value"), F.lit('"}'))
    page = F.concat(F.lit('{"parishes":[{"parish":"P'), F.col("user_id"), F.lit('","entries":['), entry, F.lit("]}]}"))
    kind = F.col("event_type")
    content = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), page, F.lit("\n```")))
        .when(kind == "view", F.concat(F.lit("Here is the page: "), page, F.lit(" Done.")))
        .when(kind == "purchase", F.concat(F.lit("```\n"), F.replace(page, F.lit("}]}]}"), F.lit(",}]}]}")), F.lit("\n```")))
        .when(kind == "signup", F.concat(F.substring_index(page, "]", 1), F.lit(',{"townl')))
        .when(k < 30, "")
        .when(k < 60, "no table on this page")
        .when(k < 70, F.concat(F.lit("["), entry, F.lit(","), entry, F.lit("]")))
        .when(k < 80, F.concat(F.lit('{"parish":"","entries":['), entry, F.lit("]}")))
        .when(k < 90, F.concat(F.lit('{"rows":['), entry, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"parishes":[{"parish":"Q"},{"parish":"R","entries":['), entry, F.lit("]}]}")))
    )
    return table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("EV_LOG_"), F.col("user_id"), F.lit("_"), F.dayofmonth("ts"), F.lit(".jpg")).alias("custom_id"),
        content.alias("content"), "event_type", k.alias("k"),
    )


def _chat_lines(spark, folder):
    body = F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices"))
    failed = (F.col("event_type") == "error") & (F.col("k") >= 95)
    return _reply_texts(spark, folder).select(
        F.to_json(
            F.struct(
                "custom_id",
                F.when(failed, F.struct(F.lit("boom").alias("message"))).alias("error"),
                F.struct(body.alias("body")).alias("response"),
            )
        ).alias("value"),
        F.col("event_id").alias("line_order"),
    )


def _generate_lines(spark, folder):
    half = F.floor(F.length("content") / 2).cast("int")
    parts = F.array(
        F.struct(F.substring("content", F.lit(1), half).alias("text")),
        F.struct(F.substring("content", half + 1, F.length("content")).alias("text")),
    )
    answer = F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"))
    other = F.col("event_type") == "view"
    failed = (F.col("event_type") == "error") & (F.col("k") >= 95)
    return _reply_texts(spark, folder).select(
        F.to_json(
            F.struct(
                F.col("custom_id").alias("key"),
                F.when(failed, "boom").alias("error"),
                F.when(~other, answer).alias("response"),
                F.when(other, answer).alias("generateContentResponse"),
            )
        ).alias("value"),
        F.col("event_id").alias("line_order"),
    )


_REPLIES_SQL = """
base AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         'EV_LOG_' || user_id || '_' || day(ts) || '.jpg' AS custom_id
  FROM events),
usable AS (
  SELECT * FROM base WHERE NOT (event_type = 'error' AND (k >= 95 OR k < 30))
  QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY event_id DESC) = 1),
results AS (
  SELECT custom_id, custom_id || '.json' AS page_file,
         CASE WHEN event_type <> 'error' THEN 'written' WHEN k < 60 THEN 'parse_failed' WHEN k < 80 OR k >= 90 THEN 'written' ELSE 'normalize_failed' END AS status,
         CASE event_type WHEN 'click' THEN 'fence' WHEN 'view' THEN 'object' WHEN 'purchase' THEN 'fence_tidied' WHEN 'signup' THEN 'object_closed'
              ELSE CASE WHEN k < 60 THEN NULL WHEN k < 70 THEN 'raw' ELSE 'object' END END AS tier,
         CASE WHEN event_type = 'error' AND k < 60 THEN false ELSE event_type = 'signup' END AS recovered,
         CASE WHEN event_type <> 'error' THEN 'P' || user_id WHEN k >= 60 AND k < 80 THEN 'UNKNOWN' WHEN k >= 90 THEN 'Q' END AS parish,
         CASE WHEN event_type <> 'error' OR (k >= 60 AND k < 80) THEN event_type WHEN k >= 90 THEN NULL END AS townland
  FROM usable)
"""


def _shown(result):
    return result.select(
        "custom_id", "page_file", "status", "tier", "recovered",
        F.get_json_object("document", "$.parishes[0].parish").alias("parish"),
        F.get_json_object("document", "$.parishes[0].entries[0].townland").alias("townland"),
    )


@case("reply_finalise_chat", f"WITH {_REPLIES_SQL} SELECT * FROM results")
def finalise_chat(spark, folder):
    replies, _ = latest_replies(parse_chat_replies(_chat_lines(spark, folder)))
    return _shown(finalise_replies(replies))


@case("reply_finalise_generate", f"WITH {_REPLIES_SQL} SELECT * FROM results")
def finalise_generate(spark, folder):
    replies, _ = latest_replies(parse_generate_replies(_generate_lines(spark, folder)))
    return _shown(finalise_replies(replies))


@case(
    "reply_errors",
    f"""WITH {_REPLIES_SQL} SELECT custom_id, '{{"message":"boom"}}' AS error FROM base WHERE event_type = 'error' AND k >= 95""",
)
def errors_of_replies(spark, folder):
    return latest_replies(parse_chat_replies(_chat_lines(spark, folder)))[1]


_EXISTING_SQL = ", existing AS (SELECT DISTINCT custom_id FROM base WHERE value > 50)"


@case(
    "finalise_counts",
    f"""WITH {_REPLIES_SQL} {_EXISTING_SQL},
    s AS (SELECT CASE WHEN custom_id IN (FROM existing) THEN 'skipped_existing' ELSE status END AS status FROM results)
    SELECT count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'skipped_existing') AS skipped_existing,
           count(*) FILTER (status = 'parse_failed') AS parse_failed, count(*) FILTER (status = 'normalize_failed') AS normalize_failed,
           count(*) AS attempted FROM s""",
)
def count_refinalised(spark, folder):
    """The counts that the job gathers while it writes the pages."""
    counts = _refinalised(spark, folder)[1]
    return spark.createDataFrame([counts], ", ".join(f"{c} bigint" for c in (*STATUSES, "attempted")))


def _refinalised(spark, folder):
    replies, _ = latest_replies(parse_chat_replies(_chat_lines(spark, folder)))
    page = F.concat(F.lit("EV_LOG_"), F.col("user_id"), F.lit("_"), F.dayofmonth("ts"), F.lit(".jpg.json"))
    existing = table(spark, folder, "events").filter("value > 50").select(page.alias("page_file"))
    return finalise_counted(replies, existing, only_missing=True)


@case(
    "dead_letters",
    f"""WITH {_REPLIES_SQL} {_EXISTING_SQL}
    SELECT 'finalize' AS stage, 'chat' AS provider, custom_id,
           CASE WHEN status = 'parse_failed' THEN 'no JSON found in reply' ELSE 'document shape rejected' END AS error, custom_id AS local_path
    FROM results WHERE status IN ('parse_failed', 'normalize_failed') AND custom_id NOT IN (FROM existing)""",
)
def failures_of_replies(spark, folder):
    return dead_letters(_refinalised(spark, folder)[0], "chat")


def _jobs(spark, folder):
    """Images named by documents, then by pages (with folder), then by labels; later sources win."""
    documents = table(spark, folder, "documents").select(
        F.concat(F.lit("EV_LOG_"), F.regexp_extract("source", r"\d+", 0), F.lit("_"), F.col("doc_id"), F.lit(".jpg")).alias("name"), "doc_id"
    )
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("scans/extra/EV_LOG_7_"), F.col("page_id"), F.lit(".jpg")).alias("name"), "page_id"
    )
    labels = table(spark, folder, "labels").select(F.concat(F.lit("# "), F.col("doc_id")).alias("name"), "doc_id")
    return image_jobs([(documents, "name", "doc_id"), (pages, "name", "page_id"), (labels, "name", "doc_id")], "scans")


_JOBS_SQL = """
named AS (
  SELECT 0 AS source, doc_id AS row, 'EV_LOG_' || source[4:] || '_' || doc_id || '.jpg' AS custom_id, lpad(source[4:], 3, '0') AS volume FROM documents
  UNION ALL SELECT 1, page_id, 'EV_LOG_7_' || page_id || '.jpg', NULL FROM pages),
jobs AS (
  SELECT custom_id, CASE WHEN volume IS NULL THEN 'scans/extra/' || custom_id ELSE 'scans/' || volume || '/' || custom_id END AS local_path,
         'scans/' || lpad(split_part(custom_id, '_', 3), 3, '0') || '/' || custom_id AS r2_key,
         min(source) OVER (PARTITION BY custom_id) AS first_source
  FROM named QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY source DESC, row DESC) = 1)
"""


@case("image_jobs", f"WITH {_JOBS_SQL} SELECT * FROM jobs")
def collect_jobs(spark, folder):
    return _jobs(spark, folder).select("custom_id", "local_path", "r2_key", F.col("first_at.source").alias("first_source"))


_PROMPT = 'Read the "table".\nReturn JSON.'


@case(
    "build_requests_chat",
    f"""WITH {_JOBS_SQL}
    SELECT custom_id, local_path, r2_key, 'https://img.example/' || r2_key AS public_url, 'https://img.example/' || r2_key AS sent_url,
           'Read the "table".' || chr(10) || 'Return JSON.' AS sent_prompt, 'm1' AS sent_model, 16000 AS sent_limit, 'run1' AS run_id FROM jobs""",
)
def chat_requests(spark, folder):
    requests = request_rows(_jobs(spark, folder), "chat", _PROMPT, "https://img.example/", model="m1")
    sent = requests.select(
        "custom_id",
        F.get_json_object("request", "$.body.messages[0].content[0].image_url.url").alias("sent_url"),
        F.get_json_object("request", "$.body.messages[0].content[1].text").alias("sent_prompt"),
        F.get_json_object("request", "$.body.model").alias("sent_model"),
        F.get_json_object("request", "$.body.max_completion_tokens").cast("int").alias("sent_limit"),
    )
    return manifest_rows(requests, run_id="run1").join(sent, "custom_id")


@case(
    "build_requests_inline",
    """SELECT 'P' || page_id AS key, base64(encode(html)) AS sent_image, 'image/jpeg' AS sent_type, 65536 AS sent_limit FROM pages""",
)
def inline_requests(spark, folder):
    pages = table(spark, folder, "pages").select(F.concat(F.lit("P"), F.col("page_id")).alias("custom_id"), F.encode("html", "UTF-8").alias("content"))
    jobs = pages.select("custom_id", F.col("custom_id").alias("local_path"), F.col("custom_id").alias("r2_key"))
    images = pages.select(F.col("custom_id").alias("path"), "content")
    requests = request_rows(jobs, "generate", _PROMPT, images=images)
    first = "$.request.contents[0].parts[0].inline_data"
    return requests.select(
        F.get_json_object("request", "$.key").alias("key"),
        F.regexp_replace(F.get_json_object("request", f"{first}.data"), r"\s", "").alias("sent_image"),
        F.get_json_object("request", f"{first}.mime_type").alias("sent_type"),
        F.get_json_object("request", "$.request.generationConfig.maxOutputTokens").cast("int").alias("sent_limit"),
    )


@case(
    "name_validate",
    """
    WITH n AS (SELECT DISTINCT list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS target_filename FROM pages)
    SELECT target_filename, regexp_matches(target_filename, '(?i)^[0-9]+\\.html?$') AS is_valid_name FROM n WHERE target_filename <> ''""",
)
def validate_page_names(spark, folder):
    lines = table(spark, folder, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("value"))
    return validate_names(finalise_names(names_from_lines(lines)), pattern=r"(?i)^[0-9]+\.html?$")


@case(
    "name_list",
    """SELECT list_last(string_split(trim(p_type || '/' || p_name), '/')) AS target_filename FROM part WHERE p_size > 10""",
)
def names_of_parts(spark, folder):
    path = F.when(F.col("p_size") > 10, F.concat("p_type", F.lit("/"), "p_name"))
    return names_from_table(table(spark, folder, "part").select(path.alias("target_filename")))


@case(
    "work_left",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unlabelled_documents(spark, folder):
    return work_left(table(spark, folder, "documents").select("doc_id", "n_chars"), table(spark, folder, "labels"), ["doc_id"])


@case(
    "sync_plan",
    """SELECT 'up/' || source || '/' || d.doc_id AS key, n_chars AS length FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE l.doc_id IS NULL OR quality = 0""",
)
def documents_to_send(spark, folder):
    documents = table(spark, folder, "documents")
    key = F.concat("source", F.lit("/"), "doc_id")
    local = documents.select(key.alias("key"), F.col("n_chars").alias("length"))
    remote = documents.join(table(spark, folder, "labels"), "doc_id").select(
        F.concat(F.lit("up/"), key).alias("key"), (F.col("n_chars") + F.when(F.col("quality") == 0, 1).otherwise(0)).alias("length")
    )
    return sync_plan(local, remote, "/up/")


@case(
    "last_wins",
    """SELECT user_id, arg_max(event_type, ts) AS event_type, CAST(round(arg_max(value, ts) * 100) AS BIGINT) AS value, epoch_us(min(ts)) AS first_at
    FROM events GROUP BY 1""",
)
def last_event_per_user(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_type", cents("value").alias("value"), "ts")
    kept = keep_last(events, ["user_id"], "ts")
    return kept.select("user_id", "event_type", "value", F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_at"))
