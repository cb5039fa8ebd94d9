"""Cases for scalar functions and page documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.functions.documents import document_statistics
from ledgerline.operators.lookup import admin_records
from ledgerline.plans.cases.base import case, cents, money_sql, table
from ledgerline.sinks import page_display
from ledgerline.sources.pages import fill_names, flatten_documents, read_documents, store_documents


@case(
    "flag_coerce",
    """
    SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 1) AS flag,
           1 AS bad_flag, 0 AS missing_flag,
           CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS BIGINT) AS number, CAST(0 AS BIGINT) AS bad_number
    FROM events""",
)
def coerce_flags(spark, folder):
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select(
        "event_id",
        T.to_int(k, 1).alias("flag"),
        T.to_int("event_type", 1).alias("bad_flag"),
        T.to_int(F.get_json_object("props", "$.absent"), 0).alias("missing_flag"),
        T.to_number(k).cast("bigint").alias("number"),
        T.to_number("event_type").cast("bigint").alias("bad_number"),
    )


_PENCE = "CAST(round(o_totalprice * 100) AS BIGINT)"


@case(
    "money_roundtrip",
    f"""
    WITH p AS (SELECT o_orderkey, o_orderstatus, {_PENCE} AS pence FROM orders)
    SELECT o_orderkey, {money_sql('pence')} AS text, pence AS back, pence AS signed,
           CASE WHEN o_orderstatus = 'F' THEN (pence // 240) * 12 + (pence % 240) // 12
                WHEN o_orderstatus = 'O' THEN ((pence % 240) // 12) * 12 + pence % 12
                ELSE pence END AS literal,
           -((pence + 239) // 240) || ' ' || (((240 - pence % 240) % 240) // 12) || ' ' || (((240 - pence % 240) % 240) % 12) AS negative,
           CAST(0 AS BIGINT) AS too_short
    FROM p""",
)
def money_both_ways(spark, folder):
    text = T.from_pence(cents("o_totalprice"))
    sign = F.when(F.col("o_orderstatus") == "F", "£ ").when(F.col("o_orderstatus") == "O", "£").otherwise("")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        text.alias("text"),
        T.to_pence(text).alias("back"),
        T.to_pence(F.concat(sign, text)).alias("signed"),
        T.to_pence(F.concat(sign, text), strip_currency=False).alias("literal"),
        T.from_pence(-cents("o_totalprice")).alias("negative"),
        T.to_pence(F.substring_index(text, " ", 2)).alias("too_short"),
    )


_NORMAL = "trim(regexp_replace(translate(lower(trim({c})), '''`.,;:-', ''), '\\s+', ' ', 'g'))"


def normal_sql(c: str) -> str:
    return _NORMAL.format(c=c)


def parish_sql(c: str) -> str:
    out = f"trim(regexp_replace({normal_sql(c)}, '^(parish of |parish )', ''))"
    for suffix in (r" \(part of\)", r" \(part of\.\)", " part of", "—continued", " continued"):
        out = f"trim(regexp_replace({out}, '{suffix}$', ''))"
    return out


_LABEL_SQL = """(CASE p_type WHEN 'ECONOMY' THEN 'PARISH OF ' WHEN 'SMALL' THEN ' Parish  ' WHEN 'LARGE' THEN '''St. ' ELSE '' END || p_name
  || CASE p_brand WHEN 'Brand#1' THEN ' (part of)' WHEN 'Brand#2' THEN '—Continued' WHEN 'Brand#3' THEN ' continued.' WHEN 'Brand#4' THEN ' part-of' ELSE '' END)"""


@case(
    "normalise_names",
    f"""
    WITH l AS (SELECT p_partkey, {_LABEL_SQL} AS label FROM part)
    SELECT p_partkey, label, {normal_sql('label')} AS name, {parish_sql('label')} AS parish,
           upper(translate(label, '- .', '')) AS squashed, trim(label) AS key
    FROM l""",
)
def normalise_labels(spark, folder):
    start = (
        F.when(F.col("p_type") == "ECONOMY", "PARISH OF ")
        .when(F.col("p_type") == "SMALL", " Parish  ")
        .when(F.col("p_type") == "LARGE", "'St. ")
        .otherwise("")
    )
    end = F.col("p_brand")
    ends = {"Brand#1": " (part of)", "Brand#2": "—Continued", "Brand#3": " continued.", "Brand#4": " part-of"}
    suffix = F.lit("")
    for brand, text in ends.items():
        suffix = F.when(end == brand, text).otherwise(suffix)
    label = F.concat(start, F.col("p_name"), suffix)
    return table(spark, folder, "part").select(
        "p_partkey", label.alias("label"), T.normalise_name(label).alias("name"), T.normalise_parish(label).alias("parish"),
        T.squash(label).alias("squashed"), T.clean_key(label).alias("key"),
    )


@case(
    "normalise_titles",
    f"""
    WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
    SELECT page_id, {normal_sql('title')} AS name, upper(replace(translate(title, '- .', ''), 'ß', 'SS')) AS squashed FROM t""",
)
def normalise_page_titles(spark, folder):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, folder, "pages").select("page_id", T.normalise_name(title).alias("name"), T.squash(title).alias("squashed"))


@case(
    "path_algebra",
    """
    WITH n AS (
      SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS path,
             list_last(string_split(path, '/')) AS base,
             'EV_LOG_' || split_part(path, '.', 1) || '_' || page_id || '.jpg' AS image
      FROM pages)
    SELECT page_id, base, CASE WHEN length(split_part(path, '.', 1)) < 3 THEN lpad(split_part(path, '.', 1), 3, '0') ELSE split_part(path, '.', 1) END AS volume,
           'scans/' || CASE WHEN length(split_part(path, '.', 1)) < 3 THEN lpad(split_part(path, '.', 1), 3, '0') ELSE split_part(path, '.', 1) END || '/' || image AS local_path,
           'raw/a/' || path AS prefixed, image || '.json' AS result, base || '.jpg.json' AS bare_result,
           regexp_matches(base, '(?i)^[0-9]+\\.html?$') AS is_valid
    FROM n""",
)
def path_parts(spark, folder):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    image = F.concat(F.lit("EV_LOG_"), F.substring_index(path, ".", 1), F.lit("_"), F.col("page_id"), F.lit(".jpg"))
    return table(spark, folder, "pages").select(
        "page_id",
        T.basename(path).alias("base"),
        T.volume_of(image).alias("volume"),
        T.image_path(image, "scans").alias("local_path"),
        T.with_prefix(path, " /raw/a/ ").alias("prefixed"),
        T.result_name(image).alias("result"),
        T.result_name(T.basename(path)).alias("bare_result"),
        T.is_page_name(T.basename(path), r"(?i)^[0-9]+\.html?$").alias("is_valid"),
    )


@case(
    "admin_records",
    f"""
    SELECT p_brand AS page, p_partkey AS row_no,
           CASE WHEN p_size > 40 THEN 'GV ' || p_size WHEN p_size > 20 THEN 'C ' || p_size ELSE '' END AS county_effective,
           p_type AS barony_effective,
           CASE WHEN p_type = 'SMALL' THEN p_name || ' gv' ELSE 'PARISH OF ' || p_name END AS parish_effective,
           CAST(CASE WHEN p_type = 'SMALL' THEN 3 ELSE 2 END AS INT) AS parish_keys
    FROM part""",
)
def records_of_parts(spark, folder):
    truth = part_truth(spark, folder)
    return admin_records(truth).select(
        "page", "row_no", "rec.county_effective", "rec.barony_effective", "rec.parish_effective", F.size("parish_keys").alias("parish_keys")
    )


def part_truth(spark, folder):
    """Parts as truth rows: the brand is the page; small parts have no county."""
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("target_filename"),
        F.when(size > 20, F.concat(F.lit(" C "), size)).otherwise(F.lit("nan")).alias("county"),
        F.when(size > 40, F.concat(F.lit("GV "), size)).alias("county_gv"),
        F.col("p_type").alias("barony"),
        F.lit("").alias("barony_gv"),
        F.concat(F.lit("PARISH OF "), F.col("p_name")).alias("parish"),
        F.when(F.col("p_type") == "SMALL", F.concat(F.col("p_name"), F.lit(" gv"))).alias("parish_gv"),
        F.col("p_name").alias("townland"),
        F.col("p_partkey").alias("row_no"),
    )


def read_pages(spark, folder):
    """Documents as page JSON, read but not stored: a line is a block, a sentence an entry, its long first word the name."""

    def entry(sentence):
        word = F.substring_index(sentence, " ", 1)
        return F.struct(
            F.when(F.length(word) > 4, word).otherwise("").alias("townland"),
            sentence.alias("occupier"),
            F.substring(sentence, 1, 1).alias("sublocation_1"),
        )

    blocks = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.col("lang").alias("parish"), F.transform(F.split(line, r"\. "), entry).alias("entries")
        ),
    )
    text = F.to_json(F.struct(blocks.alias("parishes")))
    text = F.when(F.col("source") == "src3", F.substring_index(text, "]", 1)).when(F.col("source") == "src5", "").otherwise(text)
    pages = table(spark, folder, "documents").select(F.concat(F.lit("DOC_"), F.lpad("doc_id", 9, "0")).alias("page_name"), text.alias("text"))
    return read_documents(pages, "documents")


def document_pages(spark, folder):
    """The pages as a load stores them, and what it has counted."""
    return store_documents(read_pages(spark, folder))


_ENTRY_SQL = """
raw AS (
  SELECT 'DOC_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS page_name, lang, unnest(string_split(text, E'\\n')) AS line,
         generate_subscripts(string_split(text, E'\\n'), 1) - 1 AS parish_idx
  FROM documents WHERE source NOT IN ('src3', 'src5')),
entries AS (
  SELECT page_name, lang, parish_idx, unnest(string_split(line, '. ')) AS sentence, generate_subscripts(string_split(line, '. '), 1) - 1 AS entry_idx
  FROM raw),
named AS (
  SELECT *, CASE WHEN length(split_part(sentence, ' ', 1)) > 4 THEN split_part(sentence, ' ', 1) ELSE '' END AS townland_raw FROM entries)
"""


@case(
    "flatten_pages",
    f"""WITH {_ENTRY_SQL}
    SELECT page_name, CAST(parish_idx AS INT) AS parish_idx, CAST(entry_idx AS INT) AS entry_idx, lang AS parish, md5(sentence) AS occupier_md5, townland_raw,
           last_value(nullif(townland_raw, '') IGNORE NULLS) OVER (PARTITION BY page_name, parish_idx ORDER BY entry_idx ROWS UNBOUNDED PRECEDING) AS townland,
           coalesce(last_value(nullif(townland_raw, '') IGNORE NULLS) OVER (PARTITION BY page_name ORDER BY parish_idx, entry_idx ROWS UNBOUNDED PRECEDING), '') AS townland_filled,
           1 AS n_shared, 0 AS is_total
    FROM named""",
)
def flatten_document_pages(spark, folder):
    rows = fill_names(flatten_documents(read_pages(spark, folder)))
    return rows.select(
        "page_name", "parish_idx", "entry_idx", "parish", F.md5("occupier").alias("occupier_md5"), "townland_raw", "townland",
        "townland_filled", "n_shared", "is_total",
    )


@case(
    "page_statuses",
    """
    SELECT 'DOC_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS page_name,
           CASE source WHEN 'src3' THEN 'malformed' WHEN 'src5' THEN 'empty' ELSE 'ok' END AS status
    FROM documents""",
)
def statuses_of_pages(spark, folder):
    return document_pages(spark, folder)[0].select("page_name", "status")


@case(
    "load_counts",
    f"""WITH {_ENTRY_SQL}
    SELECT (SELECT count(DISTINCT page_name) FROM raw) AS pages, (SELECT count(*) FROM entries) AS entry_rows,
           (SELECT count(*) FROM documents WHERE source IN ('src3', 'src5')) AS skipped""",
)
def counts_of_load(spark, folder):
    """The counts that the job gathers while it stores the documents."""
    counts = document_pages(spark, folder)[1]
    return spark.createDataFrame([counts], "pages bigint, entry_rows bigint, skipped bigint")


@case(
    "document_statistics",
    f"""WITH {_ENTRY_SQL}
    SELECT page_name, CAST(count(DISTINCT parish_idx) AS INT) AS parishes, CAST(count(*) AS INT) AS entries,
           CAST(count(DISTINCT nullif(townland_raw, '')) AS INT) AS townlands
    FROM named GROUP BY 1""",
)
def statistics_of_documents(spark, folder):
    docs = document_pages(spark, folder)[0].filter("status = 'ok'")
    return docs.select("page_name", document_statistics(F.col("document")).alias("s")).select("page_name", "s.*")


@case(
    "page_display",
    f"""WITH {_ENTRY_SQL},
    c AS (
      SELECT *, left(sentence, 1) AS sub, row_number() OVER w = 1 OR lag(townland_raw) OVER w <> townland_raw AS new_name,
             lag(left(sentence, 1)) OVER w IS DISTINCT FROM left(sentence, 1) AS new_sub
      FROM named WINDOW w AS (PARTITION BY page_name, parish_idx ORDER BY entry_idx))
    SELECT page_name, CAST(parish_idx AS INT) AS parish_idx, CAST(entry_idx AS INT) AS entry_idx,
           CASE WHEN new_name THEN townland_raw ELSE '' END AS townland, CASE WHEN new_name OR new_sub THEN sub ELSE '' END AS sublocation_1
    FROM c""",
)
def display_of_pages(spark, folder):
    rows = fill_names(flatten_documents(read_pages(spark, folder)))
    return page_display(rows).select("page_name", "parish_idx", "entry_idx", "townland", "sublocation_1")
