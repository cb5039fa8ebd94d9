"""Not-modified revisits of web captures: who they repeat, and the headers that result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.llm.base import case, table
from ledgerline.operators.ordering import BLOCK, ROW, order_rows
from ledgerline.operators.skew import attach

# Headers that a 304 answer may renew in the stored one, and tracking parameters of URLs.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid|msclkid|mc_cid|mc_eid)(=.*)?$"
SCHEME = "^[a-z][a-z0-9+.-]*://"
WEAK = "^[Ww]/"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, port 80 or 443 and user; path without a last slash; sorted parameters
    without tracking ones; no scheme, no fragment. Null stays null, an unusual URL is taken as host and path."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(url), "#.*$", ""), "(?i)" + SCHEME, "")
    place = F.regexp_replace(bare, "\\?.*$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    host = F.lower(F.regexp_extract(place, "^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[0-9]*\\.", ""), ":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(place, "^[^/]*(.*)$", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lower_names(headers: Column) -> Column:
    """Headers by lower-case name; the last of equal names (in map order) wins."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    lower = F.transform(pairs, lambda p: F.struct(F.lower(p["key"]).alias("key"), p["value"].alias("value")))
    last = F.filter(lower, lambda p, i: ~F.exists(F.slice(lower, i + 2, F.size(lower)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def with_latest(ordered: DataFrame, url: str, response: Column, name: str) -> DataFrame:
    """As-of join on captures numbered by (URL, time): the last response of the same URL up to each row, null before the first.

    Inside a block of the order it is carried down by a window. A block hands the last response of its last URL to the
    next one; blocks that lie within one URL and hold no response hand on what they were handed, which one row per block decides.
    """
    rows = ordered.withColumn("_response", response)
    up_to = Window.partitionBy(BLOCK, url).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(BLOCK).agg(
        F.min_by(url, ROW).alias("_first_url"), F.max_by(url, ROW).alias("_last_url"),
        F.max_by(F.struct(F.col(url).alias("url"), F.col("_response").alias("response")), F.when(F.col("_response").isNotNull(), F.col(ROW))).alias("_last"),
    )
    ends = ends.withColumn("_own", F.when(F.col("_last.url") == F.col("_last_url"), F.col("_last.response")))
    of_url = Window.partitionBy("_last_url").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    by_block = Window.orderBy(BLOCK)  # one row per block
    handed = ends.withColumn("_known", F.last("_own", ignorenulls=True).over(of_url)).select(
        BLOCK, F.lag("_last_url").over(by_block).alias("_handed_url"), F.lag("_known").over(by_block).alias("_handed")
    )
    inside = F.last("_response", ignorenulls=True).over(up_to)
    found = rows.withColumn(name, inside).join(handed, BLOCK)
    carried = F.when(F.col(url) == F.col("_handed_url"), F.col("_handed"))
    return found.withColumn(name, F.coalesce(name, carried)).drop("_response", "_handed", "_handed_url")


def resolve_revisits(
    captures: DataFrame,
    record_id: str = "record_id",
    url: str = "url",
    time: str = "ts",
    is_revisit: str = "is_revisit",
    headers: str = "headers",
    digest: str = "digest",
    payload: str | None = None,
    permitted: Sequence[str] = PERMITTED,
) -> DataFrame:
    """Each revisit with the latest earlier full response of its canonical URL.

    Returns record_id, response_id, status, headers, digest and, if ``payload`` names a column, the
    payload of the response. Status:

    * ``resolved``: the validators agree – the entity tag (weakly compared) where the revisit has
      one, else its last-modified time, else its payload digest;
    * ``mismatch``: they do not, or the response lacks the one to compare;
    * ``no_validator``: the revisit has none;
    * ``no_response``: there is no response at an earlier time, or the URL or time is null.

    A resolved revisit has the response's headers with the permitted ones of its own laid over;
    others keep their own headers, and have no digest and no payload of the response. Header names are
    in lower case. Responses of one time: the greatest record id is the latest. A null ``is_revisit``
    counts as a response. Repeated rows repeat. Captures are range-sorted by URL and
    time, so a URL of any weight spreads over many blocks; payloads are not sorted.
    """
    own = _lower_names(F.col(headers))
    rows = captures.select(
        F.coalesce(canonical_url(F.col(url)), F.lit("")).alias("_url"),
        F.col(time).alias("_ts"),
        F.when(F.coalesce(F.col(is_revisit), F.lit(False)), 0).otherwise(1).alias("_full"),  # a response is not earlier than a revisit of its time
        F.col(record_id).alias("record_id"),
        own.alias("_headers"),
        F.col(digest).cast("string").alias("_digest"),
    )
    ordered = order_rows(rows, ["_url", "_ts", "_full", "record_id"])
    usable = (F.col("_full") == 1) & (F.col("_url") != "") & F.col("_ts").isNotNull()
    response = F.when(usable, F.struct("record_id", "_headers", "_digest"))
    filled = with_latest(ordered, "_url", response, "_of").filter("_full = 0").drop(ROW, BLOCK)
    mine, theirs = F.col("_headers"), F.col("_of._headers")
    tag = lambda h: F.regexp_replace(F.btrim(h["etag"]), WEAK, "")
    agrees = (
        F.when(mine["etag"].isNotNull(), tag(mine) == tag(theirs))
        .when(mine["last-modified"].isNotNull(), F.btrim(mine["last-modified"]) == F.btrim(theirs["last-modified"]))
        .when(F.col("_digest").isNotNull(), F.col("_digest") == F.col("_of._digest"))
    )
    some = mine["etag"].isNotNull() | mine["last-modified"].isNotNull() | F.col("_digest").isNotNull()
    status = (
        F.when(F.col("_of").isNull() | F.col("_ts").isNull() | (F.col("_url") == ""), "no_response")
        .when(~some, "no_validator")
        .when(F.coalesce(agrees, F.lit(False)), "resolved")
        .otherwise("mismatch")
    )
    may = F.map_filter(mine, lambda k, _: k.isin(*permitted))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(may), k)), may)
    resolved = F.col("status") == "resolved"
    out = filled.withColumn("status", status).select(
        "record_id",
        F.when(F.col("status") != "no_response", F.col("_of.record_id")).alias("response_id"),
        "status",
        F.when(resolved, merged).otherwise(mine).alias("headers"),
        F.when(resolved, F.col("_of._digest")).alias("digest"),
    )
    if payload is None:
        return out
    full = ~F.coalesce(F.col(is_revisit), F.lit(False)) & F.col(record_id).isNotNull()
    bodies = captures.filter(full).select(F.col(record_id).alias("_wanted"), F.col(payload).alias("payload")).dropDuplicates(["_wanted"])
    keyed = out.withColumn("_wanted", F.when(resolved, F.col("response_id")))
    return attach(keyed, bodies, ["_wanted"], F.pmod(F.xxhash64("record_id"), F.lit(64)).cast("int")).drop("_wanted")


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl history of the pages: a response and up to two later looks at each, by rules on the page id.

    Looks use other forms of the URL. By page id they carry the page's tag in weak form, a changed
    tag, only the time, only the digest or nothing to compare; some come before the response.
    """
    i, tag = F.col("page_id"), F.substring(F.md5("html"), 1, 16)
    quoted = F.concat(F.lit('"'), tag, F.lit('"'))
    since = F.concat(F.lit("day "), i)

    def headers(**named: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("k"), v.cast("string").alias("v")) for k, v in named.items()])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))

    answer = F.struct(
        (i * 4).alias("record_id"), F.col("url").alias("url"), (i * 10).alias("ts"), F.lit(False).alias("is_revisit"),
        headers(Content_Type=F.lit("text/html"), ETag=quoted, Last_Modified=since, Date=i * 10, Cache_Control=F.lit("max-age=60")).alias("headers"),
        F.md5("html").alias("digest"), F.col("html").alias("html"),
    )

    def look(n: int) -> Column:
        when = F.when(i % 7 == 0, i * 10 - n).otherwise(i * 10 + 1440 * n)
        bare = F.regexp_replace("url", "^https?://", "")
        other = F.concat(F.lit("HTTP://www."), F.regexp_replace(bare, "#.*$", ""))
        uri = F.when(other.contains("?"), F.concat(other, F.lit("&utm_medium=x"))).otherwise(F.concat(other, F.lit("?utm_medium=x#end")))
        etag = F.when(i % 5 == 0, F.lit('"changed"')).when(i % 5 > 2, F.concat(F.lit("W/"), quoted))
        return F.struct(
            (i * 4 + n).alias("record_id"), uri.alias("url"), when.alias("ts"), F.lit(True).alias("is_revisit"),
            headers(Content_Type=F.lit("text/plain"), ETag=etag, Last_Modified=F.when(i % 5 == 1, since), Date=when, Cache_Control=F.lit("max-age=120")).alias("headers"),
            F.when((i % 5 == 2) & (i % 2 == 0), F.md5("html")).alias("digest"), F.lit(None).cast("string").alias("html"),
        )

    every = F.array_compact(F.array(answer, look(1), F.when(i % 2 == 0, look(2))))
    return pages.select(F.inline(every))


_CANONICAL = r"""
  SELECT *, regexp_replace(regexp_replace(trim(uri), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '', 'i') AS bare FROM captures),
parts AS (
  SELECT *, regexp_replace(bare, '\?.*$', '') AS place, regexp_extract(bare, '\?(.*)$', 1) AS query FROM bared),
canonical AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid|msclkid|mc_cid|mc_eid)(=.*)?$'))) AS kept,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(place, '^([^/]*)', 1)), '^.*@', ''), '^www[0-9]*\.', ''), ':(80|443)?$', '')
           || regexp_replace(regexp_extract(place, '^[^/]*(.*)$', 1), '/+$', '') AS where_
  FROM parts),
keyed AS (SELECT *, where_ || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS curl FROM canonical),
"""

OP1_SQL = rf"""
WITH looks AS (
  SELECT page_id AS i, html, n, CASE WHEN page_id % 7 = 0 THEN page_id * 10 - n ELSE page_id * 10 + 1440 * n END AS ts,
         'HTTP://www.' || regexp_replace(regexp_replace(url, '^https?://', ''), '#.*$', '') AS other
  FROM pages, (VALUES (1), (2)) AS v(n) WHERE n = 1 OR page_id % 2 = 0),
captures AS (
  SELECT page_id * 4 AS record_id, url AS uri, page_id * 10 AS ts, false AS is_revisit, '"' || md5(html)[1:16] || '"' AS etag,
         'day ' || page_id AS since, md5(html) AS digest, html, 'text/html' AS kind, 'max-age=60' AS cache
  FROM pages
  UNION ALL
  SELECT i * 4 + n, CASE WHEN contains(other, '?') THEN other || '&utm_medium=x' ELSE other || '?utm_medium=x#end' END, ts, true,
         CASE WHEN i % 5 = 0 THEN '"changed"' WHEN i % 5 > 2 THEN 'W/"' || md5(html)[1:16] || '"' END,
         CASE WHEN i % 5 = 1 THEN 'day ' || i END, CASE WHEN i % 5 = 2 AND i % 2 = 0 THEN md5(html) END, NULL, 'text/plain', 'max-age=120'
  FROM looks),
bared AS ({_CANONICAL}
ranked AS (
  SELECT r.record_id, r.etag, r.since, r.digest, r.ts, r.kind, r.cache, f.record_id AS response_id, f.etag AS f_etag, f.since AS f_since,
         f.digest AS f_digest, f.ts AS f_ts, f.html AS f_html
  FROM keyed r LEFT JOIN keyed f ON NOT f.is_revisit AND f.curl = r.curl AND f.ts < r.ts
  WHERE r.is_revisit
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) = 1),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
                 WHEN etag IS NULL AND since IS NULL AND digest IS NULL THEN 'no_validator'
                 WHEN coalesce(CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^[Ww]/', '') = f_etag
                                    WHEN since IS NOT NULL THEN since = f_since ELSE digest = f_digest END, false) THEN 'resolved'
                 ELSE 'mismatch' END AS status
  FROM ranked)
SELECT record_id, response_id, status,
       'cache-control: ' || cache || chr(10) || 'content-type: ' || CASE WHEN status = 'resolved' THEN 'text/html' ELSE kind END || chr(10) || 'date: ' || ts
         || CASE WHEN status = 'resolved' THEN chr(10) || 'etag: ' || coalesce(etag, f_etag) WHEN etag IS NOT NULL THEN chr(10) || 'etag: ' || etag ELSE '' END
         || CASE WHEN status = 'resolved' THEN chr(10) || 'last-modified: ' || coalesce(since, f_since) WHEN since IS NOT NULL THEN chr(10) || 'last-modified: ' || since ELSE '' END
         AS headers,
       CASE WHEN status = 'resolved' THEN f_digest END AS digest,
       CASE WHEN status = 'resolved' THEN md5(f_html) END AS payload_md5
FROM judged
"""


@case("op1_warc_revisits", OP1_SQL)
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits in the crawl history of all pages, with the payload they stand for."""
    found = resolve_revisits(captures_of(table(spark, sf_dir, "pages")), payload="html")
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda h: F.concat(h["key"], F.lit(": "), h["value"]))
    return found.select(
        "record_id", "response_id", "status", F.array_join(lines, "\n").alias("headers"), "digest", F.md5("payload").alias("payload_md5")
    )
