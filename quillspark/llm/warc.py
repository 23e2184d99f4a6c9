"""Resolution of not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

Captures are dealt in ranges of (URL, time, record) of about equal numbers of rows, so that a URL with a large share of all
captures is worked on in many places, however its times lie: inside a range a window finds the latest response, and what
earlier ranges hold for the URL that goes on, one row for each range, is carried forward (operators.scan).
Bodies stay where they are; a resolved revisit names the response that holds its body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch
from quillspark.operators.scan import Scan

#: Header fields that a 304 response may renew (RFC 9110, 15.4.5; fixed values).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without a default port, path without a final slash, query without campaign fields, sorted.

    Scheme, user and fragment do not count. Null stays null; text without a scheme is taken as host and path.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda f: (f != "") & ~f.rlike("^utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def weak(etag: Column) -> Column:
    """The part of an entity tag that weak comparison looks at."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def lowered(headers: Column) -> Column:
    """Headers with lower-case names; of names that then coincide the last in name order stays."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))


def merged_headers(stored: Column, sent: Column) -> Column:
    """The stored response's headers, renewed by those that a 304 response may send."""
    renewed = F.map_filter(sent, lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(renewed, k))
    return F.map_concat(kept, renewed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, ts, status, response_id, digest, headers.

    records: record_id, url, ts, kind ("response" or "revisit"), etag, last_modified, digest and headers (a map).
    A revisit looks at the latest response of its URL with a smaller ts (of several, the largest record_id). Entity
    tags are compared weakly if both have one, else dates if both have one. status: resolved, etag-mismatch,
    date-mismatch, no-validator or no-earlier-response; only a resolved revisit gets response_id, digest and headers.
    A null URL or ts finds nothing; null headers are none; other kinds and further columns are ignored; repeated
    revisits give rows of their own; an empty table gives no rows.
    """
    empty = F.expr("cast(map() as map<string,string>)")
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "etag", "last_modified", "digest", F.coalesce(lowered(F.col("headers")), empty).alias("headers")
    )
    keep = Scratch(records.sparkSession)
    what = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    full = (F.col("kind") == "response") & F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    rows = rows.withColumn("_late", F.when(F.col("kind") == "response", 1).otherwise(0))  # at one ts, revisits stand before responses
    scan = Scan(rows, ["url_key"], ["ts", "_late", "record_id"], keep.stored, "captures").last("found", F.when(full, what))
    found = scan.rows.where(F.col("kind") == "revisit").withColumn("found", F.when(F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.col("found")))

    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    status = (
        F.when(F.col("found").isNull(), "no-earlier-response")
        .when(tags, F.when(weak(F.col("etag")) == weak(F.col("found.etag")), "resolved").otherwise("etag-mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("found.last_modified"), "resolved").otherwise("date-mismatch"))
        .otherwise("no-validator")
    )
    good = F.col("status") == "resolved"
    out = found.withColumn("status", status).select(
        "record_id",
        "url_key",
        "ts",
        "status",
        F.when(good, F.col("found.record_id")).alias("response_id"),
        F.when(good, F.col("found.digest")).alias("digest"),
        F.when(good, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )
    return keep.result(out, "revisits")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a page table: each page's full response, and one conditional request made some time after.

    The digest's first digit says what the later request sends: the response's entity tag, strong (0-5) or weak (6-8),
    its date alone (9-b), a tag that no longer fits (c-d), nothing (e), or its tag but before the first response (f).
    """
    digit = F.substring("digest", 1, 1)
    page = pages.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").alias("size"))
    tag, date = F.concat(F.lit('"'), F.col("digest"), F.lit('"')), F.col("page_id").cast("string")
    response = page.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        (F.col("page_id") * 2).alias("ts"),
        F.lit("response").alias("kind"),
        tag.alias("etag"),
        date.alias("last_modified"),
        "digest",
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size").cast("string"), F.lit("ETag"), tag, F.lit("Date"), date).alias("headers"),
    )
    sent = F.when(digit.between("0", "5"), tag).when(digit.between("6", "8"), F.concat(F.lit("W/"), tag)).when(digit.between("c", "d"), F.lit('"changed"')).when(digit == "f", tag)
    later = F.when(digit == "f", F.col("page_id") * 2 - 1).otherwise(F.col("page_id") * 2 + 101)
    revisit = page.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        "url",
        later.alias("ts"),
        F.lit("revisit").alias("kind"),
        sent.alias("etag"),
        F.when(digit.between("9", "b"), date).alias("last_modified"),
        F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Date"), later.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"), F.lit("Server"), F.lit("cache")).alias("headers"),
    )
    return response.unionByName(revisit)
