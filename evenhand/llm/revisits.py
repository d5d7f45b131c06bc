"""Not-modified revisits of a web archive, resolved to the response they refer to.

A revisit record says that a page had not changed; its headers are there, its body is not. The body is that of the
latest earlier full response of the same canonical URL, if the validators agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.scratch import Scratch

# --- fixed values -------------------------------------------------------------------------------
#: Header fields that a not-modified answer may renew in the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name a visit, not a page.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|phpsessid|jsessionid|sessionid|sid|ref)(=|$)"
# --------------------------------------------------------------------------------------------------

#: Rows of one URL and time slice that a window may get on average if one URL has all rows.
SLICE_ROWS = 200_000


def canonical(url: Column) -> Column:
    """Host, path and sorted query: no scheme, user, ``www``, default port, fragment, tracking or final slash."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:(80|443)?)?$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    args = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda a: (a != "") & ~F.lower(a).rlike(TRACKING))
    query = F.array_join(F.sort_array(args), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the first in the map's order stays."""
    pairs = F.map_entries(headers)
    named = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(named, lambda e: e["key"])
    first = F.filter(named, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.map_from_entries(F.coalesce(first, F.expr("CAST(array() AS array<struct<key:string,value:string>>)")))


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers with the permitted fresh ones in their place."""
    renew = F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    stay = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(renew), k))
    return F.map_concat(stay, renew)


def earlier_responses(records: DataFrame) -> DataFrame:
    """As-of join: ``revisit_id, response_id`` (null without one) for every revisit.

    Time is cut into slices; within a URL and slice a window finds the last full response before each revisit. Where
    there is none, the last one of an earlier slice is carried over from a table of one row per URL and slice. So a URL
    with a large part of all captures is spread over the slices.
    """
    key = canonical(F.col("url"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = records.select(
        "record_id", "ts", key.alias("key"), (F.col("kind") == "revisit").alias("asks"),
        F.when(full & F.col("record_id").isNotNull(), F.struct("ts", "record_id")).alias("full"),
    ).filter("key IS NOT NULL AND ts IS NOT NULL AND (asks OR full IS NOT NULL)")
    low, high, n = rows.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    slices = max(64, -(-n // SLICE_ROWS))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // slices))
    rows = rows.withColumn("slice", F.floor((F.col("ts") - F.lit(low or 0)) / width).cast("int"))
    order = W.partitionBy("key", "slice").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("found", F.last("full", ignorenulls=True).over(order)).filter("asks")
    ends = rows.groupBy("key", "slice").agg(F.max("full").alias("full"), F.max("asks").alias("asks"))
    before = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("full", ignorenulls=True).over(before)).filter("asks AND carried IS NOT NULL")
    both = inside.join(carried.select("key", "slice", "carried"), ["key", "slice"], "left")
    return both.select(F.col("record_id").alias("revisit_id"), F.coalesce("found", "carried")["record_id"].alias("response_id"))


def weak(tag: Column) -> Column:
    """An entity tag without its weakness mark: a not-modified answer compares weakly."""
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def _one_each(records: DataFrame) -> DataFrame:
    """The records without those that repeat an id. Repeats are found on narrow rows and only they are folded."""
    names = ["record_id", "url", "ts", "kind", "status", "headers", "payload"]
    rows = records.select(*names)
    keys = ["record_id", "kind"]
    again = rows.filter("record_id IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*keys)
    again = Scratch(records.sparkSession).table(again)  # written, so that joins know how few there are and leave payloads in place
    single = rows.join(again, keys, "left_anti")
    place = F.struct("ts", F.xxhash64("url", "payload"))
    kept = F.min_by(F.struct(*[c for c in names if c not in keys]), place).alias("r")
    folded = rows.join(again, keys, "left_semi").groupBy(*keys).agg(kept).select(*keys, "r.*")
    return single.unionByName(folded.select(*names))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: ``revisit_id, url, ts, outcome, response_id, headers, payload``.

    ``records`` has ``record_id, url, ts, kind`` ('response' or 'revisit'), ``status, headers`` (a map) and ``payload``;
    other columns are ignored. Rows that repeat a ``record_id`` and kind are one record: the earliest of them, of
    equal times the one whose URL and payload hash least; rows without an id stay as they are. A full response has
    status 200. Earlier means a smaller
    time, or the same time and a smaller id. Outcomes:

    * ``resolved``: the revisit's entity tag equals the response's (weak comparison); without a tag, its Last-Modified
      does. Headers are the response's with the permitted ones of the revisit; the payload is the response's.
    * ``changed``: the validator named does not agree. ``no_validator``: the revisit names none.
    * ``no_response``: no earlier full response, or no URL or time to look by.

    Only ``resolved`` rows have headers and payload. Null headers count as none. An empty table gives no rows.
    """
    records = _one_each(records)
    pairs = earlier_responses(records)
    asks = records.filter(F.col("kind") == "revisit").select(
        F.col("record_id").alias("revisit_id"), "url", "ts", lower_names(F.col("headers")).alias("fresh"))
    full = records.filter((F.col("kind") == "response") & (F.col("status") == 200))
    full = full.select(F.col("record_id").alias("response_id"), lower_names(F.col("headers")).alias("stored"), "payload")
    both = asks.join(pairs, "revisit_id", "left").join(full, "response_id", "left")
    tag, since = F.col("fresh")["etag"], F.col("fresh")["last-modified"]
    agrees = F.when(tag.isNotNull(), weak(tag) == weak(F.col("stored")["etag"])).otherwise(F.trim(since) == F.trim(F.col("stored")["last-modified"]))
    outcome = (
        F.when(F.col("response_id").isNull(), "no_response").when(tag.isNull() & since.isNull(), "no_validator")
        .when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("changed")
    )
    done = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "revisit_id", "url", "ts", "outcome", "response_id", F.when(done, merged(F.col("stored"), F.col("fresh"))).alias("headers"),
        F.when(done, F.col("payload")).alias("payload"),
    )


def header_text(headers: Column) -> Column:
    """``name: value`` lines by name."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def records_from_pages(pages: DataFrame) -> DataFrame:
    """Archive records that follow from a table of pages, since the table holds bodies and URLs only.

    Each page is a response, a minute after the page before it, and is visited again up to five minutes later under
    its URL with a fragment. The validators of that visit go by the page's number: the same tag, the tag marked weak, a
    wrong tag, the right date, a wrong date, none. Every eleventh response is a partial one.
    """
    number, seen = F.col("page_id"), F.lit(1_700_000_000) + F.col("page_id") * 60
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    later = seen + 30 + F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(5)) * 60
    case = F.pmod(number, F.lit(6))
    text = lambda c: c.cast("string")
    first = F.map_from_arrays(
        F.array(*map(F.lit, ("Cache-Control", "Content-Length", "Content-Type", "Date", "ETag", "Last-Modified"))),
        F.array(F.lit("max-age=60"), text(F.coalesce(F.octet_length("html"), F.lit(0))), F.lit("text/html; charset=utf-8"), text(seen), tag, text(seen - 3600)),
    )
    etag = F.when(case == 0, tag).when(case == 1, F.concat(F.lit("W/"), tag)).when(case == 2, F.lit('"other"'))
    since = F.when(case == 3, text(seen - 3600)).when(case == 4, text(seen - 7200))
    again = F.map_filter(
        F.map_from_arrays(
            F.array(*map(F.lit, ("cache-control", "connection", "content-length", "date", "etag", "last-modified"))),
            F.array(F.lit("max-age=120"), F.lit("keep-alive"), F.lit("0"), text(later), etag, since),
        ),
        lambda _, v: v.isNotNull(),
    )
    response = pages.select(
        (number * 2).alias("record_id"), "url", seen.alias("ts"), F.lit("response").alias("kind"),
        F.when(F.pmod(number, F.lit(11)) == 10, 206).otherwise(200).alias("status"), first.alias("headers"), F.col("html").alias("payload"))
    revisit = pages.select(
        (number * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)
