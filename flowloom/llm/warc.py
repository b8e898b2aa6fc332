"""Resolution of not-modified revisit records of web archives.

A revisit record holds no body: it says that a URL had not changed. It is
resolved by an as-of join to the latest earlier full response of the same
canonical URL. The validators of both are compared, and the headers that a
not-modified answer may update are merged into those of the stored response.

Hot URLs: records are dealt out in ranges of (URL, time), so that the records of
one URL spread over as many tasks as they need; the last response of each range
is carried over to the next range of that URL. Bodies take no part; they are
attached afterwards by the id of the response.

Edge cases: records are ordered by time, then id; a record without a URL, time
or id resolves to nothing (``no_key``); repeated records are resolved each on
its own; null headers are empty. Only the columns named here are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import stored

#: Headers of a 304 answer that replace the stored ones (RFC 9110 15.4.5, RFC 9111 3.2).
PERMITTED = (
    "age",
    "cache-control",
    "content-location",
    "date",
    "etag",
    "expires",
    "last-modified",
    "set-cookie",
    "vary",
    "warning",
)
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"
RECORD = "record_id bigint, url string, ts bigint, kind string, status int, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Without scheme, www/m label, user, default port, fragment, tracking arguments and last slash.

    Host in lower case, remaining arguments sorted.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(host, r"^.*@", "")), r":(?:80|443)$", "")
    host = F.regexp_replace(host, r"^(?:www[0-9]*|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)", 1), r"/+$", "")
    arguments = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.filter(arguments, lambda a: (a != "") & ~a.rlike(f"(?i)^{TRACKING}(?:=|$)"))
    query = F.array_join(F.sort_array(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of several spellings of a name the last counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    pairs = F.transform(
        entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_arrays(
        names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1)["value"])
    )


def _plain_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merged_headers(stored_headers: Column, update: Column) -> Column:
    """The stored headers, replaced or joined by the permitted ones of the update."""
    new = F.map_filter(update, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    old = F.map_filter(stored_headers, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, outcome, response_id, response_ts, digest, headers.

    Outcomes: ``resolved``; ``no_response`` (no full response before it);
    ``etag_differs``, ``date_differs`` and ``digest_differs`` (the latest response
    is not the one the server meant; entity tags decide before dates);
    ``unverified`` (no validator to compare; resolved all the same);
    ``no_key``.
    """
    rows = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("url_key"),
        F.col("ts").cast("bigint").alias("ts"),
        (F.lower("kind") == "revisit").alias("revisit"),
        ((F.lower("kind") == "response") & (F.col("status") == 200)).alias("full"),
        _lowered(F.col("headers")).alias("headers"),
        "digest",
    ).filter(F.coalesce(F.col("revisit"), F.lit(False)) | F.coalesce(F.col("full"), F.lit(False)))
    whole = F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    order = ["ts", "record_id"]
    dealt = stored(
        rows.filter(whole)
        .repartitionByRange("url_key", *order)
        .withColumn("part", F.spark_partition_id()),
        "revisits",
    )
    response = F.when(
        F.coalesce(F.col("full"), F.lit(False)),
        F.struct("ts", "record_id", "headers", "digest"),
    )
    inside = Window.partitionBy("url_key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("here", F.last(response, ignorenulls=True).over(inside)).filter("revisit")
    # One row per URL and range; a URL has at most as many as there are ranges.
    last = (
        dealt.filter("full")
        .groupBy("url_key", "part")
        .agg(F.max_by(F.struct("ts", "record_id", "headers", "digest"), F.struct(*order)).alias("at_end"))
    )
    seams = dealt.filter("revisit").select("url_key", "part").distinct()
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        last.join(seams, ["url_key", "part"], "full")
        .withColumn("carried", F.last("at_end", ignorenulls=True).over(before))
        .select("url_key", "part", "carried")
        .filter(F.col("carried").isNotNull())
    )
    found = near.join(carried, ["url_key", "part"], "left").withColumn(
        "hit", F.coalesce("here", "carried")
    )
    no_key = rows.filter(~whole & F.coalesce(F.col("revisit"), F.lit(False)))
    return _answers(found).unionByName(
        no_key.select(
            "record_id",
            "url_key",
            F.lit("no_key").alias("outcome"),
            F.lit(None).cast("bigint").alias("response_id"),
            F.lit(None).cast("bigint").alias("response_ts"),
            F.lit(None).cast("string").alias("digest"),
            F.col("headers"),
        )
    )


def _answers(found: DataFrame) -> DataFrame:
    hit = F.col("hit")
    tag, old_tag = F.col("headers")["etag"], hit["headers"]["etag"]
    date, old_date = F.col("headers")["last-modified"], hit["headers"]["last-modified"]
    tags, dates = tag.isNotNull() & old_tag.isNotNull(), date.isNotNull() & old_date.isNotNull()
    digests = F.col("digest").isNotNull() & hit["digest"].isNotNull()
    outcome = (
        F.when(hit.isNull(), "no_response")
        .when(digests & (F.col("digest") != hit["digest"]), "digest_differs")
        .when(tags & (_plain_tag(tag) != _plain_tag(old_tag)), "etag_differs")
        .when(~tags & dates & (date != old_date), "date_differs")
        .when(tags | dates | digests, "resolved")
        .otherwise("unverified")
    )
    done = F.col("outcome").isin("resolved", "unverified")
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "outcome",
        F.when(done, hit["record_id"]).alias("response_id"),
        F.when(done, hit["ts"]).alias("response_ts"),
        F.when(done, hit["digest"]).alias("digest"),
        F.when(done, merged_headers(hit["headers"], F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def attach_bodies(resolved: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """Add the body of the response that each resolved revisit refers to."""
    bodies = records.select(F.col("record_id").alias("response_id"), F.col(body).alias("body"))
    return resolved.join(bodies, "response_id", "left")
