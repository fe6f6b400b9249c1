"""Not-modified revisits of WARC records: each is resolved by an as-of join to the latest earlier full response of its canonical URL.

The revisit's validators must fit that response: where both have an entity tag, the tags are compared weakly (a leading `W/` doesn't
count); where either has none, the modification dates must be equal. A resolved record takes the response's payload (by digest) and
its headers, over which the revisit's permitted headers are laid; names are compared without regard to letter case, and a laid header
keeps the revisit's spelling.

A URL may hold much of the log, also at one time, so records are dealt by ranges of (URL, time, record): a window runs over the part of
a URL that lies in a range, and what a part has inherited is the last response of the URL's parts before it, from a table of one row
for each URL and range.

Defined results: revisits of a null URL, without an earlier response, without validators or with others than the response's stay
unresolved (null response, `resolved` false); records of equal time are ordered by record_id; a response of the same time as a
revisit counts as earlier if its record_id is smaller; repeated rows give repeated results; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.llm.common import materialize

#: Headers of a 304 response that update the stored ones, in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "warning")
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"
RECORD = ("record_id", "url", "fetched", "kind", "etag", "modified", "headers", "payload_sha256")


def canonical(url: Column) -> Column:
    """Without scheme, user, `www.` or `m.`, default port, fragment, tracking parameters and last slashes; host in lower case, parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~F.regexp_like(q, F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def merged(stored: Column, fresh: Column) -> Column:
    """The stored headers, with the permitted ones of the revisit in their place."""
    none = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce(fresh, none), lambda k, _: F.lower(k).isin(*PERMITTED))
    names = F.transform(F.map_keys(new), lambda k: F.lower(k))
    return F.map_concat(F.map_filter(F.coalesce(stored, none), lambda k, _: ~F.array_contains(names, F.lower(k))), new)


def fitting(etag: Column, modified: Column, stored: Column) -> Column:
    """Whether validators fit those of a stored response."""
    bare = lambda tag: F.regexp_replace(tag, "^W/", "")
    tags = etag.isNotNull() & stored["etag"].isNotNull()
    return F.coalesce(F.when(tags, bare(etag) == bare(stored["etag"])).otherwise(modified == stored["modified"]), F.lit(False))


def resolve(records: DataFrame) -> DataFrame:
    """All revisits of the records, with the response they stand for, whether its validators fit, and the merged headers."""
    answer = F.struct("record_id", "etag", "modified", "headers", "payload_sha256")
    rows = records.select(*RECORD).withColumn("canonical_url", canonical(F.col("url"))).drop("url")
    dealt = rows.where("canonical_url IS NOT NULL").repartitionByRange("canonical_url", "fetched", "record_id")
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "revisit-parts")
    full = F.when(F.col("kind") == "response", answer)
    key = ["canonical_url", "part"]
    before = Window.partitionBy(*key).orderBy("fetched", "record_id", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(full, ignorenulls=True).over(before)).where("kind = 'revisit'")
    parts = dealt.groupBy(*key).agg(F.max_by(full, F.when(F.col("kind") == "response", F.struct("fetched", "record_id"))).alias("last"))
    inherited = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    far = parts.withColumn("far", F.last("last", ignorenulls=True).over(inherited)).where("far IS NOT NULL").drop("last")
    # Both sides are partitioned by the key already; one row for each URL and part is never broadcast.
    found = near.join(far.hint("merge"), key, "left").withColumn("r", F.coalesce("near", "far")).drop("part", "near", "far")
    nowhere = rows.where("canonical_url IS NULL AND kind = 'revisit'").withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    found = found.unionByName(nowhere).withColumn("resolved", fitting(F.col("etag"), F.col("modified"), F.col("r")))
    return found.select(
        "record_id", "canonical_url", "fetched", "resolved", F.col("r.record_id").alias("candidate_id"), F.when(F.col("resolved"), F.col("r.record_id")).alias("response_id"),
        F.when(F.col("resolved"), F.col("r.payload_sha256")).alias("payload_sha256"), F.when(F.col("resolved"), merged(F.col("r.headers"), F.col("headers"))).alias("headers"),
    )


#: In the query's log every page is fetched at its page_id and asked for again so many fetches later.
ASK_AGAIN = 1000


def log_of(pages: DataFrame) -> DataFrame:
    """Two records for each page: its full response, and the later revisit that says it hasn't changed since.

    Every fifth response has no entity tag, every third revisit a weak one, and every second revisit writes its headers' names large."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", tag.alias("tag"), F.sha2(F.col("html").cast("binary"), 256).alias("payload_sha256"))
    page, later = F.col("page_id"), F.col("page_id") + ASK_AGAIN
    day = lambda t: F.concat(F.lit("t"), t.cast("string"))
    response = F.struct(
        (page * 2).alias("record_id"), "url", page.alias("fetched"), F.lit("response").alias("kind"), F.when(F.pmod(page, F.lit(5)) != 4, F.col("tag")).alias("etag"), page.alias("modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), day(page), F.lit("server"), F.lit("a")).alias("headers"), "payload_sha256")
    name = lambda small, large: F.when(F.pmod(page, F.lit(2)) == 1, large).otherwise(small)
    revisit = F.struct(
        (page * 2 + 1).alias("record_id"), "url", later.alias("fetched"), F.lit("revisit").alias("kind"),
        F.when(F.pmod(page, F.lit(3)) == 1, F.concat(F.lit("W/"), "tag")).otherwise(F.col("tag")).alias("etag"), page.alias("modified"),
        F.create_map(name("content-type", "Content-Type"), F.lit("none"), name("date", "Date"), day(later), name("server", "Server"), F.lit("b"),
            name("content-location", "Content-Location"), F.concat(F.lit("l"), page.cast("string"))).alias("headers"), F.lit(None).cast("string").alias("payload_sha256"))
    return base.select(F.inline(F.array(response, revisit)))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(log_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    heads = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(F.floor(F.col("record_id") / 2).alias("page_id"), "canonical_url", "resolved", F.floor(F.col("candidate_id") / 2).alias("candidate_page"), F.floor(F.col("response_id") / 2).alias("response_page"), "payload_sha256", heads.alias("merged_headers"))


SQL = r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare, md5(html) AS tag, sha256(html) AS sha FROM pages),
p AS (SELECT *, lower(regexp_extract(bare, '^[^/?]*')) AS host, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path, regexp_extract(bare, '[?](.*)$', 1) AS query FROM b),
q AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))) AS kept FROM p),
u AS (SELECT page_id, tag, sha, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)$', ''), '^(www|m)[.]', '') || path
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM q),
j AS (SELECT v.page_id, v.canonical_url, r.page_id AS cand, r.sha, coalesce(CASE WHEN r.page_id % 5 <> 4 THEN v.tag = r.tag ELSE v.page_id = r.page_id END, false) AS ok FROM u v LEFT JOIN u r
  ON r.canonical_url = v.canonical_url AND (r.page_id < v.page_id + 1000 OR (r.page_id = v.page_id + 1000 AND r.page_id * 2 < v.page_id * 2 + 1))
  QUALIFY row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) = 1)
SELECT page_id, canonical_url, ok AS resolved, cand AS candidate_page, CASE WHEN ok THEN cand END AS response_page, CASE WHEN ok THEN sha END AS payload_sha256,
  CASE WHEN ok AND page_id % 2 = 1 THEN 'Content-Location=l' || page_id || ';Date=t' || (page_id + 1000) || ';content-type=text/html;server=a'
  WHEN ok THEN 'content-location=l' || page_id || ';content-type=text/html;date=t' || (page_id + 1000) || ';server=a' END AS merged_headers FROM j
"""
