"""Resolution of not-modified revisits in a crawl's records.

A revisit of status 304 says that its URL's content is as before. It is resolved to the latest earlier full response (status 200)
of its canonical URL. Its validators are checked: the entity tag (weak comparison) if both have one, otherwise the modification
date if both have one. A resolved revisit gets the response's headers, replaced by those of its own that a 304 may update.

The as-of join is a running last value. So that a URL with a third of all records is no hot spot, time is cut into ranges between
quantiles, the value runs within a range of a URL, and each range of a URL takes over the last response of the ranges before.

Verdicts: ``resolved``; ``changed`` if a validator contradicts; ``unchecked`` if there is none to compare (target and headers are
given); ``missing`` without an earlier response. Nulls: a null URL, time or status leaves a record out; null headers are none.
Ties in time: a response counts as earlier than a revisit of its time; of equal responses the one with the greatest record id is the
latest. Repeated rows: each is a record. Empty table: empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a 304 may update.
UPDATES = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that do not change a page.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid"
#: Ranges of time: a URL is split into so many parts at most, each of which is sorted on disk if need be.
RANGES = 64


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., m. or default port, path without fragment or trailing slash, query without tracking."""
    u = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), ":(80|443)$", ""), r"^(www|m)\.", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(rest, "^[^?]*", ""), f"(^[?]|&)({TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, "^[?&]+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _tag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, url_key, ts, target_id, verdict, headers of each revisit.

    ``records``: record_id, url, ts (long), status (int), headers (map of lower-case names).
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), F.col("status").cast("int").alias("status"), F.coalesce("headers", F.expr("cast(map() as map<string,string>)")).alias("headers"))
    r = r.filter("url_key is not null and ts is not null and status in (200, 304)")
    cuts = r.agg(F.percentile_approx("ts", [k / RANGES for k in range(1, RANGES)], 4096).alias("q")).first()["q"]
    limits = sorted(set(cuts or []))
    r = r.withColumn("range", F.size(F.filter(F.array(*map(F.lit, limits)) if limits else F.array().cast("array<bigint>"), lambda b: b < F.col("ts"))))
    full = F.when(F.col("status") == 200, F.struct("record_id", "headers"))
    order = Window.partitionBy("url_key", "range").orderBy("ts", "status", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = r.withColumn("own", F.last(full, ignorenulls=True).over(order)).filter("status = 304")
    # the last response of each range of a URL, where a later range has revisits to take it over
    ends = r.filter("status = 200").groupBy("url_key", "range").agg(F.max(F.struct("ts", "record_id")).alias("end"), F.max_by(F.struct("record_id", "headers"), F.struct("ts", "record_id")).alias("last"))
    marks = ends.select("url_key", "range", "last").unionByName(run.select("url_key", "range").distinct().withColumn("last", F.lit(None).cast(ends.schema["last"].dataType)))
    marks = marks.groupBy("url_key", "range").agg(F.first("last", ignorenulls=True).alias("last"))
    line = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.withColumn("earlier", F.last("last", ignorenulls=True).over(line)).filter("earlier is not null").select("url_key", "range", "earlier")
    both = run.join(before, ["url_key", "range"], "left").withColumn("target", F.coalesce("own", "earlier"))
    old, new = F.col("target.headers"), F.col("headers")
    tags = F.when(old["etag"].isNotNull() & new["etag"].isNotNull(), _tag(old["etag"]) == _tag(new["etag"]))
    dates = F.when(old["last-modified"].isNotNull() & new["last-modified"].isNotNull(), old["last-modified"] == new["last-modified"])
    same = F.coalesce(tags, dates)
    verdict = F.when(F.col("target").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    updates = F.map_filter(new, lambda k, _: k.isin(UPDATES))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(updates, k)), updates)
    return both.select("record_id", "url_key", "ts", F.col("target.record_id").alias("target_id"), verdict.alias("verdict"), F.when(verdict.isin("resolved", "unchecked"), merged).alias("headers"))
