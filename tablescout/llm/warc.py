"""Not-modified revisits of web archives: an as-of join by canonical URL to the latest earlier
full response, with a check of validators and a merge of the permitted headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.llm.frames import keep

# Header fields that a 304 response does not update in the stored response.
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization",
    "set-cookie", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """The URL without scheme, user, ``www.``, the scheme's default port, fragment, tracking
    parameters and trailing slash, with a lower-case host; null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    for scheme, port in (("[Hh][Tt][Tt][Pp]", "80"), ("[Hh][Tt][Tt][Pp][Ss]", "443")):
        bare = F.regexp_replace(bare, f"^({scheme}://[^/?]*):{port}([/?]|$)", "$1$2")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/+$", ""))


def _weak(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, folder: str) -> DataFrame:
    """One row per not-modified revisit, with the full response it stands for.

    ``records`` has record_id, url, ts (any ordered type), status (int), etag, last_modified and
    headers (map of strings, names in lower case). Status 200 is a full response, 304 a revisit;
    other rows, and revisits without a time or URL, have no partner: revisits are then returned
    as ``no_original``. Result: record_id, url_key, refers_to, outcome, headers.

    outcome: ``no_original`` where no full response of the URL is strictly earlier; else by the
    latest (of equal times the largest record_id): ``resolved`` where the entity tags agree, or,
    where either lacks one, the dates of change; ``mismatch`` where they differ;
    ``unverified`` where there is nothing to compare. Only a resolved revisit gets the
    original's headers, updated by its own permitted ones; the others keep their own.

    Records are dealt by ranges of (URL, time), so that a URL with very many records spans many
    tasks; what is the latest response at the end of a range is carried to the later ranges.
    Repeated records give repeated rows; other columns are ignored.
    """
    full = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    rows = records.where(F.col("status").isin(200, 304)).select(
        "record_id",
        canonical_url(F.col("url")).alias("key"),
        "ts",
        (F.col("status") == 200).alias("is_full"),
        "etag",
        "last_modified",
        "headers",
    )
    known = F.col("key").isNotNull() & F.col("ts").isNotNull()
    ranged = (
        rows.where(known)
        .repartitionByRange("key", "ts", "is_full", "record_id")
        .withColumn("range", F.spark_partition_id())
    )
    ranged = keep(ranged, folder, "ranged")
    # A revisit sorts before the responses of its own time: these are not earlier.
    before = (
        Window.partitionBy("range", "key")
        .orderBy("ts", "is_full", "record_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = ranged.withColumn("held", F.last(F.when(F.col("is_full"), full), True).over(before))
    ends = (
        ranged.where("is_full")
        .groupBy("key", "range")
        .agg(F.max_by(full, F.struct("ts", "record_id")).alias("end"))
    )
    # A row per range that a URL reaches: at most as many as there are tasks.
    reached = ranged.select("key", "range").distinct().join(ends.hint("merge"), ["key", "range"], "left")
    earlier = (
        Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = reached.select("key", "range", F.last("end", True).over(earlier).alias("carried"))
    joined = (
        inside.where(~F.col("is_full"))
        # The planner takes the size from compressed files, far below what it would broadcast.
        .join(carried.where("carried is not null").hint("merge"), ["key", "range"], "left")
        .withColumn("original", F.coalesce("held", "carried"))
    )
    lost = rows.where(~known & ~F.col("is_full")).select(
        "record_id", "key", "etag", "last_modified", "headers"
    )
    both = joined.select(
        "record_id", "key", "etag", "last_modified", "headers", "original"
    ).unionByName(lost, allowMissingColumns=True)
    tags = F.col("etag").isNotNull() & F.col("original.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("original.last_modified").isNotNull()
    agree = F.when(tags, _weak(F.col("etag")) == _weak(F.col("original.etag"))).when(
        dates, F.col("last_modified") == F.col("original.last_modified")
    )
    outcome = (
        F.when(F.col("original").isNull(), "no_original")
        .when(agree.isNull(), "unverified")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    nothing = F.create_map().cast("map<string,string>")
    own = F.coalesce("headers", nothing)
    stored = F.coalesce("original.headers", nothing)
    permitted = F.map_filter(own, lambda k, v: ~k.isin(NOT_MERGED))
    merged = F.map_concat(
        F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted
    )
    return both.withColumn("outcome", outcome).select(
        "record_id",
        F.col("key").alias("url_key"),
        F.col("original.record_id").alias("refers_to"),
        "outcome",
        F.when(F.col("outcome") == "resolved", merged).otherwise(own).alias("headers"),
    )
