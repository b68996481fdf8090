"""URL filters whose lists change over time.

List entries are dated: a pattern is added to a list on a day and perhaps taken off on
another. They become validity intervals, and each capture is judged by the entries that
were active when it was fetched.

A pattern is a host (``example.com``, which holds for hosts under it as well) or a host and a
path (``example.com/news``, which holds for paths under it). What can match a capture is a
closed set of keys: the ends of its host, each with the beginnings of its path, as deep as
the lists go; a host that is an address has no ends but itself. Captures are first gathered to distinct sites
(host and path to that depth); only sites are blown up to keys and joined with the lists. What
holds for a site changes at few dates: its intervals become steps that do not overlap, each with the
rule that decides, and a capture is joined with the one step that its fetch falls into. A popular site is one row in the
first join, and in the second Spark can split it, since each of its captures stands for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.scratch import written

_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-z:.%]+\]|[^/?#:@\[\]]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"


def host(url: Column) -> Column:
    """Lower-cased host without user, port and final dot, an IPv6 address in its brackets; empty where the text is no URL,
    null for null."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), _HOST, 1), r"\.$", "")


def path(url: Column) -> Column:
    """Segments of the path; empty ones and single dots don't count, two dots take the one before away (RFC 3986)."""
    given = F.filter(F.split(F.regexp_extract(F.trim(url), _PATH, 1), "/"), lambda s: s != "")
    dots = lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit("."))
    back = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    resolved = F.aggregate(
        given,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(dots(s) == ".", kept).when(dots(s) == "..", back(kept)).otherwise(F.concat(kept, F.array(s))),
    )
    # Few URLs hold such segments; the others needn't be put together anew.
    return F.when(F.exists(given, lambda s: dots(s).isin(".", "..")), resolved).otherwise(given)


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list, pattern, since, action (add or remove), verdict (block or allow), in any order.

    Returns (list, pattern, verdict, valid_from, valid_to): an ``add`` holds from its date until the pattern's next
    entry on the list, valid_to excluded, null for open. Of entries of one date an ``add`` counts last. Rows
    without list, pattern, date or a known action are void; repeated rows do no harm. Patterns lose a scheme and
    slashes at either end, and their host is taken as that of a capture: lower-cased, without user, port and final dot. Names are compared as they are
    written, so one with letters beyond ASCII and its ``xn--`` form are two.
    """
    clean = F.trim(F.regexp_replace(F.trim("pattern"), "^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    clean = F.regexp_replace(clean, "/+$", "")
    named = F.regexp_extract(F.substring_index(clean, "/", 1), r"^(?:[^@]*@)?(\[[0-9A-Za-z:.%]+\]|[^:]*)(?::[0-9]*)?$", 1)
    first = F.regexp_replace(named, r"\.$", "")
    rest = F.array_join(F.filter(F.slice(F.split(clean, "/"), 2, 100_000), lambda s: s != ""), "/")
    whole = F.concat(F.lower(first), F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise(""))
    known = entries.select("list", whole.alias("pattern"), "since", "action", F.coalesce("verdict", F.lit("block")).alias("verdict"))
    known = known.where("list is not null and pattern <> '' and pattern not like '/%' and since is not null and action in ('add', 'remove')").distinct()
    order = Window.partitionBy("list", "pattern").orderBy("since", F.col("action").desc(), "verdict")
    return (
        known.withColumn("valid_to", F.lead("since").over(order))
        .where("action = 'add' and (valid_to is null or valid_to > since)")
        .select("list", "pattern", "verdict", F.col("since").alias("valid_from"), "valid_to")
    )


def keys(host_: Column, segments: Column) -> Column:
    """All patterns that could match a host and path segments, hosts first."""
    labels = F.split(host_, r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    ends = F.when(host_.rlike(_ADDRESS), F.array(host_)).otherwise(ends)
    deep = F.transform(
        F.sequence(F.lit(0), F.size(segments)),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/"))),
    )
    return F.flatten(F.transform(ends, lambda e: F.transform(deep, lambda d: F.concat(e, d))))


def steps(matched: DataFrame) -> DataFrame:
    """matched: site, verdict, list, pattern, valid_from, valid_to. (site, since, until, n_active, best) for each span of
    time in which the same entries hold for a site; spans of a site do not overlap, ``until`` is excluded and null for open.

    best: the longest pattern decides, "allow" before "block" of one length, then by pattern and list.
    """
    ends = matched.select("site", F.col("valid_from").alias("since")).unionByName(matched.where("valid_to is not null").select("site", F.col("valid_to").alias("since")))
    spans = ends.distinct().withColumn("until", F.lead("since").over(Window.partitionBy("site").orderBy("since")))
    holds = (F.col("valid_from") <= F.col("since")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("since")))
    best = F.min(F.struct((-F.length("pattern")).alias("size"), "verdict", "pattern", "list")).alias("best")
    return spans.join(matched, "site").where(holds).groupBy("site", "since", "until").agg(F.count("*").alias("n_active"), best)


def judge(captures: DataFrame, entries: DataFrame, id_column: str = "page_id") -> DataFrame:
    """captures: id, url, fetched_at. A row for each: id, fetched_at, n_active, blocked, rule, list.

    n_active counts entries active at the fetch that match. The longest pattern among them decides, an allowing
    one before a blocking one of the same length, then by pattern and list; without any the capture passes. Null and
    malformed URLs and unknown fetch times match nothing. Rows that repeat an id are judged each. Columns of
    other names are ignored. Dates of entries and fetches must be of comparable types.
    """
    valid = written(intervals(entries))
    depth = valid.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    named = captures.select(
        F.col(id_column).alias("id"), "fetched_at", host(F.col("url")).alias("host"), F.slice(path(F.col("url")), 1, max(depth, 1)).alias("path")
    )
    if depth == 0:
        named = named.withColumn("path", F.array().cast("array<string>"))
    named = named.withColumn("site", F.when(F.col("host") != "", F.concat_ws("/", F.array("host"), "path")))
    sites = named.where("site is not null").groupBy("site").agg(F.first("host").alias("host"), F.first("path").alias("path"))
    matched = sites.select("site", F.explode(keys(F.col("host"), F.col("path"))).alias("pattern")).join(valid, "pattern")
    known = steps(written(matched))
    during = (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    asked = named.where("site is not null").alias("asked")
    found = asked.join(known, (F.col("asked.site") == known["site"]) & during, "left").select("id", "fetched_at", "n_active", "best")
    # What has no site needs no join, in which all such rows would have one key.
    lost = named.where("site is null").select("id", "fetched_at", *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("n_active", "best")))
    best = F.col("best")
    return found.unionByName(lost).select(
        F.col("id").alias(id_column),
        "fetched_at",
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.coalesce(best.verdict == "block", F.lit(False)).alias("blocked"),
        best.pattern.alias("rule"),
        best["list"].alias("list"),
    )
