"""URL filters from dated lists, as a temporal join; DataFrame functions only.

List entries are dated additions and removals of patterns: a host, any parent domain, or a
host with leading path segments. Per list and pattern they become validity intervals.
Every capture is then evaluated against the entries active at its fetch time: an as-of
join on pattern and month, within a month on the interval. Captures of one URL on one date
are evaluated once, so a page fetched often costs one row, and months keep the intervals
of a much-listed pattern apart.

The most specific active pattern decides; between lists on one pattern ``block`` goes
before ``allow``, then the list's name. Nothing active: ``unlisted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = 2  # leading path segments of the entries derived from pages


def host(url: Column | str) -> Column:
    """Lower-case host of a URL without user and port; empty if it has none."""
    url = F.col(url) if isinstance(url, str) else url
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", "")


def patterns(url: Column | str, most: int | None = None) -> Column:
    """All patterns a URL falls under, or those of at most ``most`` path segments:
    (pattern, rank), a larger rank is more specific."""
    url = F.col(url) if isinstance(url, str) else url
    h = host(url)
    labels = F.split(h, r"\.")
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (F.size(labels) - i + 1).alias("rank")),
    )
    depth = F.size(segments) if most is None else F.least(F.size(segments), F.lit(most))
    paths = F.transform(
        F.sequence(F.lit(0), depth),
        lambda n: F.struct(F.concat_ws("/", h, F.slice(segments, F.lit(1), n)).alias("pattern"), (F.lit(1000) + n).alias("rank")),
    )
    both = F.concat(domains, F.filter(paths, lambda p: p["rank"] > 1000))
    return F.when(h != "", both).otherwise(F.array().cast("array<struct<pattern:string,rank:int>>"))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) in which a pattern is on a list.

    ``entries`` has list, effect (block or allow), pattern, action (add or remove) and at
    (date). Repeated additions go on, removals of what is not listed do nothing, and on
    one date a removal comes after an addition. Rows with a null in these columns are left
    out. The case of a host does not count, that of a path does. An open interval has
    valid_to null. What is sorted is one row for each date on
    which a pattern changed, so no pattern can have more than the calendar has days.
    """
    named = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(named), F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)"))
    day = (
        entries.dropna(subset=["list", "effect", "pattern", "action", "at"])
        .where(F.col("action").isin("add", "remove"))
        .groupBy("list", "effect", pattern.alias("pattern"), F.col("at").cast("date").alias("at"))
        .agg(F.max(F.col("action") == "remove").alias("removed"))
    )
    by = Window.partitionBy("list", "effect", "pattern").orderBy("at")
    turns = day.withColumn("before", F.lag("removed").over(by)).where("NOT (removed <=> before) AND NOT (removed AND before IS NULL)")
    return (
        turns.withColumn("valid_to", F.lead("at").over(by))
        .where("NOT removed")
        .select("list", "effect", "pattern", F.col("at").alias("valid_from"), "valid_to")
    )


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with verdict, list, pattern and valid_from of the entry that decides.

    Captures without a URL, a host or a fetch date are ``unlisted``. All rows are kept,
    repeated ones too, and all columns but those named like the new ones. An empty list
    leaves everything unlisted, an empty table of captures gives no rows.
    """
    new = ["verdict", "list", "pattern", "valid_from"]
    captures = captures.drop(*new)
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched).cast("date").alias("_day")).dropna().distinct()
    month = lambda c: F.trunc(c, "month")
    # No URL has to be asked for more path segments than the longest entry has.
    longest = entries.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    probes = asked.select("_url", "_day", month("_day").alias("month"), F.explode(patterns("_url", longest)).alias("p")).select("_url", "_day", "month", "p.pattern", "p.rank")

    # Open intervals reach to the last fetch.
    last = F.lit(asked.agg(F.max("_day")).first()[0]).cast("date")
    spans = validity(entries).where(F.col("valid_from") <= last)
    upto = F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)
    months = F.sequence(month("valid_from"), month(upto), F.expr("interval 1 month"))
    spans = spans.where(upto >= F.col("valid_from")).select("list", "effect", "pattern", "valid_from", "valid_to", F.explode(months).alias("month"))

    active = probes.join(spans, ["pattern", "month"]).where("valid_from <= _day AND (valid_to IS NULL OR _day < valid_to)")
    order = F.struct((-F.col("rank")).alias("r"), (F.col("effect") != "block").alias("e"), "list", "pattern", "valid_from", "effect")
    best = active.groupBy("_url", "_day").agg(F.min(order).alias("b"))
    best = best.select("_url", "_day", F.col("b.effect").alias("verdict"), "b.list", "b.pattern", "b.valid_from")
    joined = captures.join(best, (captures[url] == best["_url"]) & (captures[fetched].cast("date") == best["_day"]), "left")
    kept = [captures[c] for c in captures.columns]
    return joined.select(*kept, F.coalesce("verdict", F.lit("unlisted")).alias("verdict"), best["list"], best["pattern"], best["valid_from"])


# --- the query's data, derived from pages ---------------------------------------------------


def _hex(text: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, length), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date that follows from their URL and number."""
    day = (_hex(F.coalesce("url", F.lit("")), 1, 4) + F.coalesce("page_id", F.lit(0)) % 31) % 800
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), day.cast("int")).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a part of the hosts, domains and leading paths of the pages."""
    every = pages.select(F.explode(patterns("url", SEGMENTS)).alias("p")).select("p.pattern").distinct()
    p = F.col("pattern")
    first = _hex(p, 3, 3) % 400
    start = F.lit("2023-01-01").cast("date")
    listed = every.where(_hex(p, 1, 1) < 6).select(
        F.when(_hex(p, 2, 1) < 8, "spam").when(_hex(p, 2, 1) < 13, "adult").otherwise("trusted").alias("list"),
        F.when(_hex(p, 2, 1) < 13, "block").otherwise("allow").alias("effect"),
        "pattern",
        F.array(
            F.struct(F.lit("add").alias("action"), F.date_add(start, first).alias("at")),
            F.struct(F.lit("remove").alias("action"), F.date_add(start, first + 30 + _hex(p, 6, 2)).alias("at")),
            F.struct(F.when(_hex(p, 8, 1) % 2 == 0, "add").alias("action"), F.date_add(start, first + 350).alias("at")),
        ).alias("e"),
    )
    return listed.select("list", "effect", "pattern", F.inline("e")).where("action IS NOT NULL")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '') AS h,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages),
c AS (
  SELECT page_id, url, h, seg,
         (DATE '2023-01-01' + CAST((CAST('0x' || substr(md5(coalesce(url, '')), 1, 4) AS INT) + coalesce(page_id, 0) % 31) % 800 AS INT)) AS fetched
  FROM u),
x AS (
  SELECT DISTINCT url, h, seg FROM u WHERE h <> ''),
pat AS (
  SELECT url, array_to_string(l[i:], '.') AS pattern, len(l) - i + 1 AS rank
  FROM (SELECT url, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT url, string_split(h, '.') AS l FROM x))
  UNION ALL
  SELECT url, h || '/' || array_to_string(seg[1:n], '/'), 1000 + n
  FROM (SELECT url, h, seg, unnest(range(1, least(len(seg), 2) + 1)) AS n FROM x)),
m AS (SELECT pattern, md5(pattern) AS k FROM (SELECT DISTINCT pattern FROM pat)),
hx AS (
  SELECT pattern, CAST('0x' || k[1:1] AS INT) AS a, CAST('0x' || k[2:2] AS INT) AS b, CAST('0x' || k[3:5] AS INT) % 400 AS f,
         CAST('0x' || k[6:7] AS INT) AS r, CAST('0x' || k[8:8] AS INT) % 2 AS again FROM m),
v AS (
  SELECT CASE WHEN b < 8 THEN 'spam' WHEN b < 13 THEN 'adult' ELSE 'trusted' END AS list,
         CASE WHEN b < 13 THEN 'block' ELSE 'allow' END AS effect, pattern,
         DATE '2023-01-01' + CAST(f + d.s AS INT) AS valid_from,
         CASE WHEN d.s = 0 THEN DATE '2023-01-01' + CAST(f + 30 + r AS INT) END AS valid_to
  FROM hx, (VALUES (0), (350)) d(s) WHERE a < 6 AND (d.s = 0 OR again = 0)),
best AS (
  SELECT c.url, c.fetched, min({'r': -pat.rank, 'e': v.effect <> 'block', 'list': v.list, 'pattern': v.pattern, 'valid_from': v.valid_from, 'effect': v.effect}) AS b
  FROM (SELECT DISTINCT url, fetched FROM c) c JOIN pat USING (url) JOIN v USING (pattern)
  WHERE v.valid_from <= c.fetched AND (v.valid_to IS NULL OR c.fetched < v.valid_to)
  GROUP BY ALL)
SELECT page_id, c.url AS url, c.fetched AS fetched, coalesce(b.effect, 'unlisted') AS verdict, b.list AS list, b.pattern AS pattern, b.valid_from AS valid_from
FROM c LEFT JOIN best ON c.url = best.url AND c.fetched = best.fetched
"""
