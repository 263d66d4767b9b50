"""URL filtering against dated lists: every capture is judged by the entries that were active when it was fetched.

List events (pattern, action, at) become validity intervals: an ``add`` holds until the pattern's next event. A pattern is a
domain of one label or more, which covers its subdomains, or a host and a path of any depth, which covers that path and all
below it. Captures are reduced to distinct (host, day) keys for domains and (host, path, day) keys for paths, cut to the depth
of the deepest listed path, before they meet the list; so a host with a third of all captures asks for its domains once a day.
Verdicts are joined back. All are equi-joins, with a range condition on the day, that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postern.llm.common import unwrap, wrap
from postern.shared import cut, scratch

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host, null where the text is no absolute URL."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def segments_of(path: Column) -> Column:
    """The parts of a path between slashes, but for empty ones."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def join_path(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def validity(events: DataFrame) -> DataFrame:
    """Intervals [since, until) in which a pattern is listed; until is null while it still is. depth is that of its path, null for a domain.

    ``events``: pattern, action (``add`` or ``remove``), at (date). Repeated events count once, rows with a null take no
    part; on one day a removal comes after an addition. Hosts are compared without case, paths with it; empty parts of a
    path do not count, so ``host/`` is all of that host, but not its subdomains. A repeated ``add`` only continues the interval.
    """
    host, path = F.lower(F.substring_index("pattern", "/", 1)), F.regexp_extract("pattern", "(?s)/.*", 0)
    rows = events.where("pattern is not null and at is not null and action in ('add', 'remove')").select(host.alias("host"), segments_of(path).alias("segs"), F.contains("pattern", F.lit("/")).alias("deep"), "action", "at").where("host <> ''")
    rows = rows.select(F.concat("host", F.when(F.col("deep"), join_path(F.col("segs"))).otherwise("")).alias("pattern"), F.when(F.col("deep"), F.size("segs")).alias("depth"), "action", "at").distinct()
    order = W.partitionBy("pattern").orderBy("at", "action")
    spans = rows.withColumn("until", F.lead("at").over(order)).where("action = 'add' and (until is null or until > at)")
    return spans.select("pattern", "depth", F.col("at").alias("since"), "until")


def _covered(asked: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Active entries that cover each key, counted, and the least of their patterns."""
    day = F.col("d")
    active = asked.join(spans, (F.col("asked") == F.col("pattern")) & (F.col("since") <= day) & (F.col("until").isNull() | (F.col("until") > day)))
    return active.groupBy(*keys).agg(F.count("*").alias("n"), F.min("pattern").alias("first"))


def judge(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with host, blocked, n_entries (active entries that cover it) and entry (the first of their patterns).

    A null or malformed URL, or a capture without a date, is covered by nothing. Repeated captures get equal verdicts.
    """
    new = ("host", "blocked", "n_entries", "entry")
    names = [c for c in captures.columns if c.lower() not in new]
    with scratch(captures.sparkSession) as stays:
        spans = cut(validity(events))
        deepest = spans.agg(F.max("depth")).first()[0] or 0
        segments = F.slice(segments_of(F.regexp_extract("url", PATH, 1)), 1, deepest) if deepest else F.array().cast("array<string>")
        rows = wrap(captures, names, url=url, day_=fetched).select("row_", host_of(F.col("url")).alias("host"), F.array_join(segments, "/").alias("path_"), "day_")
        keys = cut(rows.where("host is not null and day_ is not null").select(F.col("host").alias("h"), F.col("path_").alias("p"), F.col("day_").alias("d")).distinct())
        labels = F.split("h", r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        by_domain = _covered(keys.select("h", "d").distinct().select("h", "d", F.explode(F.array_distinct(suffixes)).alias("asked")).where("asked <> ''"), spans.where("depth is null"), "h", "d")
        parts = F.filter(F.split("p", "/"), lambda x: x != "")
        prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat("h", join_path(F.slice(parts, 1, i))))
        by_path = _covered(keys.select("h", "p", "d", F.explode(prefixes).alias("asked")), spans.where("depth is not null"), "h", "p", "d").withColumnsRenamed({"n": "m", "first": "other"})
        verdicts = keys.join(by_domain, ["h", "d"], "left").join(by_path, ["h", "p", "d"], "left").where("n is not null or m is not null")
        # written, as are the list and the keys: plans stay small, and each is made once
        verdicts = cut(verdicts.select("h", "p", "d", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n_entries"), F.least("first", "other").alias("entry")))
        stays.append(verdicts)
    joined = rows.join(verdicts, (F.col("host") == F.col("h")) & (F.col("path_") == F.col("p")) & (F.col("day_") == F.col("d")), "left")
    return joined.select(*unwrap(names), "host", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "entry")


#: Entries of the example list that no page has a say in.
FIXED = (("example.org", "add", "2024-11-20"), ("spam-farm.example.org", "add", "2024-02-01"), ("spam-farm.example.org", "remove", "2024-06-01"), ("Spam-Farm.example.org/en/", "add", "2024-05-01"), ("net", "add", "2024-12-01"), ("net", "remove", "2024-12-11"), ("never-seen.example", "add", "2024-01-01"), ("www.cheap-pills.example.com/", "add", "2024-03-01"))


def _number(text: Column, salt: str, modulus: int) -> Column:
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, 6), 16, 10).cast("long") % modulus).cast("int")


def example_events(pages: DataFrame) -> DataFrame:
    """A dated list: ``FIXED``, and a third of the hosts of ``pages``, some parent domains and some paths of one to three parts, which come and go."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.slice(segments_of(F.regexp_extract("url", PATH, 1)), 1, 3).alias("segs")).where("host is not null").distinct()
    alone = hosts.select("host").distinct()
    paths = hosts.where("size(segs) > 0").select(F.concat("host", join_path(F.col("segs"))).alias("path")).distinct()
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    picked = alone.where(_number(F.col("host"), "pick", 3) == 0).union(alone.select(parent).where(_number(F.col("host"), "parent", 40) == 0)).union(paths.where(_number(F.col("path"), "deep", 11) == 0)).union(paths.where(_number(F.col("path"), "wide", 7) == 0).select(F.regexp_extract("path", "^[^/]*/[^/]*", 0)))
    names = picked.select(F.col("host").alias("pattern")).distinct()
    start = F.to_date(F.lit("2024-01-01"))
    added = F.date_add(start, _number(F.col("pattern"), "add", 300))
    gone = F.date_add(added, _number(F.col("pattern"), "stay", 90))
    back = F.date_add(gone, _number(F.col("pattern"), "back", 60))
    made = names.select("pattern", F.lit("add").alias("action"), added.alias("at")).union(names.select("pattern", F.lit("remove"), gone)).union(names.where(_number(F.col("pattern"), "again", 2) == 0).select("pattern", F.lit("add"), back))
    return made.union(pages.sparkSession.createDataFrame(FIXED, "pattern string, action string, at string").selectExpr("pattern", "action", "to_date(at)"))


def example_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2024-01-01")), _number(F.concat(F.col("page_id").cast("string"), F.lit("/"), F.coalesce("url", F.lit(""))), "fetch", 366)).alias("fetched_on"))


def verdicts(pages: DataFrame) -> DataFrame:
    judged = judge(example_captures(pages), example_events(pages))
    return judged.select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "blocked", "n_entries", "entry")


SQL = r"""
WITH p AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
    list_filter(string_split(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/'), lambda x: x <> '') AS segs,
    DATE '2024-01-01' + CAST(CAST('0x' || substr(md5('fetch' || CAST(page_id AS VARCHAR) || '/' || coalesce(url, '')), 1, 6) AS BIGINT) % 366 AS INTEGER) AS day
  FROM pages
), c AS (SELECT *, '/' || array_to_string(segs, '/') AS path FROM p),
h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
hp AS (SELECT DISTINCT host || '/' || array_to_string(segs[1:3], '/') AS path FROM c WHERE host IS NOT NULL AND len(segs) > 0),
n AS (
  SELECT host AS pattern FROM h WHERE CAST('0x' || substr(md5('pick' || host), 1, 6) AS BIGINT) % 3 = 0
  UNION SELECT regexp_replace(host, '^[^.]*\.', '') FROM h WHERE CAST('0x' || substr(md5('parent' || host), 1, 6) AS BIGINT) % 40 = 0
  UNION SELECT path FROM hp WHERE CAST('0x' || substr(md5('deep' || path), 1, 6) AS BIGINT) % 11 = 0
  UNION SELECT regexp_extract(path, '^[^/]*/[^/]*') FROM hp WHERE CAST('0x' || substr(md5('wide' || path), 1, 6) AS BIGINT) % 7 = 0
), t AS (
  SELECT pattern, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5('add' || pattern), 1, 6) AS BIGINT) % 300 AS INTEGER) AS added,
    CAST(CAST('0x' || substr(md5('stay' || pattern), 1, 6) AS BIGINT) % 90 AS INTEGER) AS stay,
    CAST(CAST('0x' || substr(md5('back' || pattern), 1, 6) AS BIGINT) % 60 AS INTEGER) AS back,
    CAST('0x' || substr(md5('again' || pattern), 1, 6) AS BIGINT) % 2 = 0 AS again FROM n
), given AS (
  SELECT pattern, 'add' AS action, added AS day_at FROM t UNION ALL SELECT pattern, 'remove', added + stay FROM t UNION ALL SELECT pattern, 'add', added + stay + back FROM t WHERE again
  UNION ALL SELECT * FROM (VALUES @FIXED@)
), ev AS (
  SELECT DISTINCT lower(split_part(pattern, '/', 1)) || CASE WHEN contains(pattern, '/') THEN '/' || array_to_string(list_filter(string_split(pattern, '/')[2:], lambda x: x <> ''), '/') ELSE '' END AS pattern, action, day_at FROM given
), iv AS (
  SELECT * FROM (SELECT pattern, action, day_at AS since, lead(day_at) OVER (PARTITION BY pattern ORDER BY day_at, action) AS until FROM ev)
  WHERE action = 'add' AND (until IS NULL OR until > since)
), v AS (
  SELECT page_id, url, count(*) AS n_entries, min(pattern) AS entry
  FROM (SELECT DISTINCT page_id, url, host, path, day FROM c) c JOIN iv
    ON CASE WHEN contains(iv.pattern, '/') THEN starts_with(rtrim(c.host || c.path, '/') || '/', rtrim(iv.pattern, '/') || '/') ELSE ends_with('.' || c.host, '.' || iv.pattern) END
    AND since <= day AND (until IS NULL OR until > day)
  GROUP BY page_id, url
)
SELECT c.page_id, host, CAST(day AS VARCHAR) AS fetched_on, n_entries IS NOT NULL AS blocked, CAST(coalesce(n_entries, 0) AS BIGINT) AS n_entries, entry
FROM c LEFT JOIN v ON c.page_id IS NOT DISTINCT FROM v.page_id AND c.url IS NOT DISTINCT FROM v.url
""".replace("@FIXED@", ", ".join(f"('{p}', '{a}', DATE '{d}')" for p, a, d in FIXED))
