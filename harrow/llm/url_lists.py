"""URL filters: captures against list entries that were active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from harrow.llm.common import hash60, read
from harrow.llm.registry import query

PERIOD_S = 28 * 86_400
FOREVER = 2 ** 62


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and a leading www."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", ""))
    return F.regexp_replace(bare, r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path without query, fragment and final slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.regexp_replace(path, r"/+$", "")


def url_patterns(url: Column) -> Column:
    """All patterns that can match a URL: its host and parents, and host with path starts."""
    host, parts = host_of(url), F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(host != "", F.array_distinct(F.concat(parents, F.filter(
        starts, lambda s: ~s.endswith("/"))))).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (``pattern, action, at, entry_id``) as intervals ``pattern, action, since, until``.

    An entry holds until the next one of its pattern; ``remove`` ends it. Of entries of
    one moment the largest ``entry_id`` holds. Entries without pattern, action or date are left out.
    """
    known = entries.where("pattern IS NOT NULL AND action IS NOT NULL AND at IS NOT NULL")
    once = known.groupBy("pattern", "at").agg(F.max(F.struct("entry_id", "action")).alias("_last"))
    after = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return once.select("pattern", F.lower("_last.action").alias("action"), F.col("at").alias("since"),
                       F.coalesce(after, F.lit(FOREVER)).alias("until")).where("action <> 'remove'")


def decide(captures: DataFrame, entries: DataFrame, period_s: int = PERIOD_S) -> DataFrame:
    """Captures (``page_id, url, fetched``) with the verdict of the lists as they were then.

    Adds ``blocked, pattern, action, since, n_active``. Times are seconds. Of the active entries
    the longest pattern decides, a path before a host. Intervals are cut into periods and
    joined on pattern and period, so a host that holds a third of all captures is
    spread over time and its intervals meet only captures of their own period. A capture without
    URL or time, or with no host, matches nothing and is not blocked. Every row
    comes back once, repeated rows each.
    """
    span = captures.agg(F.min("fetched"), F.max("fetched")).first()
    first, last = (0, -1) if span[0] is None else span
    low, high = F.greatest("since", F.lit(first)), F.least(F.col("until") - 1, F.lit(last))
    spread = validity(entries).where(low <= high).select(
        "pattern", "action", "since", "until",
        F.explode(F.sequence(F.floor(low / period_s), F.floor(high / period_s))).alias("period"))
    # Equal captures are judged once.
    judged = captures.select("url", "fetched").where("url IS NOT NULL AND fetched IS NOT NULL").distinct()
    keyed = judged.select("url", "fetched", F.explode(url_patterns(F.col("url"))).alias("pattern"),
                          F.floor(F.col("fetched") / period_s).alias("period"))
    active = keyed.join(spread, ["pattern", "period"]).where("since <= fetched AND fetched < until")
    rank = F.struct(F.col("pattern").contains("/").alias("path"), F.length("pattern").alias("size"),
                    "pattern", "action", "since")
    verdicts = active.groupBy("url", "fetched").agg(
        F.max(rank).alias("_best"), F.count(F.lit(1)).alias("n_active"))
    names = [c for c in captures.columns if c not in ("blocked", "pattern", "action", "since", "n_active")]
    return captures.select(*names).join(verdicts, ["url", "fetched"], "left").select(
        *names, F.coalesce(F.col("_best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("_best.pattern").alias("pattern"), F.col("_best.action").alias("action"),
        F.col("_best.since").alias("since"), F.coalesce("n_active", F.lit(0)).alias("n_active"))


# --- captures and lists of the check tables ---------------------------------

START_S = 1_704_067_200     # 2024-01-01


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a time of fetching that their id gives, over a year and a half."""
    at = F.lit(START_S) + F.pmod(F.col("page_id") * 7_919_983, F.lit(500 * 86_400))
    return pages.select("page_id", "url", at.alias("fetched"))


def page_lists(pages: DataFrame) -> DataFrame:
    """A list with a history for the hosts, parent domains and first folders among the pages.

    A digest of the pattern dates its entries: listed one day, lifted or allowed later, some
    listed again.
    """
    url = F.col("url")
    host, folder = host_of(url), F.regexp_extract(path_of(url), r"^/([^/]+)", 1)
    parent = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    patterns = pages.select(F.explode(F.array(host, parent, F.when(
        folder != "", F.concat(host, F.lit("/"), folder)))).alias("pattern")).where(
        "pattern <> ''").distinct()
    h = patterns.withColumn("h", hash60(F.col("pattern")))
    day = F.pmod(F.col("h"), F.lit(300))
    listed = F.when(F.col("pattern").contains("/"), "allow").otherwise("block")
    lifted = F.when(F.pmod(F.col("h"), F.lit(3)) == 0, "remove").otherwise("allow")
    again = day + 60 + F.pmod(F.col("h"), F.lit(90))
    steps = F.array(*[
        F.struct(F.lit(k).alias("step"), action.alias("action"), on.alias("day"))
        for k, (action, on) in enumerate([(listed, day), (lifted, day + 60), (F.lit("block"), again)], 1)])
    return h.where(F.pmod(F.expr("h div 1000"), F.lit(4)) < 3).select(
        "pattern", F.explode(steps).alias("s")).select(
        "pattern", F.col("s.action").alias("action"), (F.lit(START_S) + F.col("s.day") * 86_400).alias("at"),
        F.col("s.step").alias("entry_id"))


# Joins every capture with every interval of its patterns, without periods.
LISTS_SQL = r"""WITH parsed AS (SELECT page_id, url, 1704067200 + (page_id * 7919983) % 43200000 AS fetched,
  regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)),
    '^.*@|:[0-9]*$', '', 'g'), '^www\.', '') AS host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+$', '') AS path
  FROM pages),
named AS (SELECT DISTINCT pattern FROM (SELECT unnest([host, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1),
    CASE WHEN regexp_extract(path, '^/([^/]+)', 1) <> '' THEN host || '/' || regexp_extract(path, '^/([^/]+)', 1)
    END]) AS pattern FROM parsed) WHERE pattern <> ''),
hashed AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 15) AS BIGINT) AS h FROM named),
entries AS (SELECT pattern, unnest([
    {'n': 1, 'action': CASE WHEN contains(pattern, '/') THEN 'allow' ELSE 'block' END, 'day': h % 300},
    {'n': 2, 'action': CASE WHEN h % 3 = 0 THEN 'remove' ELSE 'allow' END, 'day': h % 300 + 60},
    {'n': 3, 'action': 'block', 'day': h % 300 + 60 + h % 90}]) AS s FROM hashed WHERE (h // 1000) % 4 < 3),
dated AS (SELECT pattern, 1704067200 + s.day * 86400 AS since, arg_max(s.action, s.n) AS action
  FROM entries GROUP BY ALL),
intervals AS (SELECT pattern, action, since,
  coalesce(lead(since) OVER (PARTITION BY pattern ORDER BY since), 4611686018427387904) AS until FROM dated),
keys AS (SELECT page_id, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(2, len(string_split(host, '.')))), lambda k:
      array_to_string(string_split(host, '.')[k:], '.')),
    list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1), lambda k:
      host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:k], '/'))))) AS pattern
  FROM parsed WHERE host <> ''),
active AS (SELECT page_id, fetched, pattern, action, since FROM keys JOIN intervals USING (pattern)
  WHERE since <= fetched AND fetched < until AND action <> 'remove'),
best AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n_active FROM active QUALIFY row_number() OVER (
  PARTITION BY page_id ORDER BY contains(pattern, '/') DESC, length(pattern) DESC, pattern DESC) = 1)
SELECT parsed.page_id, url, parsed.fetched, coalesce(action = 'block', false) AS blocked, pattern, action, since,
  coalesce(n_active, 0) AS n_active FROM parsed LEFT JOIN best ON parsed.page_id = best.page_id"""


@query("op5_url_lists", LISTS_SQL)
def op5_url_lists(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url")
    return decide(page_captures(pages), page_lists(pages))
