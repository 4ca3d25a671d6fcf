"""URL filter: path rules first, then a blocked Bloom filter of listed canonical URLs before an exact join.

Rules are a short fixed list of (host, path prefix) with a verdict; the longest that fits wins. A URL no rule
fits is judged by a list of canonical URLs: the list is folded into a blocked Bloom filter (one row of eight 32-bit
words per block, a bit in each word), a page whose block lacks one of its bits can't be listed, and the
possible hits alone go on to an exact join on the canonical URL, which removes false positives. The filter
is a table of blocks built by a distributed aggregation; Spark broadcasts it only below its size threshold.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule, is listed never and
allowed; repeated rows are judged alike; null page_ids stay; an empty table or list gives no rows or no hits; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, materialise


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the query.
RULES = [
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
]
#: Listed URLs per block of 256 bits: about 20 bits each, hence some 1 in 10,000 false hits.
#: Listed URLs that are broadcast at most.
BROADCAST_URLS = 1_000_000
PER_BLOCK = 12
WORDS = 8


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www., m. or a port, and the path without .html and without a closing slash."""
    short = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^(?:www|m)\.", "")
    return F.when(host == "", F.lit(None)).otherwise(F.concat(short, F.regexp_replace(path, r"(?:\.html|/)$", "")))


def rule_for(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, by host and then by path; null where none does."""
    ordered = sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)
    name = verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def block_of(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bit_of(url: Column, word: int) -> Column:
    """The URL's bit in a word of its block, as a long with that bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(word), url), F.lit(32)).cast("int"))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7: the filter of the `canonical` column of listed."""
    url = F.col("canonical")
    return listed.groupBy(block_of(url, blocks).alias("block")).agg(*(F.bit_or(bit_of(url, i)).alias(f"w{i}") for i in range(WORDS)))


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[UrlRule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed (by the exact join) of each page.

    listed: a DataFrame whose first column holds canonical URLs; nulls and repeats in it don't matter.
    """
    rules = RULES if rules is None else rules
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    listing = materialise(listed.select(F.col(listed.columns[0]).cast("string").alias("canonical")).where("canonical is not null").distinct(), "listed-urls")
    blocks = max(1, -(-listing.count() // PER_BLOCK))
    bloom = materialise(bloom_blocks(listing, blocks), "url-bloom")
    open_rows = rows.where("rule is null and canonical is not null")
    probed = open_rows.select("canonical", block_of(F.col("canonical"), blocks).alias("block")).distinct().join(bloom, "block")
    possible = reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(bit_of(F.col("canonical"), i)) != 0 for i in range(WORDS)))
    hits = probed.where(possible).select("canonical").join(listing, "canonical", "left_semi").withColumn("listed", F.lit(True))
    hits = materialise(hits, "listed-hits")
    # URLs without a host match nothing; keys of their own keep them from one task where the join is shuffled
    key = F.coalesce("canonical", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    joined = rows.withColumn("key", key).join(broadcast_if_small(hits.withColumnRenamed("canonical", "key"), BROADCAST_URLS), "key", "left")
    found = F.coalesce("listed", F.lit(False))
    return joined.select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(found, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "canonical", found.alias("listed"),
    )


def tracked_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of all pages that were seen with a tracking parameter: the list of the registered query."""
    url = F.col("url").cast("string")
    seen = pages.where(url.rlike(r"[?&]utm_source="))
    return seen.select(canonical(host_of(url), path_of(url)).alias("canonical"))


SQL = """
WITH p AS (
  SELECT page_id, url,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
c AS (
  SELECT *, CASE WHEN host = '' THEN NULL ELSE
         regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(?:www|m)[.]', '') || regexp_replace(path, '(?:[.]html|/)$', '') END AS canonical FROM p),
r(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (
  SELECT c.page_id, c.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM c JOIN r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY c.page_id, c.url),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(url, '[?&]utm_source=') AND canonical IS NOT NULL)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f ON c.page_id = f.page_id AND c.url = f.url LEFT JOIN l ON c.canonical = l.canonical
"""
