"""URL filters: longest-match rules, then a blocked Bloom filter before an exact hash join.

The list of canonical URLs may be as large as the pages. Its Bloom filter is a table with one row
of 512 bits for each block, joined on the block's number: it is sent to all tasks only while it is
small, and is shuffled beyond that. Only possible hits meet the list itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read

#: (host, path, verdict); the empty host fits none.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The query lists the canonical URLs of every so manieth page.
LISTED = 50
BITS_A_URL, LANES = 12, 8
#: A filter of at most so many blocks (64 bytes each) is sent to all tasks.
BROADCAST_BLOCKS = 1 << 16


def host_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, lower_host(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))), F.lit(""))


def lower_host(host: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without user, default port, last dot, `www.` or `m.`, and path without a last slash; null without a host."""
    plain = host
    for part in (r"^.*@", r":(80|443)?$", r"\.$", r"^(www|m)\."):
        plain = F.regexp_replace(plain, part, "")
    return F.when(host != "", F.concat(plain, F.regexp_replace(path, r"/+$", "")))


def rule_of(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES if rules is None else rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _bits(url: Column, blocks: int) -> list[Column]:
    """Number of the block, and a mask with one bit for each lane."""
    own = F.xxhash64(url, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(own, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(LANES)]
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(masks)]]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of the column `url`."""
    return listed.select(*_bits(F.col("url"), blocks)).groupBy("block").agg(*[F.expr(f"bit_or(m{i})").alias(f"w{i}") for i in range(LANES)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules=None) -> DataFrame:
    """One row for each page: host, path, the rule that decides, and the verdict.

    Without a rule the list decides: a page whose canonical URL is in `listed` (column `url`) is
    blocked, any other allowed. A null url, or one without `://`, has an empty host and path, fits
    no rule and is allowed. Nulls and repeats in the list are ignored; an empty list blocks
    nothing. Repeated pages get the same verdict; other columns are ignored."""
    url = F.col("url").cast("string")
    split = pages.select(F.col("page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    split = split.select("*", canonical(F.col("host"), F.col("path")).alias("own"), rule.alias("rule"), verdict.alias("ruled"))
    known = materialize(listed.select("url").where(F.col("url").isNotNull()).distinct())
    blocks = max(1, -(-known.count() * BITS_A_URL // (64 * LANES)))
    filters = bloom(known, blocks)
    if blocks <= BROADCAST_BLOCKS:
        filters = F.broadcast(filters)
    probes = split.select("*", *_bits(F.coalesce("own", F.lit("")), blocks)).join(filters, "block", "left")
    passes = F.col("own").isNotNull()
    for i in range(LANES):
        passes = passes & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(F.col(f"m{i}")) != 0)
    judged = materialize(probes.select("page_id", "host", "path", "own", "rule", "ruled", (passes & F.col("ruled").isNull()).alias("possible")))
    hits = judged.where("possible").join(known.select(F.col("url").alias("own"), F.lit(True).alias("hit")), "own", "left")
    columns = ["page_id", "host", "path", "rule", "ruled", "hit"]
    both = hits.select(*columns).union(judged.where("not possible").withColumn("hit", F.lit(None).cast("boolean")).select(*columns))
    verdict = F.coalesce("ruled", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op8_blocked_bloom(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    listed = pages.where(F.col("page_id") % LISTED == 0)
    return judge_urls(pages, listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("url")))


QUERIES = {"op8_blocked_bloom": op8_blocked_bloom}

ORACLE = {
    "op8_blocked_bloom": r"""
WITH s AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '\.$', ''), '^(www|m)\.', '') || regexp_replace(path, '/+$', '') END AS own FROM s),
listed AS (SELECT DISTINCT own FROM c WHERE page_id % 50 = 0),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS ruled
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(ruled, CASE WHEN c.own IN (SELECT own FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON fit.page_id = c.page_id
""",
}
