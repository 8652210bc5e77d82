"""URL filters: rules by host and path prefix, in DataFrame operations only.

Listed canonical URLs are expressions of host and path; a URL fits if its host is
the listed host or below it and its path starts with the listed path. A URL is
looked up by its own expressions: each host suffix with as many labels as some
listed host, each path prefix as long as some listed path. A blocked Bloom filter
of the listed expressions (one 64-bit block per expression, ``BITS_SET`` bits in it)
passes possible hits on to an exact hash join, which removes the false positives.
Of the exact hits the longest expression decides; then the longest host, then the
expression that comes first. Without a rule, the list of blocked sites decides, looked up the same way; without
a hit there the URL is allowed.

Defined cases. A null URL or one without ``://`` has an empty host and path, and is
allowed. Rows that repeat a page_id or a URL each get their row. An empty table gives no
rows; empty lists allow everything. Other columns of the table are not read.

Scale. Only page_id and url are read. The filter has at most ``blocks`` rows whatever the
length of the list (a fuller filter passes more to the exact join), so that its broadcast is
bounded: 16 bytes a block, 1 MB. Hits are reduced to one row per URL with a map-side
combine; the join back on url grows with the table and is always a sort-merge join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: The query's rules as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Sites that the query's list of canonical URLs blocks where no rule fits.
SITES = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
BLOCKS, BITS_SET = 1 << 16, 4


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def listing(df: DataFrame) -> DataFrame:
    """Rules or sites (first boolean: before others; verdict, host, path) as expressions with their sizes."""
    return df.select("first", "verdict", "host", "path", F.concat("host", "path").alias("expression"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("reach")).where("host <> ''").distinct()


def _block(x: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(blocks))


def _mask(x: Column) -> Column:
    h, mask = F.xxhash64(x), F.lit(0).cast("long")
    for k in range(BITS_SET):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 20 + 6 * k).bitwiseAND(63).cast("int")))
    return mask


def bloom(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The blocked Bloom filter: at most `blocks` rows of block and word."""
    return listed.select(_block(F.col("expression"), blocks).alias("block"), _mask(F.col("expression")).alias("word")).groupBy("block").agg(F.bit_or("word").alias("word"))


def judge(pages: DataFrame, listed: DataFrame, *, blocks: int = BLOCKS) -> DataFrame:
    """page_id, url, host, path, rule and verdict of each row of pages (page_id, url).

    listed: see listing; rows with first = true are rules, others decide where no rule fits.
    """
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    listed = c.written(listed, "listed")
    shapes = [tuple(r) for r in listed.select("labels", "reach").distinct().collect()]  # a few: lengths of the listed
    if not shapes:
        return base.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    labels = F.split("host", r"\.")
    suffix = lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, F.lit(k)), ".")
    own = [F.when((F.size(labels) >= k) & (F.length("path") >= n), F.concat(suffix(k), F.substring("path", 1, n))) for k, n in sorted(shapes)]
    asked = base.where("host <> ''").select("url", F.explode(F.array_compact(F.array(*own))).alias("expression"))
    asked = asked.withColumn("block", _block(F.col("expression"), blocks)).withColumn("mask", _mask(F.col("expression")))
    possible = asked.join(F.broadcast(bloom(listed, blocks)), "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("url", "expression")
    hits = possible.join(listed, "expression")
    order = F.struct((~F.col("first")).alias("late"), (-F.length("expression")).alias("size"), (-F.length("host")).alias("host_size"), "expression", "verdict")
    best = c.written(hits.groupBy("url").agg(F.min(order).alias("best")).select(F.col("url").alias("_url"), "best"), "verdicts")
    rule = F.when(~F.col("best.late"), F.col("best.expression"))
    return base.join(best.hint("merge"), base["url"] == best["_url"], "left").select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
