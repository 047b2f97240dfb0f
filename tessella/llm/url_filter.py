"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join that removes its false positives.

The canonical form of a URL has: the host in lower case without ``www.``; no scheme, user, port 80 or 443, fragment or ``index.html``; a query
without tracking parameters, the rest sorted; no slash at the end of the path.  Nothing else is taken for equal (``/x.html`` and ``/x`` are two pages, and so
are those of a mobile host).

The filter is a table of blocks: block number -> four 64-bit words.  One 64-bit hash of a canonical URL picks its block and, by
its other bits, one bit in each word, so a probe touches one block.  Blocks are built with ``bit_or`` and probed by an equi-join on the
block number, within whole-stage code generation.  There are ``2**k`` blocks, at least ``bits_per_url`` bits for each listed URL.

Plan: the distinct listed URLs are written once to the shared folder, from which filter and list are read; the pages are read once.  Both joins are left joins
that Spark broadcasts or shuffles by the size of the filter and of the list, which it reads from their files.  In the second only possible hits bear a key
that can meet the list; the others bear one that can't, spread by their hash, so that no task gets them all.

Defined results: a null, blank or host-less URL has a null canonical form and is never listed; listed URLs count once however
often and in whatever spelling they are listed; every row gives one result row, repeated ones too; very long URLs are taken whole; an empty list lists
nothing and empty pages give no rows; other columns of the pages pass through, whatever their names, but for ``canonical_url``, ``possible`` and ``listed``, which are
replaced; columns of the list besides ``url`` are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Query parameters that don't change what a URL shows.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


@dataclass(frozen=True)
class Filter:
    bits_per_url: int = 16


def canonical(url: Column) -> Column:
    """Canonical form, or null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"(?i)^[a-z][a-z0-9+.-]*://|^//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^.*@|:(80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/index\.html?$|/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(blocks))


def _word(h: Column, i: int) -> Column:
    """The one bit of word i."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))


def build(listed: DataFrame, f: Filter = Filter()) -> tuple[DataFrame, int]:
    """The filter of a table (canonical_url) of distinct URLs as rows (block, w0 .. w3), and how many blocks it spans."""
    blocks, n = 1, listed.count()
    while blocks * 256 < n * f.bits_per_url:
        blocks *= 2
    h = F.xxhash64("canonical_url")
    return listed.select(_block(h, blocks).alias("block"), *(_word(h, i).alias(f"w{i}") for i in range(4))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4))), blocks


def mark(pages: DataFrame, listed: DataFrame, f: Filter = Filter()) -> DataFrame:
    """``pages`` with canonical_url, possible (passed the filter) and listed (is in ``listed.url``)."""
    spark = pages.sparkSession
    kernel.shared_checkpoints(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/urls-{uuid.uuid4().hex}"
    listed.select(canonical(F.col("url")).alias("canonical_url")).where("canonical_url is not null").distinct().write.parquet(at)
    names = spark.read.schema("canonical_url string").parquet(at)
    table, blocks = build(names, f)
    own = [c for c in pages.columns if c not in ("canonical_url", "possible", "listed")]
    free = "_"  # begins the names of our own columns
    while any(c.startswith(free) for c in own):
        free += "_"
    out = pages.select(*own, canonical(F.col("url")).alias("canonical_url")).withColumn(f"{free}hash", F.xxhash64("canonical_url"))
    h, hit = F.col(f"{free}hash"), F.col("canonical_url").isNotNull()
    for i in range(4):
        hit = hit & (F.col(f"{free}w{i}").bitwiseAND(_word(h, i)) != 0)
    table = table.select(F.col("block").alias(f"{free}block"), *(F.col(f"w{i}").alias(f"{free}w{i}") for i in range(4)))
    out = out.join(table, _block(h, blocks) == F.col(f"{free}block"), "left").withColumn("possible", F.coalesce(hit, F.lit(False)))
    key = F.when(F.col("possible"), F.col("canonical_url")).otherwise(F.concat(F.lit(" "), h.cast("string")))  # no canonical URL begins with a space
    exact = names.select(F.col("canonical_url").alias(f"{free}url"))
    out = out.join(exact, key == F.col(f"{free}url"), "left")
    return out.select(*own, "canonical_url", "possible", F.col(f"{free}url").isNotNull().alias("listed"))
