"""WARC transaction assembly: request, response and metadata records of one capture become one nested row.

Records are rows (record_id, type, concurrent_to, target_uri, date, headers, block): ids without angle brackets, ``concurrent_to`` an
array (a record may name several, in either direction), ``headers`` a map.  :func:`parse` makes them of raw record texts.

A capture is named by its *primary* record: a response, revisit, resource or conversion.  A record that names a primary one, or is named
by one, belongs to it (to the smallest of several).  The others that hang together through links, over however many steps, belong to the smallest
capture that any of them is linked to; if there is none, they are a capture of their own, named by the smallest record_id
that they have or name.

Defined results: no type is dropped: ``response`` is the primary record (``warc-type`` in its headers tells its kind; the smallest in content if a record_id
repeats with another, and a repeated row counts once), ``requests`` are all requests, ``metadata`` all other records, each ordered by record_id, and both may be
empty; links to unknown records only tell which records hang together; null ids or types are dropped; a null block stays null and a
very long or empty one stays whole; empty tables give no rows; other columns, whatever their names, are ignored.

Plan: the records are parsed once, into a table in the shared folder.  Link resolution reads its ids alone; only records that name no primary one
need more than one join, and components of the rest are found in a logarithmic number of rounds.  Primary records need no link, so their blocks move once,
to an aggregation by capture; the others, which are small, move once more, to find theirs.  A capture is one row, so its
records must fit into a task; nothing else has to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .signature_tree import components

PRIMARY = ("response", "revisit", "resource", "conversion")
_PARTS = ("response", "requests", "metadata")


def parse(raw: DataFrame) -> DataFrame:
    """Records of ``raw.record``: "WARC/1.x", header lines, an empty line, the block.  Texts of another shape are dropped."""
    head = F.regexp_replace(F.substring_index("record", "\r\n\r\n", 1), r"\r\n[ \t]+", " ")
    line = F.filter(F.split(head, "\r\n"), lambda x: x.contains(":"))
    pairs = F.transform(line, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    names = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    first = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.filter("pairs", lambda p: p["k"] == n)[0]["v"])))
    plain = lambda c: F.regexp_replace(c, "[<>]", "")
    rows = raw.where("record like 'WARC/1.%' and instr(record, '\r\n\r\n') > 0").select(pairs.alias("pairs"), F.expr("substring(record, instr(record, '\r\n\r\n') + 4)").alias("block"))
    named = F.transform(F.filter("pairs", lambda p: p["k"] == "warc-concurrent-to"), lambda p: plain(p["v"]))
    rows = rows.select(first.alias("headers"), named.alias("concurrent_to"), "block")
    h = lambda n: F.col("headers")[n]
    return rows.select(plain(h("warc-record-id")).alias("record_id"), F.lower(h("warc-type")).alias("type"), "concurrent_to", h("warc-target-uri").alias("target_uri"), h("warc-date").alias("date"), "headers", "block")


_USABLE = "record_id is not null and type is not null"


def capture_ids(records: DataFrame) -> DataFrame:
    """(record_id, capture_id) of every record; a primary record is a capture itself, and so is what shares its id."""
    kernel.shared_checkpoints(records.sparkSession)
    ids = records.where(_USABLE).select("record_id", F.col("type").isin(*PRIMARY).alias("is_primary"), F.coalesce("concurrent_to", F.array().cast("array<string>")).alias("named"))
    nodes = ids.groupBy("record_id").agg(F.max("is_primary").alias("is_primary"), F.array_distinct(F.flatten(F.collect_list("named"))).alias("named")).checkpoint()
    told = nodes.select(F.col("record_id").alias("a"), F.explode("named").alias("b")).where("b is not null and b <> a")
    links = told.union(told.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    primary = nodes.where("is_primary").select("record_id")
    others = nodes.where("not is_primary").select("record_id")
    # next to a primary record (ids that only links know take part, so that they can connect others)
    near = links.join(primary.withColumnRenamed("record_id", "b"), "b").groupBy("a").agg(F.min("b").alias("capture"))
    near = near.join(primary.withColumnRenamed("record_id", "a"), "a", "left_anti").checkpoint()
    far = links.join(primary.withColumnRenamed("record_id", "a"), "a", "left_anti").join(near, "a", "left_anti").checkpoint()
    touch = far.join(near.select(F.col("a").alias("b"), "capture"), "b").groupBy("a").agg(F.min("capture").alias("capture"))
    edges = far.join(near.select(F.col("a").alias("b")), "b", "left_anti").checkpoint()
    if edges.isEmpty():
        rest = touch.select(F.col("a").alias("record_id"), F.col("capture").alias("capture_id"))
    else:
        roots = components(edges).withColumnRenamed("node", "a")
        reached = touch.join(roots, "a", "left").groupBy(F.coalesce("root", "a").alias("root")).agg(F.min("capture").alias("capture")).checkpoint()
        group = far.select("a").distinct().join(roots, "a", "left").select("a", F.coalesce("root", "a").alias("root"))
        rest = group.join(reached, "root", "left").select(F.col("a").alias("record_id"), F.coalesce("capture", "root").alias("capture_id"))
    linked = near.select(F.col("a").alias("record_id"), F.col("capture").alias("capture_id")).union(rest)
    found = others.join(linked, "record_id", "left").select("record_id", F.coalesce("capture_id", "record_id").alias("capture_id"))
    return primary.select("record_id", F.col("record_id").alias("capture_id")).union(found)


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, target_uri, date, response, requests, metadata): one nested row for each capture."""
    spark = records.sparkSession
    kernel.shared_checkpoints(spark)
    headers = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    own = records.where(_USABLE).select("record_id", "type", "concurrent_to", "target_uri", "date", headers.alias("headers"), "block")
    at = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    own.write.option("compression", "zstd").parquet(at)
    own = spark.read.schema(own.schema).parquet(at)
    is_primary = F.col("type").isin(*PRIMARY)
    kind = F.when(is_primary, "response").when(F.col("type") == "request", "requests").otherwise("metadata")
    part = F.struct("record_id", "target_uri", "date", "headers", "block")
    others = own.where(~is_primary).join(capture_ids(own), "record_id")
    rows = own.where(is_primary).select(F.col("record_id").alias("capture_id"), kind.alias("kind"), part.alias("part")).union(others.select("capture_id", kind.alias("kind"), part.alias("part")))
    of = lambda k: F.when(F.col("kind") == k, F.col("part"))
    done = rows.groupBy("capture_id").agg(*(F.collect_list(of(k)).alias(k) for k in _PARTS)).select("capture_id", *(F.array_sort(F.array_distinct(k)).alias(k) for k in _PARTS))
    response = F.get("response", F.lit(0))
    some = F.coalesce(response, F.get("requests", F.lit(0)), F.get("metadata", F.lit(0)))
    return done.select("capture_id", some["target_uri"].alias("target_uri"), some["date"].alias("date"), response.alias("response"), "requests", "metadata")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records (as raw texts) of a crawl that fetched each page once: request, response, metadata, linked in both spellings
    of WARC practice: the request names the response, the metadata names the request."""
    key = lambda kind: F.concat(F.lit("urn:uuid:"), F.md5(F.concat(F.lit(kind + ":"), F.col("page_id").cast("string"))))
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace("url", r"^[a-z]+://[^/?#]*|#.*$", "")

    def record(kind: str, to: str | None, body: Column) -> Column:
        lines = [F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), key(kind), F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url")]
        if to:
            lines += [F.lit("\r\nWARC-Concurrent-To: <"), key(to), F.lit(">")]
        return F.concat(*lines, F.lit("\r\n\r\n"), body)

    request = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    response = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.col("html"))
    metadata = F.concat(F.lit("htmlLength: "), F.length("html").cast("string"), F.lit("\r\n"))
    some = pages.where("page_id is not null and url is not null and html is not null")
    return some.select(F.explode(F.array(record("response", None, response), record("request", "response", request), record("metadata", "request", metadata))).alias("record"))
