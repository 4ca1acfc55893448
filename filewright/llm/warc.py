"""WARC archives written and read with Spark's own text source and sink.

Writing: one row is one record; the sink's line separator is the blank lines that end a record,
so any file system that Spark writes to will do and a lost task is simply run again.

Reading: the source splits at the magic, wherever it stands, so every chunk starts at a place
that may be a record. Tasks turn each chunk into an edge from its offset to the offset that its
own header gives for the next record. Within a split edges are shortened to where the chain
leaves the split; across splits pointer jumping doubles the jumps from the file's start. What the
start does not reach is payload, and goes back to the record that covers it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filewright.llm._shared import shared_dir, stash

# Fixed values of the format.
MAGIC, NEWLINE, BLANK, RECORD_END = "WARC/", "\r\n", "\r\n\r\n", "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Payloads of fewer bytes are never revisited.
MIN_BYTES = 0
#: Revisits are broadcast up to this many, three numbers each; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Records in an archive file at most.
FILE_RECORDS = 20_000


def digest(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column."""
    text = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(text, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per page with what its record says: digest, size, type, and whom it refers to.

    Of equal payloads of at least ``min_bytes`` the one with the smallest page_id (nulls last) is
    the response and the others revisit it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload"))
    own = own.withColumn("payload_digest", digest(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # the pages are read again below, so rows are told apart by what they hold, not by their place
    content, same = ["payload_digest", "payload_bytes"], F.struct("page_id", "url")
    keyed = own.where(F.col("payload_bytes") >= min_bytes).groupBy("page_id", "url", *content).agg(F.count("*").alias("copies"))
    order = F.struct(F.col("page_id").isNull(), "page_id", "url")
    first = keyed.groupBy(*content).agg(F.min_by(same, order).alias("first"), F.min_by("copies", order).alias("copies"), F.sum("copies").alias("n")).where("n > 1").drop("n")
    first = stash(first, "warc-first")
    known = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    told = own.join(known, content, "left").withColumn("again", F.coalesce(~same.eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull())
    columns = ["page_id", "url", "payload", *content]

    def made(rows: DataFrame) -> DataFrame:
        refers_to = F.when(F.col("again"), F.col("first.page_id"))
        return rows.select(*columns, refers_to.alias("refers_to"), F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"))

    if first.where("copies > 1").isEmpty():
        return made(told)
    # of rows that are equal in all, one is the response and the others revisit it
    twins = F.coalesce(~F.col("again") & (F.col("copies") > 1), F.lit(False))
    one = told.where(twins).dropDuplicates(["page_id", "url", *content])
    spread = one.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("again", F.col("at") > 1).drop("at")
    return made(told.where(~twins).unionByName(spread))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write one response or revisit record per row of ``pages(page_id, url, html)``.

    A null html is an empty payload and a null url an empty one; rows are never dropped, so
    repeated rows become revisits; other columns are ignored. A revisit holds the HTTP header of
    the response that it stands for and no payload.
    """
    known = records(pages, min_bytes)
    length = lambda text: F.octet_length(text).cast("string")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE))
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BLANK))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("payload").cast("string"))).otherwise(http)
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    again = F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Refers-To", name(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise("")
    head = F.concat(
        F.lit(VERSION + NEWLINE),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        again,
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length(block)),
        F.lit(NEWLINE),
    )
    known.select(F.concat(head, block).alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


Derived = dict[str, Callable[[Column], Column]]


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """``(file, split, order, bytes, sum)``: what stands between two magics, in the order of a file.

    Orders hold within one run of the frame: another may split the files otherwise. Bytes that are
    needed again are found by their sum.
    """
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("order"), F.col("value").cast("binary").alias("bytes"), F.sha2(F.col("value").cast("binary"), 256).alias("sum"))


def chunks(read: DataFrame, derive: Derived) -> DataFrame:
    """Every place where the magic stands: ``(file, split, order, sum, start, size, next, head, length, ...)``.

    next is the offset that follows the record, if the chunk starts with a record header. The
    columns of ``derive`` are made from the block of a chunk that holds a whole record, in the
    same pass, so payloads are never shuffled.
    """
    text, magic = F.col("bytes").cast("string"), len(MAGIC)
    head = F.when((F.locate(BLANK, text) > 0) & text.rlike(r"^\d+\.\d+\r\n"), F.substring_index(text, BLANK, 1))
    read = read.withColumn("head", head).withColumn("size", (F.octet_length("bytes") + magic).cast("long"))
    read = read.withColumn("x", _header("Content-Length")).withColumn("length", F.expr("if(try_cast(x as bigint) >= 0, try_cast(x as bigint), null)")).drop("x")
    # from the start of the magic to the start of the next record
    read = read.withColumn("span", magic + F.octet_length("head") + len(BLANK) + F.col("length") + len(RECORD_END))
    whole = F.coalesce(F.col("span") == F.col("size"), F.lit(False))
    block = F.when(whole, F.substring(F.col("bytes"), F.octet_length("head") + len(BLANK) + 1, F.col("length").cast("int")))
    made = [make(block).alias(name) for name, make in derive.items()]
    read = stash(read.select("file", "split", "order", "sum", "size", "head", "length", "span", whole.alias("whole"), *made), "warc-chunks")
    # chunks tile a file, so their sizes give their offsets: sums of splits, then sums within one;
    # the first chunk of a file stands before its first magic, hence the offset of one magic
    by_split = read.groupBy("file", "split").agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("file").orderBy("split")) - F.col("sum")
    inside = F.sum("size").over(Window.partitionBy("file", "split").orderBy("order")) - F.col("size")
    light = read.select("file", "split", "order", "size", "span").withColumn("inside", inside)
    placed = light.join(by_split.select("file", "split", before.alias("before")), ["file", "split"])
    placed = placed.withColumn("start", F.col("before") + F.col("inside") - magic).select("order", "start", (F.col("start") + F.col("span")).alias("next"))
    return read.join(placed, "order").where("start >= 0").drop("span")


def _exits(split: pd.DataFrame) -> pd.DataFrame:
    """For every chunk of a split where its chain leaves the split; null if it breaks there."""
    ordered = split.sort_values("start", ascending=False)
    last, leaves = ordered.start.iloc[0], {}
    for start, after in zip(ordered.start, ordered.next, strict=True):
        leaves[start] = after if after > last else leaves.get(after, -1)
    return pd.DataFrame({"file": split.file, "start": split.start, "to": [leaves[x] for x in split.start]})


def _on_chain(split: pd.DataFrame) -> pd.DataFrame:
    """The chunks of a split that the chain from its entry visits."""
    after = dict(zip(split.start, split.next, strict=True))
    at, found = int(split.entry.iloc[0]), []
    while at in after:
        found.append(at)
        at = after[at]
    return pd.DataFrame({"file": split.file.iloc[0], "start": found})


def _reached(edges: DataFrame) -> DataFrame:
    """``(file, start)`` of the chunks that the chain from their file's start reaches.

    A split's candidates are bounded by its bytes. Across splits the jumps double each round, so
    a file of n splits takes log n rounds.
    """
    hops = stash(edges.groupBy("file", "split").applyInPandas(_exits, "file string, start long, to long").where("to >= 0"), "warc-hops")
    entries = edges.where("start = 0").select("file", "start", "split")
    known = 0
    while True:
        entries = stash(entries, "warc-entries")
        n = entries.count()
        if n == known:
            break
        known = n
        further = entries.join(hops, ["file", "start"]).select("file", F.col("to").alias("start")).join(edges.select("file", "start", "split"), ["file", "start"])
        entries = entries.unionByName(further).distinct()
        onward = hops.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        hops = stash(hops.join(onward, ["file", "to"]).select("file", "start", F.col("further").alias("to")), "warc-hops")
    entered = edges.join(entries.groupBy("file", "split").agg(F.min("start").alias("entry")), ["file", "split"])
    return entered.groupBy("file", "split").applyInPandas(_on_chain, "file string, start long")


def read(spark: SparkSession, path: str, derive: Derived | None = None) -> DataFrame:
    """One row per record: ``(file, offset, record_type, record_id, uri, digest, refers_to, ...)``.

    ``derive`` makes further columns from a record's block of bytes; without it the block itself
    is returned. Text that only looks like a record inside a payload is part of that payload; a
    record cut short is not returned, nor what follows a broken record in its file.
    """
    derive = derive or {"block": lambda block: block}
    scan = scanned(spark, path)
    found = stash(chunks(scan, derive), "warc-parsed")
    edges = found.select("file", "split", "start", "next").where("next is not null")
    reached = stash(_reached(edges), "warc-reached").withColumn("real", F.lit(True))
    fields = ("record_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("uri", "WARC-Target-URI"), ("digest", "WARC-Payload-Digest"), ("refers_to", "WARC-Refers-To")
    named = [_header(name).alias(column) for column, name in fields]
    whole = found.where("whole").join(reached, ["file", "start"], "left_semi").select("file", F.col("start").alias("offset"), *named, *derive)

    # a record with the magic in its payload spans several chunks; only those are gathered
    light = found.select("file", "split", "sum", "start", "whole", "head", "length").join(reached, ["file", "start"], "left")
    own = F.when(F.col("real"), F.col("start"))
    carried = light.groupBy("file", "split").agg(F.max(own).alias("latest"))
    carried = carried.select("file", "split", F.max("latest").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    owner = F.coalesce(F.max(own).over(Window.partitionBy("file", "split").orderBy("start")), F.col("carried"))
    owned = light.join(carried, ["file", "split"]).withColumn("offset", owner).where("offset is not null and not (coalesce(real, false) and whole)").select("file", "sum", "start", "offset", "head", "length")
    owned = stash(owned, "warc-owned")
    if owned.isEmpty():
        return whole
    again = scan.select("sum", "bytes").join(owned.select("sum").distinct(), "sum", "left_semi").dropDuplicates(["sum"])
    parts = stash(owned.join(again, "sum"), "warc-parts")
    magic = F.lit(MAGIC).cast("binary")
    body = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, magic, x["bytes"]))
    gathered = parts.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("parts")).withColumn("body", body)
    heads = parts.where("start = offset").select("file", "offset", "head", "length")
    block = F.substring(F.col("body"), len(MAGIC) + F.octet_length("head") + len(BLANK) + 1, F.col("length").cast("int"))
    spread = heads.join(gathered, ["file", "offset"]).withColumn("whole_block", block).where(F.octet_length("whole_block") == F.col("length"))
    return whole.unionByName(spread.select("file", "offset", *named, *(make(F.col("whole_block")).alias(name) for name, make in derive.items())))


def http_payload(block: Column) -> Column:
    """What follows the HTTP header of a content block."""
    skip = F.octet_length(F.substring_index(block.cast("string"), BLANK, 1)) + len(BLANK) + 1
    return F.substring(block, skip, F.octet_length(block))


def captured(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` as the archives say.

    A response's size and digest are those of the payload read back; a revisit's are those that
    its record states of the response.
    """
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(.*)>', 1), '') as bigint)")
    derive = {
        "bytes_read": lambda block: F.octet_length(http_payload(block)).cast("long"),
        "digest_read": lambda block: digest(http_payload(block)),
        "bytes_stated": lambda block: F.regexp_extract(block.cast("string"), r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1),
    }
    is_response = F.col("record_type") == "response"
    return read(spark, path, derive).select(
        page("record_id").alias("page_id"),
        F.when(is_response, F.col("bytes_read")).otherwise(F.expr("try_cast(bytes_stated as bigint)")).alias("payload_bytes"),
        F.when(is_response, F.col("digest_read")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.when(~is_response, page("refers_to")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` to a new folder of archives and read it back with :func:`captured`."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    return captured(spark, path)
