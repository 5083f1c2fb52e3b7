"""WARC archives with segmented records (operator 10).

Writing: a page is an HTTP response with chunked transfer framing. A block longer
than a segment is split; the first record names segment 1, continuation records
name their origin and number, the last one the total length. Pages whose payload
equals an earlier page's are revisit records without a block. Records are text in
UTF-8 that ends in two line breaks, so Spark's text writer lays the files down in
the shared folder, gzip-compressed, with a bounded number of bounded records each.

Reading: files are parsed by content length; continuation records are grouped by
their origin, ordered by number and checked for gaps and total length, and the
chunked framing is decoded.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, heavy_table, heavy_values, new_folder, spread_join, text_of

SEGMENT = 32_768  # characters of a block in one record
CHUNK = 8_192  # characters of a chunk of the transfer framing
LEAST_REVISIT = 100  # bytes; shorter payloads are always stored
RECORDS = 500  # records of a file, so at most 64 MB of text
_END = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(_END))


def _parts(text: Column, size: int) -> Column:
    """Array of pieces of at most ``size`` characters; none for an empty text."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunked(text: Column, size: int = CHUNK) -> Column:
    """The UTF-8 text in chunked transfer framing."""
    framed = F.transform(_parts(text, size), lambda x: F.concat(F.lower(F.hex(F.octet_length(x))), F.lit(_END), x, F.lit(_END)))
    return F.concat(F.array_join(framed, ""), F.lit("0" + _END * 2))


def record_name(page_id: Column, number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), number.cast("string"), F.lit(">"))


def with_first(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, ``urn`` (name of its record) and, for revisits,
    ``first``: the page they repeat, and ``first_urn``.

    Payloads shared by a large share of the pages are few and joined by broadcast. A record
    is named by its page, so that every branch of the plan gives it the same name; where
    identifiers repeat, also by its place in a table that is written for that.
    """
    unique = pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    pages = pages.withColumn("number", F.lit(0).cast("long")) if unique else cut(pages.withColumn("number", F.monotonically_increasing_id()))
    known = pages.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long"), "_k": F.xxhash64("html")})
    wanted = (F.col("bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()
    firsts = known.filter(wanted).groupBy("digest").agg(F.min(F.struct("page_id", "number")).alias("_f"), F.first("_k").alias("_k"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = heavy_values(known.select("_k"), "_k")
    few = heavy_table(known.select("_k"), "_k", found).select("_k")
    out = (known.join(few, "_k", "left_anti") if found else known).join(firsts.drop("_k"), "digest", "left")
    if found:
        crowd = firsts.join(few, "_k", "left_semi").drop("_k")
        out = out.unionByName(known.join(few, "_k", "left_semi").join(F.broadcast(crowd), "digest", "left"))
    later = F.col("_f.page_id") != F.col("page_id")
    return out.select("page_id", "url", "html", "digest", record_name(F.col("page_id"), F.col("number")).alias("urn"), F.when(later, F.col("_f.page_id")).alias("first"), F.when(later, record_name(F.col("_f.page_id"), F.col("_f.number"))).alias("first_urn"))


def records(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The WARC records of ``pages`` (page_id, url, html, digest, urn, first, first_urn) as texts."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"), chunked(F.col("html")))
    revisit = F.col("first_urn").isNotNull()
    named = pages.select("page_id", "url", "digest", "first_urn", "urn", F.when(revisit, F.lit("")).otherwise(http).alias("block"))
    named = named.withColumn("parts", F.when(F.length("block") > segment, _parts(F.col("block"), segment)).otherwise(F.array("block")))
    each = named.select("page_id", "url", "digest", "first_urn", "urn", F.octet_length("block").alias("total"), F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part"))
    first, last, split = F.col("at") == 0, F.col("at") == F.col("n") - 1, F.col("n") > 1
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    own = F.when(first, F.col("urn")).otherwise(F.concat(F.lit("<urn:segment:"), F.substring("urn", 11, 1 << 20), F.lit("#"), (F.col("at") + 1).cast("string")))
    own = F.when(first, own).otherwise(F.concat(F.regexp_replace(own, ">#", "#"), F.lit(">")))
    none = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1" + _END),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", own),
        _line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")),
        F.when(first, _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))).otherwise(none),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", F.col("first_urn")))).otherwise(none),
        F.when(first & ~revisit, _line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(none),
        F.when(split, _line("WARC-Segment-Number", (F.col("at") + 1).cast("string"))).otherwise(none),
        F.when(~first, _line("WARC-Segment-Origin-ID", F.col("urn"))).otherwise(none),
        F.when(split & last, _line("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(none),
        _line("Content-Length", F.octet_length("part").cast("string")),
        F.lit(_END),
    )
    return each.select(F.concat(head, F.col("part")).alias("value"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, per_file: int = RECORDS) -> None:
    """The pages (page_id, url, html) as gzip-compressed WARC files in the folder ``path``.

    A null html counts as empty, a null url as an empty one. Pages with one payload
    of at least LEAST_REVISIT bytes: the smallest page_id holds it, others revisit it.
    """
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html").alias("html"))
    records(with_first(plain), segment).write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


_RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)


def _unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive in parts of a megabyte; they end where a damaged member does."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        while content and not member.eof:
            try:
                part = member.decompress(content, 1 << 20)
            except zlib.error:
                return
            content = member.unused_data if member.eof else member.unconsumed_tail
            yield part


class _Parts(io.RawIOBase):
    """A stream over an iterator of bytes."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held:
            part = next(self.parts, None)
            if part is None:
                return 0
            self.held = memoryview(part)
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def parse(content: bytes) -> Iterator[tuple]:
    """The records of one archive, read as a stream; gzip archives may have one member or many.

    A record that is cut off, or whose length cannot be read, is given without its
    block, and reading goes on at the next line that starts a record.
    """
    stream = io.BufferedReader(_Parts(_unpacked(content)), 1 << 20)
    line, take = stream.readline, stream.read

    now = line()
    while now:
        if not now.startswith(b"WARC/"):
            now = line()
            continue
        head, now = {}, line()
        while now.strip():
            name, _, value = now.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
            now = line()
        size = head.get("content-length", "")
        block = take(int(size)) if size.isdecimal() else b""
        whole = now != b"" and size.isdecimal() and len(block) == int(size)
        number, total = head.get("warc-segment-number", ""), head.get("warc-segment-total-length", "")
        kind, own = head.get("warc-type"), head.get("warc-record-id")
        origin = head.get("warc-segment-origin-id", own) if number else None
        yield own, kind, head.get("warc-payload-digest"), head.get("warc-refers-to"), origin, int(number) if number.isdecimal() else None, int(total) if total.isdecimal() else None, block if whole else None
        now = line()


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_RECORD.names)

    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            for row in parse(content.as_py()):
                rows.append(row)
                if len(rows) == 256:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def dechunk(block: bytes) -> bytes | None:
    """Payload of an HTTP response block; None if the framing is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    if not re.search(rb"(?im)^transfer-encoding:\s*chunked", head):
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(piece)
        at = end + 4 + size


_PAGE = "record_id string, record_type string, digest string, refers_to string, payload binary, payload_bytes long, payload_digest string, damaged boolean"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _PAGE.split(", ")]
    for batch in batches:
        payloads = []
        for kind, block in zip(batch.column(1).to_pylist(), batch.column(4), strict=True):
            data = block.as_py()
            payloads.append(None if kind == "revisit" or data is None else dechunk(data))
        sizes = [None if p is None else len(p) for p in payloads]
        sums = [None if p is None else hashlib.sha256(p).hexdigest() for p in payloads]
        bad = [k != "revisit" and (p is None or d not in (None, f"sha256:{s}")) for k, p, s, d in zip(batch.column(1).to_pylist(), payloads, sums, batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(bad, pa.bool_())], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of all archives in a folder, reassembled and decoded.

    Columns: record_id, record_type, digest (as in the header), refers_to, payload,
    payload_bytes, payload_digest, damaged. A record that is cut off, with a missing or
    repeated segment, a total length that does not match, broken framing or a wrong
    digest is damaged; with broken segments its payload is null. Segments whose first
    one is lost are one damaged response with their origin as record_id. A revisit has
    no payload of its own.
    """
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse_files, _RECORD)
    single = found.filter("origin is null and record_type in ('response', 'revisit')").select("record_id", "record_type", "digest", "refers_to", "block")
    pieces = found.filter("origin is not null")
    grouped = pieces.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max(F.when(F.col("number") == 1, F.col("record_type"))).alias("record_type"),
        F.max(F.when(F.col("number") == 1, F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("number") == 1, F.col("refers_to"))).alias("refers_to"),
    )
    ordered = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    joined = F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["block"]))
    grouped = grouped.withColumn("record_type", F.coalesce("record_type", F.lit("response"))).filter("record_type in ('response', 'revisit')")
    whole = grouped.select(F.col("origin").alias("record_id"), "record_type", "digest", "refers_to", F.when(ordered & (length == F.col("total")), joined).alias("block"))
    return single.unionByName(whole).mapInArrow(_decode, _PAGE)


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """The pages written to archives in ``path`` (a new shared folder), read back as one row each:
    page_id, payload_bytes, payload_digest, record_type, refers_to, damaged.

    A revisit gets size and digest from the response it refers to. Repeated rows of one
    page_id are written and read as rows; those with the smallest page_id of their
    payload are all responses. A null page_id is always a response. An empty table
    gives an empty result. Further columns of ``pages`` are not used.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write_archives(pages, path, **options)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")
    # Written once: the rows below are read by several branches, and none should parse the archives again.
    read = cut(read_archives(spark, path).withColumns({"page_id": page("record_id"), "first": page("refers_to")}).drop("payload"))
    stored = read.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "damaged")
    revisits = read.filter("record_type = 'revisit'").select("page_id", "record_type", F.col("first").alias("refers_to"), F.col("refers_to").alias("_named"))
    sources = read.filter("record_type = 'response'").select(F.col("record_id").alias("_named"), "payload_bytes", "payload_digest", "damaged")
    back = spread_join(revisits, sources, "_named", F.col("page_id"), "left")
    back = back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce("damaged", F.lit(True)).alias("damaged"))
    return stored.unionByName(back)
