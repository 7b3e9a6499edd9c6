"""WARC records in a content-addressed archive: payload bytes once by digest, exact headers beside them, joined to read.

An archive is a folder of two tables. ``payloads`` (digest: SHA-256 in hex, payload) has each different payload once, however
many records have it. ``heads`` (digest, inline, head, and the caller's columns) has all other bytes of every record as they
stood, so a record is its head, its payload if that stands in it (inline), and two line ends. A revisit record doesn't hold
its payload, but has its digest, so the payload is found for it as well.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's line ends, version, profile of a revisit by digest, and the digits of base 32.
END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEADS, PAYLOADS = "heads", "payloads"


def base32(digest: Column) -> Column:
    """A SHA-1 in hex as bare upper-case base 32: five bytes, ten hex digits, are eight digits."""
    part = lambda i: F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, nothing if there is no value. Control characters, which would end the line, are escaped as in urls."""
    for c in ("\r", "\n", "\0"):
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(rows: DataFrame, *, key: str = "page_id", uri: str = "url", payload: str = "payload", date: str = "1970-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """A record for each of ``rows``: (``key``, digest, inline, head), without payloads.

    Of rows with equal payloads of ``least`` bytes or more, the one with the smallest key is a response (a null key comes last;
    of equal keys the smallest uri), and the others revisit it; rows with smaller payloads are all responses. A null payload is
    empty. Rows that repeat have a record each, of which one at most is a response where there are revisits; their ids are
    told apart by a number. Equal digests whose payloads differ in length or SHA-1 raise. Other columns are ignored.

    Payload bytes are read where they are scanned and not moved; what is shuffled is a row for each record.
    """
    rows = rows.select(F.col(key).alias("_key"), F.col(uri).alias("_uri"), F.coalesce(payload, F.lit(b"")).alias("_payload"))
    facts = rows.select("_key", "_uri", F.sha2("_payload", 256).alias("digest"), F.sha1("_payload").alias("_sha1"), F.octet_length("_payload").cast("bigint").alias("_size"))
    same = facts.groupBy("_key", "_uri", "digest", "_sha1", "_size").agg(F.count("*").alias("_n"))
    order = F.struct(F.isnull("_key").alias("_no"), "_key", "_uri")
    seen = F.struct("_size", "_sha1")
    least_of = same.groupBy("digest").agg(F.min(order).alias("_first"), F.min(seen).alias("_low"), F.max(seen).alias("_high"))
    each = same.join(least_of, "digest").select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_copy"))
    name = lambda k, copy: F.concat(F.lit("<urn:record:"), F.coalesce(k.cast("string"), F.lit("null")), F.when(copy > 1, F.concat(F.lit("."), copy.cast("string"))).otherwise(""), F.lit(">"))
    first = order.eqNullSafe(F.col("_first")) & (F.col("_copy") == 1)
    inline = first | (F.col("_size") < least)
    inline = F.when(F.col("_low") != F.col("_high"), F.raise_error(F.concat(F.lit("Different payloads of digest "), F.col("digest"))).cast("boolean")).otherwise(inline)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_size").cast("string"), F.lit(END))
    length = F.octet_length("_http") + F.when(F.col("inline"), F.col("_size")).otherwise(0)
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(F.col("inline"), "response").otherwise("revisit")), _line("WARC-Record-ID", name(F.col("_key"), F.col("_copy"))), _line("WARC-Target-URI", F.col("_uri")),
        F.lit(f"WARC-Date: {date}\r\n"), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("_sha1")))),
        F.when(F.col("inline"), F.lit("")).otherwise(F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), _line("WARC-Refers-To", name(F.col("_first._key"), F.lit(1))), _line("WARC-Refers-To-Target-URI", F.col("_first._uri")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), F.concat(F.lit("Content-Length: "), length.cast("string"), F.lit(END)), F.col("_http"),
    )
    return each.withColumns({"inline": inline, "_http": http}).select(F.col("_key").alias(key), "digest", "inline", head.cast("binary").alias("head"))


def store(heads: DataFrame, payloads: DataFrame, folder: str) -> None:
    """Write an archive: ``heads`` (digest, inline, head, …) as they are, of ``payloads`` (payload) each once; null is empty.

    A payload is moved at most once for each task that holds it. Two payloads of one digest but of other length or SHA-1 raise.
    """
    given = payloads.select(F.coalesce("payload", F.lit(b"")).alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload", F.struct(F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1")).alias("seen"))
    once = given.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("seen").alias("low"), F.max("seen").alias("high"))
    checked = F.when(F.col("low") == F.col("high"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("Different payloads of digest "), F.col("digest"))).cast("string"))
    once.select(checked.alias("digest"), "payload").write.parquet(f"{folder}/{PAYLOADS}")
    heads.write.parquet(f"{folder}/{HEADS}")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive with their payloads: digest, inline, head, the other columns, payload.

    Each payload is hashed again where it is read; one that isn't what its digest says raises, and so does a record whose
    payload isn't there. A digest that very many records have is split by adaptive joins.
    """
    heads, payloads = (spark.read.parquet(f"{folder}/{name}") for name in (HEADS, PAYLOADS))
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("Not the payload of digest "), F.col("digest"))).cast("binary"))
    rows = heads.join(payloads.select("digest", checked.alias("payload")), "digest", "left")
    found = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("No payload of digest "), F.col("digest"))).cast("binary"))
    return rows.withColumn("payload", found)


def record_bytes() -> Column:
    """A record of ``restore`` as it stands in a file, without its two line ends."""
    return F.when(F.col("inline"), F.concat("head", "payload")).otherwise(F.col("head"))


def field(name: str) -> Column:
    """A header field of ``head``, null if it isn't there. Names have no case; only the record's own lines count."""
    own = F.substring_index(F.decode("head", "UTF-8"), END, 1)
    pattern = f"(?i)\r\n{re.escape(name)}:[ \t]*([^\r\n]*)"
    return F.when(own.rlike(pattern), F.regexp_extract(own, pattern, 1))


def write_files(restored: DataFrame, folder: str) -> None:
    """WARC files of the records of ``restore``, one for each partition, in the partition's order, not compressed."""
    restored.select(record_bytes().cast("string").alias("value")).write.option("lineSep", END).text(folder)


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Heads and payloads of a WARC file, plain or gzip; a record that is cut short or has no length raises ValueError.

    The head takes the HTTP header as well, so that the payload is the body; other blocks are payloads as a whole.
    """
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            if not member.eof:
                raise ValueError("a gzip member is cut short")
            data = member.unused_data
        data = b"".join(parts)
    at, end = 0, END.encode()
    while at < len(data):
        body = data.find(end, at) + len(end)
        lines = data[at:body]
        size = re.search(rb"(?i)\r\nContent-Length:[ \t]*([0-9]+)[ \t]*\r\n", lines)
        if not lines.startswith(b"WARC/") or not size:
            raise ValueError(f"no record at byte {at}")
        stop = body + int(size[1])
        if data[stop : stop + len(end)] != end:
            raise ValueError(f"the record at byte {at} is cut short")
        start = body
        if re.search(rb"(?i)\r\nContent-Type:[ \t]*application/http", lines) and (blank := data.find(end, body, stop)) >= 0:
            start = blank + len(end)
        yield data[at:start], data[start:stop]
        at = stop + len(end)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, head, payload of the records of WARC files, in any file system that Spark reads. A file must fit a task.

    ``seq`` numbers a file's records from 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                rows = [(name, i, head, payload) for i, (head, payload) in enumerate(split_records(content.as_py()))]
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pydict(dict(zip(("file", "seq", "head", "payload"), map(list, zip(*rows[lo : lo + 256], strict=True)), strict=True)))

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    return files.mapInArrow(work, "file STRING, seq BIGINT, head BINARY, payload BINARY")


def archive_files(spark: SparkSession, path: str, folder: str) -> None:
    """WARC files as an archive in ``folder``: file and seq stay beside each head, so that files can be written again in order."""
    given = read_files(spark, path)
    store(given.select(F.sha2("payload", 256).alias("digest"), F.lit(True).alias("inline"), "head", "file", "seq"), given, folder)


def digests(restored: DataFrame, key: str = "page_id") -> DataFrame:
    """What the records of ``restore`` say, and the length and SHA-1 of their payloads, which must be what they say.

    ``key``, payload_bytes, payload_digest, record_type, refers_to (the key of the record that a revisit refers to).
    """
    sha1 = base32(F.sha1("payload"))
    said = F.when(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), sha1), sha1).otherwise(F.raise_error("A record's payload isn't of its digest").cast("string"))
    named = lambda name: F.regexp_extract(field(name), r"^<urn:record:(-?[0-9]+)(\.[0-9]+)?>$", 1).try_cast("bigint")
    return restored.select(named("WARC-Record-ID").alias(key), F.octet_length("payload").cast("bigint").alias("payload_bytes"), said.alias("payload_digest"), field("WARC-Type").alias("record_type"), named("WARC-Refers-To").alias("refers_to"))
