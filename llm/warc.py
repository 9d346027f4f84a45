"""WARC: an archive writer and a sequential reader.

One gzip member per record.  The reader inflates a file member by member with an
incremental decompressor, frames each record by its Content-Length and verifies the
block and payload digests (SHA-1, base32).  Records of equal payloads are written once:
the one with the largest key is the response, the others are revisits that refer to it.

Files are written by Spark's text writer, so its committers leave no half files: a
row is a member without its last byte, and the line separator is that byte.  A
member ends with the high byte of its size, which is 0 below 16 MiB; a larger
record is followed by an empty member, which ends with 0.

Defined cases: a null html is an empty payload (and equals other empty ones); a
null page_id is written with a record id that says so and is read back as null; rows
that repeat a page_id are written each, by their own payloads; extra columns are ignored; an empty table
gives files without records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, joined, scratch

#: Bytes of payload per file; payloads of at least DEDUP_FROM bytes are held against each other.
FILE_BYTES, DEDUP_FROM = 16 << 20, 0
#: Bytes handed to the decompressor at a time.
CHUNK = 64 << 10

_URN = "<urn:uuid:{}>"
# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def sha1(data: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None) -> str:
    """A record id that the key can be read from."""
    number = (1 << 64 if key is None else 0) | (key or 0) & (1 << 64) - 1
    return _URN.format(uuid.UUID(int=number))


def record_key(rid: str) -> int | None:
    number = uuid.UUID(rid.strip("<>").removeprefix("urn:uuid:")).int
    low = number & (1 << 64) - 1
    return None if number >> 64 else low - (1 << 64 if low >> 63 else 0)


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member: a response, or a revisit if `refers_to` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or ""),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()
    return member if member[-1] == 0 else member + _EMPTY


def members(data: bytes) -> Iterator[bytearray]:
    """The inflated gzip members of a file, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), bytearray()
        while not z.eof:
            if at >= len(view):
                raise ValueError("the last member is cut off")
            piece = view[at : at + CHUNK]
            out += z.decompress(piece)
            at += len(piece) - len(z.unused_data)
        if out:
            yield out


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def parse(member: bytes | bytearray) -> dict:
    """Headers, HTTP fields and payload of a record; raises if framing or digests are wrong.  Of the member only the payload is copied."""
    gap = member.find(b"\r\n\r\n")
    version, fields = _fields(bytes(member[: max(gap, 0)]))
    if gap < 0 or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    begin, view = gap + 4, memoryview(member)
    end = begin + int(fields["content-length"])
    if end < begin or view[end:] != b"\r\n\r\n":
        raise ValueError("the content length is wrong")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1(view[begin:end])}":
        raise ValueError("the block digest is wrong")
    http = {}
    if fields.get("content-type", "").startswith("application/http"):
        gap = member.find(b"\r\n\r\n", begin, end)
        if gap < 0:
            raise ValueError("the HTTP header has no end")
        http, begin = _fields(bytes(view[begin:gap]))[1], gap + 4
        if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{sha1(view[begin:end])}":
            raise ValueError("the payload digest is wrong")
    return {"type": fields.get("warc-type"), "fields": fields, "http": http, "payload": bytes(view[begin:end])}


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_from: int = DEDUP_FROM) -> None:
    """Write archives to `path`."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    size, bare = rows.agg(F.coalesce(F.sum(F.col("size") + 500), F.lit(0)), F.count(F.when(F.col("id").isNull(), 1))).first()
    # keys of the groups only: one row a digest after partial aggregation
    last = rows.where(F.col("size") >= dedup_from).groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    known = joined(rows.where("id is not null").select("id", "digest"), last, ["digest"]).where("id <> last").distinct()
    # payloads are shuffled once, as the files need them
    files = max(1, -(-size // FILE_BYTES))
    named = rows.where("id is not null") if bare else rows
    whole = named.repartition(files, "id", "digest").join(known.repartition(files, "id", "digest"), ["id", "digest"], "left")
    if bare:  # rows without an id refer to the largest id of their payload, and are spread by their place
        other = joined(rows.where("id is null").select("digest").distinct(), last, ["digest"]).where("last is not null")
        spread = rows.where("id is null").withColumn("at", F.monotonically_increasing_id())
        whole = whole.union(joined(spread, other, ["digest"], "left").repartition(files, "at").select(*whole.columns))

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for key, url, html, last in zip(*(batch.column(c) for c in ("id", "url", "html", "last"))):
            payload = html.as_py().encode()
            out.append(record(key.as_py(), url.as_py(), payload, sha1(payload), last.as_py())[:-1])
        return {"member": pa.array(out, pa.binary())}

    members_ = arrow_map(whole, run, "member binary")
    members_.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, url, refers_to, payload_digest, payload_bytes, payload) of every record below `path`; payload is null for revisits."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for r in map(parse, members(content.as_buffer())):
                    f, full = r["fields"], r["type"] != "revisit"
                    size = len(r["payload"]) if full else int(r["http"]["content-length"])
                    rows.append((r["type"], record_key(f["warc-record-id"]), f.get("warc-target-uri"), record_key(f["warc-refers-to"]) if "warc-refers-to" in f else None, f.get("warc-payload-digest", "").removeprefix("sha1:"), size, r["payload"] if full else None))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, "type string, id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"type": pa.string(), "id": pa.int64(), "url": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


def archive(pages: DataFrame) -> DataFrame:
    """Write `pages` to the shared folder, read them back: one row per page."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path)
    back = read(spark, path)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
