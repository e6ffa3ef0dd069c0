"""WARC archives: a writer with revisit records and a splittable reader.

Archives are runs of gzip members, one record each. Spark's own text writer
commits the files: a row is a chunk of whole members as raw bytes, and the line
separator is an empty gzip member, which readers pass over.

The reader cuts files into byte ranges. A task looks for gzip magic in its range,
takes a place as a member if its gzip header and the record header behind it can
be decoded, and owns the records that start inside the range; the last of them may
be read beyond its end. No index and no order of the ranges is needed. Records of
any version 1 are read; a file that does not begin with a gzip member of such a
record (or an empty member) is no archive and ends the query.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.session import run_dir, ship_package

CHUNK = 4 << 20             # compressed bytes a row of the writer holds, about
RANGE = 8 << 20             # bytes of a file that a reading task scans
STEP = 1 << 16              # bytes read at once
HEADER = 1 << 20            # bytes that a member's gzip header (file name, comment) may take
# The gzip member header (deflate, flags), the record format, and
# the profile of a revisit by payload digest.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
ANY_VERSION = b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; ``refers_to`` makes it a revisit without its payload. The ids
    and the full payload's length travel in extension fields."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest(payload)}")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response",
            f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page: {refers_to}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> dict:
    """A record's fields (names in lower case) and its 'payload'."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields, name = {}, None
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:        # a folded line goes on with the value above
            fields[name] += " " + line.strip()
        elif ":" in line:                           # a line that names no field is passed over
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    block = rest[:int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("cut record")
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def _writer(batches):
    import pyarrow as pa

    parts, size = [], 0
    for b in batches:
        for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns)):
            parts.append(member(encode_record(page_id, url, payload or b"", refers_to)))
            size += len(parts[-1])
            if size >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)])], ["chunk"])
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)])], ["chunk"])


def write_warc(pages: DataFrame, path: str | None = None, min_bytes: int = 0, id_col: str = "page_id",
               url_col: str = "url", payload_col: str = "html") -> str:
    """Write a record for each row of ``pages`` and return the folder. Of records
    whose payloads are equal and have at least ``min_bytes``, that of the largest
    id is the response and the others revisit it; all smaller ones are responses.

    A NULL payload is empty. A NULL id loses against any other; equal payloads of
    NULL ids alone are all responses, as are all rows that share the largest id.
    An empty table gives a folder without records. Other columns are not written.
    """
    spark = pages.sparkSession
    ship_package(spark)
    path = path or run_dir(spark, "warc")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    key = F.struct(F.sha2("payload", 256).alias("h"), F.length("payload").alias("n"))
    groups = (rows.where(F.length("payload") >= min_bytes).select("id", key.alias("key")).groupBy("key")
              .agg(F.max("id").alias("to"), F.count("*").alias("rows"))
              .where("rows > 1 AND to IS NOT NULL").select("key", "to"))
    # equal payloads of a third of all rows: the join's skewed partitions are split
    told = rows.withColumn("key", key).join(groups, "key", "left")
    refers_to = F.when(F.col("id").eqNullSafe(F.col("to")), F.lit(None)).otherwise(F.col("to"))
    chunks = told.select("id", "url", "payload", refers_to.alias("refers_to")).mapInArrow(_writer, "chunk binary")
    (chunks.select(F.col("chunk").cast("string").alias("value")).write
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path))
    return path


def record_at(data: bytes) -> bool | None:
    """Whether a gzip member with a record header starts here: the gzip header is
    read, and the first bytes are decompressed. None: that takes more bytes."""
    inflate = zlib.decompressobj(31)
    try:
        head = inflate.decompress(data, len(ANY_VERSION))
    except zlib.error:
        return False
    if len(head) < len(ANY_VERSION) and not inflate.eof:
        return None
    return head == ANY_VERSION


def read_range(source, start: int, end: int, size: int):
    """Records, as bytes, of the members that start in [start, end) of an open
    file of ``size`` bytes. Memory: one record and a step of compressed bytes."""
    source.seek(start)
    data, at = source.read(min(STEP, size - start)), start      # data begins at byte ``at``

    def more() -> bytes:
        return source.read(STEP)

    while at < end:
        i = data.find(MAGIC)
        if at == 0 and i != 0:
            raise ValueError("the file does not begin with a gzip member")
        if i < 0:
            keep = len(MAGIC) - 1
            at += max(0, len(data) - keep)
            data = data[-keep:] if len(data) > keep else data
            new = more()
            if not new:
                return
            data += new
            continue
        data, at = data[i:], at + i
        if at >= end:
            return
        found = record_at(data[:1024])      # most headers, and what it takes to decode the version
        if found is None:
            found = record_at(data)
        while found is None and len(data) < HEADER and (new := more()):
            data += new
            found = record_at(data)
        if not found:
            if at == 0 and not data.startswith(EMPTY_MEMBER):
                raise ValueError("the file begins with a member that holds no record")
            data, at = data[1:], at + 1
            continue
        inflate, out, used = zlib.decompressobj(31), [], 0
        try:
            while True:
                out.append(inflate.decompress(data))
                used += len(data) - len(inflate.unused_data)
                if inflate.eof:
                    data, at = inflate.unused_data, at + used
                    yield b"".join(out)
                    break
                data = more()
                if not data:
                    raise ValueError(f"cut member at byte {at}")
        except zlib.error as e:
            raise ValueError(f"damaged member at byte {at}: {e}") from e


def _reader(batches):
    """Rows (path, size, start, end) to the records that start there."""
    import pyarrow as pa
    from pyarrow import fs

    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names)

    for b in batches:
        for path, size, start, end in zip(*(c.to_pylist() for c in b.columns)):
            files, name = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with files.open_input_file(name) as source:
                for data in read_range(source, start, end, size):
                    f = decode_record(data)
                    number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), f.get("warc-target-uri"), f["warc-type"],
                                 f.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-payload-length"),
                                 number("x-refers-to-page"), f["payload"]))
                    held += len(f["payload"])
                    if held >= CHUNK:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """All records of the archives in a folder: page_id, url (as in the record),
    record_type, payload_digest, payload_bytes (of the full payload), refers_to
    and payload (empty for a revisit). Files are listed by Spark and read by
    ranges through pyarrow's file systems, which must know the path's scheme.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    start = F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)"))
    ranges = files.where("length > 0").select("path", F.col("length").alias("size"), start.alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, F.col("size")))
    total = files.agg(F.sum("length")).first()[0] or 0
    return ranges.repartition(max(1, -(-total // range_bytes))).mapInArrow(
        _reader, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
                 "refers_to long, payload binary")
