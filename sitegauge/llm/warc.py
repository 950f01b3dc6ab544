"""WARC archives compressed record by record with Zstandard and a shared dictionary.

A file begins with a skippable frame that holds the dictionary, then comes one frame per record.
Each frame is closed by an empty skippable frame, which decoders pass over; it is the separator that
Spark's writer puts after each value. A record whose frame happens to hold those eight bytes is
stored with other settings. Reading loads the dictionary from the leading frame, finds each frame's
end by its block headers, decodes it alone and validates the record: version line, mandatory
headers, Content-Length against the block, record id, payload length and SHA-1 digest.

Records with equal payloads: the one of the smallest page_id is a ``response`` with the payload, the
others are ``revisit`` records that refer to it and carry only the digest and the length.

Cases: null html is the empty payload, null urls are left out; rows that repeat a page_id with the
same payload as its response are responses too; rows with a null page_id are responses if their
payload has no page_id, else revisits; an empty table makes no records. Other columns are ignored.
"""

from __future__ import annotations

import re
import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_blobs, scratch, stored, with_group, write_blobs

VERSION, DATE = b"WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC, SEPARATOR = 0x184D2A5D, "P*M\x18\0\0\0\0"
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 1 << 15


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


# ---------------------------------------------------------------- one file


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Payload-Length", str(len(payload)))]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    body = b"" if revisit else payload
    headers += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + body + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and block headers."""
    end = at + zstandard.frame_header_size(data[at : at + 18])
    checksum = data[at + 4] >> 2 & 1
    while True:
        if end + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = data[end] | data[end + 1] << 8 | data[end + 2] << 16
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    end += 4 * checksum
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of a file; the dictionary comes from its leading skippable frame."""
    data, at, reader = memoryview(content), 0, None
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(data[8 : 8 + size])
                if raw[:4] == b"\x28\xb5\x2f\xfd":
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        end = frame_end(data, at)
        reader = reader or zstandard.ZstdDecompressor()
        frame = data[at:end]
        known = zstandard.frame_content_size(frame[:18])
        yield reader.decompress(frame) if known >= 0 else reader.decompressobj().decompress(frame)
        at = end


_DIGEST = re.compile("sha1:[A-Z2-7]{32}")


def parse(raw: bytes) -> dict:
    """Headers, block and page ids of one record; whatever does not fit raises ValueError."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.decode().partition(":")
        if not colon or not key or key != key.strip() or key.lower() in headers:
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[key.lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in headers:
            raise ValueError(f"no {key}")
    if not headers["content-length"].isdecimal() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the block")
    body, digest, length = rest[:-4], headers.get("warc-payload-digest"), headers.get("warc-payload-length")
    if digest is not None and not _DIGEST.fullmatch(digest) or length is not None and not length.isdecimal():
        raise ValueError("a payload digest or length is not well formed")
    if headers["warc-type"] == "response" and (digest not in (None, f"sha1:{digest_of(body)}") or int(length or len(body)) != len(body)):
        raise ValueError("the payload does not fit its digest or length")
    if headers["warc-type"] == "revisit" and (body or digest is None or not headers.get("warc-refers-to", "").strip("<>")):
        raise ValueError("a revisit needs an empty block, a payload digest and what it refers to")
    return headers | {"body": body}


def _page(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdecimal() else None


# ---------------------------------------------------------------- Spark


def train_dictionary(pages: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the first bytes of a bounded sample: the ``sample`` pages of least id hash.

    The ids are chosen first, from their column alone; then only the chosen pages' bytes come to the driver.
    """
    ids = pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min(F.substring("html", 1, SAMPLE_BYTES)).alias("h")).filter("length(h) > 0")
    parts = [r.h.encode() for r in rows.orderBy("page_id").collect()]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes() if len(parts) > 15 else b"".join(parts)[:size]
    except zstandard.ZstdError:  # too little or too even material to train on: the samples themselves
        return b"".join(parts)[:size]


def _frames(batches: Iterator[pa.RecordBatch], dictionary: bytes, level: int) -> Iterator[pa.RecordBatch]:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    writers = [zstandard.ZstdCompressor(level=lv, dict_data=shared, write_checksum=True) for lv in (level, level + 2, 1)]
    cut, first = SEPARATOR.encode(), True
    for b in batches:
        out = [dictionary_frame(dictionary)] if first and dictionary else []
        first, size = False, 0
        for page_id, url, html, refers, revisit in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit"))):
            raw = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py(), revisit.as_py())
            made = next((f for w in writers if cut not in (f := w.compress(raw))), None)
            if made is None:
                raise ValueError("a record holds the separator however it is compressed")
            out.append(made)
            size += len(made)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages whose payload has a smaller page_id. Html is not shuffled."""
    narrow = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest")).distinct()
    least = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return with_group(narrow, least, "digest").filter("refers_to is not null and not page_id <=> refers_to").select("page_id", "digest", "refers_to")


def write_warc(pages: DataFrame, path: str, level: int = 6) -> None:
    """Write each row of ``pages(page_id, url, html)`` as a record, into a ``.warc.zst`` file per partition."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    dictionary = train_dictionary(pages)
    again = stored(revisits(pages), "revisits").withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    write_blobs(rows.mapInArrow(lambda it: _frames(it, dictionary, level), "frame binary"), path, SEPARATOR, ".warc.zst")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row per record of the archives below ``path``.

    ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` and, if asked for, the
    payload (null for revisits). Damaged frames and records raise.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([*fields, *([("payload", pa.binary())] if payload else [])])

    def rows(content: bytes) -> Iterator[list]:
        for raw in frames(content):
            r = parse(raw)
            row = [_page(r["warc-record-id"]), r.get("warc-target-uri"), int(r.get("warc-payload-length", len(r["body"]))), (r.get("warc-payload-digest") or "").removeprefix("sha1:") or None, r["warc-type"], _page(r.get("warc-refers-to"))]
            yield [*row, None if r["warc-type"] == "revisit" else r["body"]] if payload else row

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held, size = [], 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += row[2] if payload else 200
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    kinds = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    return read_blobs(spark, path, ".warc.zst").select("content").mapInArrow(read, kinds)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with the payloads of revisits filled in from the responses they refer to."""
    known = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload").alias("_payload")).dropDuplicates(["refers_to", "payload_digest"])
    return records.join(known, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("payload", "_payload")).select(records.columns)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives (below ``path`` or in scratch) and return their records without payloads, read back."""
    at = path or scratch(pages.sparkSession, "warc")
    write_warc(pages, at)
    return read_warc(pages.sparkSession, at, payload=False)
