"""WARC archives with Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: of records with equal payloads of at least ``LEAST`` bytes, the one with the largest page_id is a response and
the others are revisits that refer to it; smaller payloads are always responses. The archives are binary rows of a
Parquet table in the shared folder, so any store that Spark writes to will do, and lost tasks are written anew.
Each archive trains its dictionary on a bounded part of its own records (``SAMPLE`` bytes).
Reading: the skippable frame gives the dictionary; each further frame is decoded on its own and must hold exactly one
record whose version line, required headers, block length, HTTP length and payload digest are checked. Anything
else raises ``ValueError``.

Cases: a null html counts as empty; a null page_id is kept as null and never is the largest; rows that repeat the
largest page_id with that payload are all responses; if all ids of a group are null, all are responses; an empty table
gives no rows; a url may be null or hold line breaks (percent-encoded); further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

LEAST, ARCHIVE, SAMPLE, LEVEL, DICTIONARY = 1000, 8 << 20, 1 << 20, 3, 32 << 10
#: The skippable frame's magic number, the version line and the names of the headers.
MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest")


def record(page: str, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    lines = [VERSION, b"WARC-Type: " + (b"revisit" if refers else b"response"), f"WARC-Record-ID: <urn:page:{page}>".encode(),
             b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Target-URI: " + quote(url or "", safe=":/?#[]@!$&'()*+,;=%~").encode(),
             b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response",
             b"Content-Length: %d" % len(block)]
    if refers:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>".encode(), b"WARC-Profile: " + PROFILE.encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    some, size = [], 0
    for r in records:
        if size >= SAMPLE:
            break
        some.append(r[: SAMPLE // 8])
        size += len(some[-1])
    try:
        return zstandard.train_dictionary(DICTIONARY, some, k=512, d=8)
    except zstandard.ZstdError:  # too few or too equal records to train on
        return zstandard.ZstdCompressionDict(some[0][:DICTIONARY], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes]) -> bytes:
    words = dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
    raw = words.as_bytes()
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(packer.compress, records)])


def frames(archive: bytes) -> Iterator[bytes]:
    """The content of each frame after the leading skippable one."""
    view = memoryview(archive)
    if len(view) < 8 or struct.unpack_from("<I", view)[0] != MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = struct.unpack_from("<I", view, 4)[0]
    if len(view) < 8 + size:
        raise ValueError("the dictionary frame is cut off")
    words = bytes(view[8: 8 + size])
    if words[:4] == zstandard.FRAME_HEADER:  # the dictionary may be a frame itself
        words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    at = 8 + size
    while at < len(view):
        one, out, step = reader.decompressobj(), [], 1 << 14
        try:
            while not one.eof:
                if at >= len(view):
                    raise ValueError("the last frame is cut off")
                out.append(one.decompress(view[at: at + step]))
                at += min(step, len(view) - at)
                step *= 2
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame cannot be decoded: {e}") from None
        at -= len(one.unused_data)
        yield b"".join(out)


def headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or name.strip() != name:
            raise ValueError(f"not a header: {line[:80]!r}")
        out[name.decode("ascii").lower()] = value.strip().decode("utf-8")
    return out


def parse(content: bytes) -> tuple[str, int, str, str, str | None]:
    """(page, payload length, payload digest, type, page referred to) of one record, everything checked."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first != VERSION:
        raise ValueError(f"not a record of {VERSION.decode()}: {first[:40]!r}")
    h = headers(lines)
    if missing := [k for k in REQUIRED if k not in h]:
        raise ValueError(f"headers are missing: {missing}")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {size} bytes is announced, {len(rest) - 4} are there")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1."):
        raise ValueError("the block has no HTTP header")
    length = int(headers(http.split(b"\r\n")[1:])["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    page = h["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    if h["warc-type"] == "response":
        if length != len(payload) or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of page {page} does not match its length or digest")
        return page, length, digest, "response", None
    if h["warc-type"] != "revisit" or "warc-refers-to" not in h or payload:
        raise ValueError(f"page {page} is neither a response nor a revisit")
    return page, length, digest, "revisit", h["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The archives (one binary row each), read from the table that they were written to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    repeated = rows.where(large).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("newest"))
    repeated = cut(repeated.where("n > 1").select(F.col("digest").alias("key"), "newest"))
    # small payloads get keys of their own, so that no two of them meet
    rows = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "digest").cast("string"))))
    rows = rows.join(repeated, "key", "left").drop("key")

    def pack(batches):
        held, size = [], 0
        for pdf in batches:
            for page, url, payload, digest, newest in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["newest"]):
                name = "null" if page is None or pd.isna(page) else str(int(page))
                target = None if newest is None or pd.isna(newest) else str(int(newest))
                held.append(record(name, url, bytes(payload), digest, target if target != name else None))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield pd.DataFrame({"archive": [write_archive(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"archive": [write_archive(held)]})

    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("newest").cast("string").alias("newest"))
    return stored(rows.mapInPandas(pack, "archive binary"), "warc")


def read(archives: DataFrame, column: str = "archive") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in every archive."""

    def unpack(batches):
        for pdf in batches:
            for archive in pdf[column]:
                got = [parse(c) for c in frames(bytes(archive))]
                yield pd.DataFrame(got, columns=["page", "payload_bytes", "payload_digest", "record_type", "refers"])

    out = archives.select(column).mapInPandas(unpack, "page string, payload_bytes long, payload_digest string, record_type string, refers string")
    return out.select(F.expr("try_cast(page AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      F.expr("try_cast(refers AS bigint)").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    return read(write(pages))


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM q
"""
