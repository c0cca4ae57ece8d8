"""WARC archives with dictionary-compressed records (.warc.zst), written and read by Spark.

A first pass trains a Zstandard dictionary on ``sample_records`` records of the whole table, those
with the smallest hashes of id and payload, at most ``sample_bytes`` of each. Each task then writes one
archive: a leading skippable frame holds the dictionary, and every record is a frame of its own,
compressed with it. Files go through Spark's text writer, so they land on any file
system Spark writes to and only committed tasks leave files. Its line separator is an empty
skippable frame, which readers pass over.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a
response and the others are revisits of it, without payload; rows with that same id and payload
are all responses, and so are rows with a null id. A null payload is empty.

A record's identifier is its page's id and payload digest, which revisits refer to. Rows with a null
id and rows that repeat both have the task and place in it as well, so every identifier is unique.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, scratch

# fixed values of the format
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def _uri(url: str | None) -> str:
    """The url as it stands, but for characters that a header can't hold, which are percent-encoded."""
    return urllib.parse.quote(url or "", safe="!#$&'()*+,/:;=?@[]%~-._")


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{place and ':'}{place}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, place: str = "") -> bytes:
    """One WARC record with its two closing line breaks. ``place`` tells records of one page and payload apart."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Record-ID: {record_id(page_id, digest, place)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int):
    """A trained dictionary; where there is too little to train on, the samples' first bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(id, sha1, refers_to, again) of the rows whose payload an earlier id has (refers_to) or that
    come again with the same id and payload (again)."""
    named = pages.where(F.col("id").isNotNull()).select(
        "id", "sha1", F.sha2(F.col("payload").cast("binary"), 256).alias("sha256"), (F.octet_length("payload") >= min_bytes).alias("large")
    )
    own = named.groupBy("sha1", "sha256", "large", "id").agg((F.count("*") > 1).alias("again"))
    first = own.groupBy("sha1", "sha256").agg(F.min("id").alias("first"), (F.count("*") > 1).alias("shared"), F.max("again").alias("some"))
    found = own.join(first.where("shared OR some"), ["sha1", "sha256"])
    refers_to = F.when(F.col("large") & (F.col("id") != F.col("first")), F.col("first"))
    return found.groupBy("id", "sha1").agg(F.max(refers_to).alias("refers_to"), F.max("again").alias("again"))


def trained(rows: DataFrame, size: int, sample_records: int, sample_bytes: int, date: str):
    """A dictionary from a bounded sample of all records, chosen by hash; at most ``sample_records`` rows come to the driver."""
    hashed = rows.withColumn("h", F.xxhash64("id", "sha1"))
    # first the bound, by hashes alone, so that no task sends payloads that aren't chosen
    bound = hashed.select("h").distinct().orderBy("h").limit(sample_records).agg(F.max("h")).first()[0]
    part = F.substring(F.col("payload").cast("binary"), 1, sample_bytes)
    chosen = hashed.where(F.col("h") <= F.lit(bound)).groupBy("h").agg(F.min(F.struct("id", "url", "sha1", part.alias("part"))).alias("r"))
    sample = sorted(chosen.collect(), key=lambda x: x.h)
    return dictionary([record(x.r.id, x.r.url, bytes(x.r.part), _base32(x.r.sha1), None, date) for x in sample], size)


def write(
    spark: SparkSession, pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 0, dictionary_bytes: int = 32 << 10, sample_records: int = 512,
    sample_bytes: int = 8 << 10, level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write all pages as archives into the folder ``path``."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1")
    )
    told = rows.join(revisits(rows, min_bytes), ["id", "sha1"], "left").select("id", "url", "payload", "sha1", "refers_to", "again")
    words = trained(rows, dictionary_bytes, sample_records, sample_bytes, date).as_bytes()

    def frames(batches):
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words))
        head, n = [struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words], 0
        for batch in batches:
            parts = head
            for i, u, p, d, r, again in zip(
                batch.column("id").to_pylist(), batch.column("url").to_pylist(), bytes_of(batch, "payload"),
                batch.column("sha1").to_pylist(), batch.column("refers_to").to_pylist(), batch.column("again").to_pylist(),
            ):
                place = f"{TaskContext.get().partitionId()}-{n}" if i is None or again else ""
                parts.append(press.compress(record(i, u, p, _base32(d), r, date, place)))
                n += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(parts, type=pa.binary())], names=["value"])
                head = []

    lines = told.mapInArrow(frames, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_FRAME).text(path)


def records(archive: bytes):
    """(headers, block) of each record of one archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    words = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    raw = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(archive), read_across_frames=True)
    stream = io.BufferedReader(raw, 1 << 20)
    while first := stream.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError("no WARC record where one should begin")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it says")
        yield headers, block


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").split(":")[0] if urn else ""
    return int(number) if number else None


def read(spark: SparkSession, path: str, id_col: str = "page_id") -> DataFrame:
    """One row per record: id, url, payload_bytes, payload_digest, record_type, refers_to, payload
    (null for revisits). Digests of responses are checked."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = T.StructType(
        [
            T.StructField(id_col, T.LongType()),
            T.StructField("url", T.StringType()),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_digest", T.StringType()),
            T.StructField("record_type", T.StringType()),
            T.StructField("refers_to", T.LongType()),
            T.StructField("payload", T.StringType()),
        ]
    )
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def parse(batches):
        for batch in batches:
            for archive in bytes_of(batch, "content"):
                rows, size = [], 0
                for headers, block in records(archive):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    length = int(head.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (
                        len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
                    ):
                        raise ValueError(f"payload of {headers.get('warc-record-id')} is damaged")
                    text = payload.decode() if kind == "response" else None
                    url = headers["warc-target-uri"]
                    rows.append((_page(headers.get("warc-record-id")), url, length, digest, kind, _page(headers.get("warc-refers-to")), text))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=schema.names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=schema.names)

    return archives.mapInArrow(parse, schema)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives in the shared folder, and read them back."""
    path = scratch(spark, "warc")
    write(spark, pages, path, **options)
    return read(spark, path).drop("payload")
