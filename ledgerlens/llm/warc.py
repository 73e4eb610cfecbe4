"""WARC archives with a Zstandard dictionary of their own.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, trained on records of that
archive; each record follows as a frame of its own.  A payload that occurred before (equal, and of at least
``least`` bytes) is written as a revisit record that refers to the response with the smallest id.

Archives are rows of a table (archive, data) in the shared folder, so Spark's commit makes them whole or
absent when a task is lost, on any file system; ``export`` writes them out as .warc.zst files.  Digests are taken
by Spark, repeated payloads are found by one grouping over digests, and only ids are shuffled for that.

Defined cases: a null payload is empty; a null id is always a response; rows repeated with the same id and
payload are responses each; a null URL is written as an empty target; line ends in a URL are removed;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

LEAST = 100
ARCHIVE_BYTES = 8 << 20
#: Bytes of the dictionary, and how much of an archive's records it is trained on (every n-th record).
DICTIONARY, TRAINED_ON = 16 << 10, 512 << 10
MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the HTTP header only."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    target = (url or "").replace("\r", "").replace("\n", "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on every n-th record up to TRAINED_ON bytes; plain content where there is too little to train on."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINED_ON))
    samples = [r[: TRAINED_ON // 8] for r in records[::step]]
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The dictionary's frame and one frame for each record."""
    words = dictionary(records)
    raw = words.as_bytes() if words is not None else b""
    compressor = zstandard.ZstdCompressor(level=3, dict_data=words) if words is not None else zstandard.ZstdCompressor(level=3)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(compressor.compress, records)])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the archive has no dictionary frame")
    raw = data[8 : 8 + size]
    words = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    text = reader.stream_reader(memoryview(data)[8 + size :], read_across_frames=True).read()
    at = 0
    while at < len(text):
        end = text.index(b"\r\n\r\n", at)
        head = text[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, text[start:stop]
        at = stop + 4


def _write_batches(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:05d}"]), pa.array([archive(held)], pa.binary())], ["archive", "data"])
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5))):
                held.append(record(page_id.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers_to.as_py()))
                size += len(held[-1])
                if size >= limit:
                    yield full()
                    number, held, size = number + 1, [], 0
        if held:
            yield full()
    return run


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda text: int(text[10:-1]) if text and text[10:-1] else None
    for batch in batches:
        for data in batch.column("data"):
            rows = []
            for headers, block in records(data.as_py()):
                digest, length = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                kind = headers["WARC-Type"]
                if kind == "response":
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                rows.append((number(headers["WARC-Record-ID"]), length, digest, kind, number(headers.get("WARC-Refers-To")), headers["WARC-Target-URI"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def write(pages: DataFrame, *, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and returns their table (archive, data)."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"), F.sha2(body, 256).alias("digest"))
    digests = stage(named.select("page_id", "digest", F.length("body").alias("n")).where(F.col("n") >= least).select("page_id", "digest"), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    first = stage(first.select("digest", "refers_to"), "repeated")
    again = stage(digests.join(first, "digest").where("page_id > refers_to").select(
        F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to").distinct(), "revisits")
    joined = named.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    made = joined.select("page_id", "url", "body", "digest", "refers_to").mapInArrow(_write_batches(archive_bytes), "archive string, data binary")
    return stage(made, "archives")


def read(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record; payloads are checked against their digests."""
    return archives.select("data").mapInArrow(
        _read_batches, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as <folder>/<archive>.warc.zst on a file system that all executors reach; returns (archive, path, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Written under another name first, so a lost task leaves no half archive.
                path = f"{base}/{name}.warc.zst"
                with store.open_output_stream(path + ".part") as out:
                    out.write(data)
                store.move(path + ".part", path)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([len(data)])], ["archive", "path", "bytes"])

    return archives.select("archive", "data").mapInArrow(run, "archive string, path string, bytes long")


ORACLE = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select digest, min(page_id) as low from p where n >= 100 group by digest)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
  case when p.page_id > f.low then 'revisit' else 'response' end as record_type,
  case when p.page_id > f.low then f.low end as refers_to
from p left join f on p.digest = f.digest and p.n >= 100
"""
