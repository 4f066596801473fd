"""Operator 10, WARC archives of individually compressed records with an embedded Zstandard dictionary.

A dictionary is trained on the records of a bounded sample (SAMPLE_PAGES distinct pages of the smallest hashes, SAMPLE_BYTES
of each payload) and put into the leading skippable frame of every archive; each record is one frame. Of equal payloads of
at least MIN_REVISIT bytes the smallest page_id is a response and the others are revisits; pages of a payload that very many
have are dealt out evenly. Archives are rows (archive, content) of a Parquet table, which any shared store holds and Spark commits atomically; export()
writes them as .warc.zst files.

Defined results: null html is an empty payload; null url leaves the target header out; repeated rows of the smallest
page_id are all responses; pages with a null page_id are revisits of any other equal page, and responses where no equal page
has an id; a payload of any length is one record; an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.common import joined_to_unique, materialize, sliced, table

SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16_384, 32_768
MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
LEVEL = 3
SKIPPABLE = 0x184D2A5D  # fixed value: the frame that holds a dictionary
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, payload binary, refers_to long"


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples, or their own bytes where they are too few to train on; b"" without any."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 8 else b"".join(samples)[:DICTIONARY_BYTES]
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if len(raw) >= 8 else {}


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; the block is an HTTP response, without its body in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frames(content: bytes) -> Iterator[bytes]:
    """Decompressed records of an archive, with the dictionary of its own leading frame."""
    view, at, options = memoryview(content), 0, {}
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if len(view) - at >= 8 else (0, 0)
        if magic == SKIPPABLE:
            options, at = _dictionary(bytes(view[at + 8 : at + 8 + size])), at + 8 + size
            continue
        d, parts = zstandard.ZstdDecompressor(**options).decompressobj(), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a record")
            fed = view[at : at + 65_536]
            parts.append(d.decompress(fed))
            at += len(fed) - (len(d.unused_data) if d.eof else 0)
        yield b"".join(parts)


def parse(rec: bytes) -> dict:
    """Fields of a record. The payload's size and digest are taken from the body itself in a response."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    kind, number = fields["WARC-Type"], lambda k: int(fields[k]) if fields.get(k, "None") != "None" else None
    out = {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": None}
    if kind == "response":
        digest = hashlib.sha256(body).hexdigest()
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"digest of page {out['page_id']} does not match")
        return out | {"payload_bytes": len(body), "payload_digest": digest, "payload": body}
    n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return out | {"payload_bytes": n, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": None, "refers_to": number("X-Refers-To-Page")}


def write_archives(pages: DataFrame, date: str = "2026-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A stable table (archive, content) of the pages' records. pages: page_id, url, html."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    n_pages = pages.count()
    head = pages.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("head"))
    drawn = F.xxhash64("page_id", "url", "head").bitwiseAND(F.lit((1 << 30) - 1))  # of all there is, so that no id is drawn whole
    share = int(min(1.0, 1.5 * SAMPLE_PAGES / max(1, n_pages)) * (1 << 30))
    sampled = head.filter(drawn < share).distinct().orderBy(drawn, "page_id", "url", "head").limit(SAMPLE_PAGES).collect()
    samples = [(bytes(r["head"]), r["page_id"], r["url"]) for r in sampled]
    raw = train([record(i, u, x, hashlib.sha256(x).hexdigest(), len(x), False, None, date) for x, i, u in samples])
    pages = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.length("payload"))
    first = F.when(F.first("n_bytes") >= MIN_REVISIT, F.min("page_id"))
    same = pages.groupBy("digest").agg(first.alias("first_id"), F.count("*").alias("_n")).filter("_n > 1")
    rows = joined_to_unique(pages, same, "digest", n_pages, ["page_id", "url"]).select("page_id", "url", "payload", "digest", "n_bytes", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_dictionary(raw)).compress
        start = struct.pack("<II", SKIPPABLE, len(raw)) + raw
        parts, size = [start], 0

        def archive() -> pa.RecordBatch:
            content = b"".join(parts)
            name = f"{hashlib.sha256(content).hexdigest()[:24]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], type=pa.binary())], ["archive", "content"])

        for b in sliced(batches, 256):
            for page_id, url, payload, digest, n, first in zip(*(c.to_pylist() for c in b.columns)):
                revisit = first is not None and first != page_id
                parts.append(compress(record(page_id, url, payload, digest, n, revisit, first if revisit else None, date)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield archive()
                    parts, size = [start], 0
        if size:
            yield archive()

    return materialize(rows.mapInArrow(run, "archive string, content binary"), "warc", "uncompressed")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of an archive table."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "payload", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for rec in frames(content.as_py()):
                    rows.append(parse(rec))
                    size += len(rows[-1]["payload"] or b"") if payloads else 0
                    if not payloads:
                        rows[-1]["payload"] = None
                    if size > 16 << 20 or len(rows) >= 2048:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=k) for n, k in zip(names, kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=k) for n, k in zip(names, kinds)], names)

    return archives.select("content").mapInArrow(run, RECORDS)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write the archives as files into a folder that all executors share; their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([b.column(0)], ["archive"])

    return archives.mapInArrow(run, "archive string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all pages, written and read back."""
    read = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
