"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends in the seek table of the
public seekable format (a skippable frame with the sizes of all frames). An index maps each record
identifier to bundle, frame, the frame's offset, and the record's offset within the frame, so that one
record is read with one seek. Payloads of at least `least` bytes that occur again become revisit records
without payload, which refer to the record with the smallest id.

Every row gives one record. Null or empty html is an empty payload, null urls leave out their header.
Rows that repeat the smallest id with the same payload are all responses. Record identifiers are page ids;
a repeated id has several index rows, a null one stays null and is always a response that no revisit refers to.
Further columns are ignored. Frames may be of any size. Bundles of failed attempts carry other
names and are in no index.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import fresh_dir, in_batches, settled
from lobspark.llm.files import opened, written

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record. Revisits keep the size of the payload that they leave out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is None:
        head[2] = "WARC-Record-ID: <urn:page:>"
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + "".join("%%%02X" % ord(c) if c < "!" else c for c in url))
    if refers_to is not None:
        head[-2:-2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(frame: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at an offset."""
    stop = frame.index(b"\r\n\r\n", at)
    lines = frame[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    return head, frame[begin:end], end + 4


class Bundle:
    """Writes records as frames and a seek table."""

    def __init__(self, out) -> None:
        self.out, self.at, self.frames = out, 0, []
        self.pending, self.size = [], 0
        self.press = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """The record's frame, that frame's offset and the record's offset in it."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        place = (len(self.frames), self.at, self.size)
        self.pending.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.size:
            frame = self.press.compress(b"".join(self.pending))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.at += len(frame)
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of a bundle's frames, read from its end."""
    size = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw = file.read_at(8 * n, size - 9 - 8 * n)
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", raw):
        out.append((at, c, d))
        at += c
    return out


def frame(file, entry: tuple[int, int, int]) -> bytes:
    offset, packed, size = entry
    return zstandard.ZstdDecompressor().decompress(file.read_at(packed, offset), max_output_size=size)


def read_record(bundle: str, frame_offset: int, frame_bytes: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry."""
    with opened(bundle) as file:
        data = zstandard.ZstdDecompressor().decompress(file.read_at(frame_bytes, frame_offset))  # a frame says its size
    return parsed(data, offset)[:2]


def planned(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest, size and, for revisits, refers_to. Html is shuffled once, by page id, which no popular payload skews."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    ids = base.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    again = ids.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    revisits = ids.where(F.col("size") >= least).join(again, "digest").where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct()
    return base.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")}).join(revisits, ["page_id", "digest"], "left")


def archived(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes the bundles and returns the index, settled: page_id, record_type, bundle, frame, frame_offset, offset, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(0, b.num_rows, 64):
                    part = b.slice(i, 64)
                    yield from zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "refers_to")), strict=True)

        source = rows()
        first = next(source, None)
        while first is not None:
            uri, entries, total = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst", [], 0
            with written(uri) as out:
                bundle = Bundle(out)
                while first is not None and total < BUNDLE_BYTES:
                    page_id, url, html, digest, size, refers_to = first
                    data = record(page_id, url, html.encode("utf-8", "surrogatepass") if refers_to is None else b"", digest, size, refers_to)
                    entries.append((page_id, "response" if refers_to is None else "revisit", uri, *bundle.add(data), len(data)))
                    total += len(data)
                    first = next(source, None)
                bundle.close()
            for i in range(0, len(entries), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*entries[i : i + 4096], strict=True)], names)

    names = ["page_id", "record_type", "bundle", "frame", "frame_offset", "offset", "bytes"]
    plan = planned(pages, least).select("page_id", "url", "html", "digest", "size", "refers_to")
    return settled(in_batches(plan, write, "page_id long, record_type string, bundle string, frame long, frame_offset long, offset long, bytes long"))


def read(index: DataFrame) -> DataFrame:
    """All records of an index's bundles, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.
    Sizes and digests of responses are taken from their payloads and held against their headers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                with opened(uri) as file:
                    for entry in seek_table(file):
                        yield decoded(frame(file, entry))

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn != "<urn:page:>" else None

    def decoded(data: bytes) -> pa.RecordBatch:
        rows, at = [], 0
        while at < len(data):
            head, block, at = parsed(data, at)
            kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != said):
                raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
            rows.append((number(head["WARC-Record-ID"]), size, said, kind, number(head.get("WARC-Refers-To"))))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return index.select("bundle").distinct().mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def digest(pages: DataFrame) -> DataFrame:
    return read(archived(pages, fresh_dir(pages.sparkSession, "warc")))
