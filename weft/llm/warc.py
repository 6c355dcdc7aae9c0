"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_bytes``; a bundle
ends with the seek table of the public seekable format (a skippable frame with
the sizes of all frames and a fixed footer). The index maps a page to bundle,
frame and offset within the frame, so one record costs one frame.

Of pages with equal payloads (at least ``min_bytes`` long) the one with the
smallest page_id becomes a response, the others revisits, which carry headers
only: the length and digest of the full payload and the page they refer to.

Bundles are rows (binary) of a table in shared storage, so a lost executor
costs a re-run of its own tasks; ``export`` writes them as files.

Defined cases: null html is an empty payload; a null or unusable url is
written percent-encoded or as ``urn:page``; rows that repeat a page_id with one
payload are all responses if that id is the smallest; a null page_id is never
the smallest unless all are null, when all are responses; empty tables give no
bundles.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import durable, lookup_join

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

NAMESPACE = uuid.UUID("6f0d5a52-6f0f-4f0e-9d55-2f6f3d1f6c11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:page'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0):
    """Fields, HTTP fields, body and end of the record at ``at``."""
    cut = data.index(b"\r\n\r\n", at)
    lines = data[at:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body, size = cut + 4, int(fields["Content-Length"])
    mid = data.index(b"\r\n\r\n", body)
    http = dict(x.split(": ", 1) for x in data[body:mid].decode().split("\r\n")[1:])
    return fields, http, data[mid + 4 : body + size], body + size + 4


class BundleWriter:
    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.done, self.sizes, self.open, self.length = [], [], [], 0
        self.raw = 0

    def add(self, rec: bytes) -> tuple[int, int, int]:
        """Append a record; its frame, offset within the frame and length."""
        if self.open and self.length + len(rec) > self.frame_bytes:
            self._flush()
        place = (len(self.sizes), self.length, len(rec))
        self.open.append(rec)
        self.length += len(rec)
        self.raw += len(rec)
        return place

    def _flush(self):
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.done.append(packed)
            self.sizes.append((len(packed), self.length))
            self.open, self.length = [], 0

    def finish(self) -> bytes:
        self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        foot = table + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.done) + struct.pack("<II", SKIPPABLE_MAGIC, len(foot)) + foot


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, plain size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, start, out = len(bundle) - 9 - n * width, 0, []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, at + k * width)
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


def write_bundles(pages: DataFrame, min_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 16 << 20, level: int = 3) -> DataFrame:
    """Durable table (bundle string, data binary, index array) of all pages' records."""
    kind = pages.schema["page_id"].dataType.simpleString()
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    groups = p.filter(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    groups = durable(groups.filter("n > 1").select("sha1", "first"))
    p = lookup_join(p, groups, ["sha1"])
    p = p.select("page_id", "url", "html", "sha1", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def write(batches):
        part, made = TaskContext.get().partitionId(), 0
        w, index = BundleWriter(frame_bytes, level), []

        def out():
            nonlocal w, index, made
            rows = {"page_id": [i[0] for i in index], "frame": [i[1] for i in index], "offset": [i[2] for i in index], "length": [i[3] for i in index]}
            ids = pa.array(rows.pop("page_id"), ids_type)
            entry = pa.StructArray.from_arrays([ids, *[pa.array(v, pa.int64()) for v in rows.values()]], ["page_id", *rows])
            lists = pa.ListArray.from_arrays(pa.array([0, len(entry)], pa.int32()), entry)
            rb = pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{made:05d}"]), pa.array([w.finish()], pa.binary()), lists], ["bundle", "data", "index"])
            w, index, made = BundleWriter(frame_bytes, level), [], made + 1
            return rb

        for b in batches:
            ids_type = b.schema.field("page_id").type
            for page_id, url, html, sha1, ref in zip(*[b.column(c) for c in ("page_id", "url", "html", "sha1", "refers_to")], strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                payload = html.as_buffer().to_pybytes()
                index.append((page_id.as_py(), *w.add(record(page_id.as_py(), url.as_py(), payload, digest, ref.as_py()))))
                if w.raw >= bundle_bytes:
                    yield out()
        if index:
            yield out()

    return durable(p.mapInArrow(write, f"bundle string, data binary, index array<struct<page_id:{kind},frame:bigint,offset:bigint,length:bigint>>"))


def read_bundles(bundles: DataFrame, page_type: str = "bigint") -> DataFrame:
    """Every record of the bundles, parsed frame by frame; a response's digest is made anew from its payload."""

    def read(batches):
        for b in batches:
            for data in b.column("data"):
                bundle = data.as_py()
                rows = []
                for frame in seek_table(bundle):
                    plain, at = read_frame(bundle, frame), 0
                    while at < len(plain):
                        f, http, body, at = parse(plain, at)
                        kind, size, digest = f["WARC-Type"], int(http["Content-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            if len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                                raise ValueError(f"damaged record {f['WARC-Record-ID']}")
                        rows.append((f.get("X-Page-ID"), size, digest, kind, f.get("X-Refers-To-Page")))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(cols)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                )

    out = bundles.select("data").mapInArrow(read, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(page_type)).withColumn("refers_to", F.col("refers_to").cast(page_type))


def page_index(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle", F.explode("index").alias("i")).select("i.page_id", "bundle", "i.frame", "i.offset", "i.length")


def fetch(bundle: bytes, frame: int, offset: int, length: int):
    """One record by its place: reads the seek table and one frame."""
    return parse(read_frame(bundle, seek_table(bundle)[frame])[offset : offset + length])


def export(bundles: DataFrame, folder: str) -> None:
    """Write each bundle as ``<bundle>.warc.zst`` into a folder that every executor mounts; reruns replace whole files."""

    def put(rows):
        for r in rows:
            to = os.path.join(folder, f"{r['bundle']}.warc.zst")
            with open(f"{to}.{uuid.uuid4().hex}", "wb") as f:
                f.write(bytes(r["data"]))
            os.replace(f.name, to)

    os.makedirs(folder, exist_ok=True)
    bundles.select("bundle", "data").foreachPartition(put)
