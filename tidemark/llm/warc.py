"""WARC records inside ZIP packages, written by tasks and read back by range.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one
gzip member for each record, and ``indexes/index.cdxj``, one line for each
record with its offset and length in the archive member.  The reader never
unpacks: it finds the end record, follows the ZIP64 locator where one stands,
walks the central directory, skips the local header of a member and range-reads
the records that the index names.

Files go to the shared scratch folder through Arrow's file systems, so any
store that Arrow reaches will do.  A package is named for the task attempt that
wrote it and counts only once that attempt has committed its manifest rows; a
retried task leaves an unlisted file and no double records.

Defined results: null html is an empty payload; a null id is written as ``-``
and reads back null; of rows that repeat id and payload one is the response;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import group_best, pick, scratch_path, settle

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 100
#: Bytes of an archive member after which a task starts the next package.
PACKAGE_BYTES = 256 << 20
#: Neighbouring records are fetched in one range of at most this many bytes (one record may be longer).
RANGE_BYTES = 4 << 20

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- reading ZIP ----------------------------------------------------------------


class Package:
    """Central directory of a ZIP file, read by ranges from a seekable source."""

    def __init__(self, source: BinaryIO, size: int):
        self.source, self.size = source, size
        self.members = {name: (size, at) for name, size, at in self._directory()}

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("range outside the package")
        self.source.seek(at)
        raw = self.source.read(n)
        if len(raw) != n:
            raise ValueError("short read")
        return raw

    def _directory(self) -> Iterator[tuple[str, int, int]]:
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("ZIP64 locator missing")
            record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end record missing")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        raw, at = self.read(start, length), 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, plain, n_name, n_extra, n_note = struct.unpack_from("<10xH8xIIHHH", raw, at)
            (offset,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            packed, plain, offset = _zip64(extra, packed, plain, offset)
            if method == 0:
                if packed != plain:
                    raise ValueError("stored member with two sizes")
                yield name, packed, offset
            at += 46 + n_name + n_extra + n_note

    def span(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes lie: (offset, length)."""
        size, at = self.members[name]
        head = self.read(at, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return at + 30 + n_name + n_extra, size


def _zip64(extra: bytes, packed: int, plain: int, offset: int) -> tuple[int, int, int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            plain = next(values) if plain == 0xFFFFFFFF else plain
            packed = next(values) if packed == 0xFFFFFFFF else packed
            offset = next(values) if offset == 0xFFFFFFFF else offset
        at += 4 + n
    return packed, plain, offset


# --- records --------------------------------------------------------------------


def _name(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}:{row}>"


def _header(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def write_record(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers: tuple[int | None, int] | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {_name(page_id, row)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_header(url or '')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {_name(*refers)}", f"WARC-Profile: {_PROFILE}", "WARC-Truncated: length"] if refers else []),
        f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}


def read_record(member: bytes) -> dict:
    """Fields and payload of one gzip member; the digest of a full payload is checked."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda name: None if (x := fields[name].split(":")[2]) == "-" else int(x)
    return {
        "page_id": number("warc-record-id"),
        "url": fields["warc-target-uri"],
        "payload_bytes": int(_headers(http)["content-length"]),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": number("warc-refers-to") if "warc-refers-to" in fields else None,
        "payload": payload if fields["warc-type"] == "response" else None,
    }


# --- Spark ----------------------------------------------------------------------


class _Counting(io.RawIOBase):
    """Write-only stream over an Arrow output stream; makes zipfile use data descriptors."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, raw) -> int:
        self.out.write(bytes(raw))
        self.at += len(raw)
        return len(raw)


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        made: list[tuple[str, int]] = []
        package = out = member = None
        index: list[str] = []
        at = 0

        def close() -> None:
            nonlocal package
            if package is not None:
                member.close()
                package.writestr(zipfile.ZipInfo(INDEX), "".join(index))
                package.close()
                out.close()
                made[-1] = (made[-1][0], len(index))
                package = None

        for batch in batches:
            for page_id, row, url, html, digest, best_id, best_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    made.append((name, 0))
                    out = fs.open_output_stream(f"{base}/{name}")
                    package = zipfile.ZipFile(_Counting(out), "w", zipfile.ZIP_STORED, allowZip64=True)
                    member, index, at = package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True), [], 0
                revisit = best_row is not None and best_row != row
                record = write_record(page_id, row, url, (html or "").encode(), digest, (best_id, best_row) if revisit else None)
                member.write(record)
                index.append(f"page:{page_id} {row} " + json.dumps({"offset": at, "length": len(record)}) + "\n")
                at += len(record)
                if at >= limit:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["package", "records"])

    return run


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read(folder: str, with_payload: bool):
    schema = _RECORD_SCHEMA if with_payload else pa.schema(list(_RECORD_SCHEMA)[:-1])

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                path = f"{base}/{name}"
                with fs.open_input_file(path) as source:
                    package = Package(source, source.size())
                    start, length = package.span(ARCHIVE)
                    at, n = package.span(INDEX)
                    spots = [(x["offset"], x["length"]) for x in (json.loads(line[line.index("{") :]) for line in package.read(at, n).decode().splitlines())]
                    if len(spots) != records or any(o < 0 or o + m > length for o, m in spots):
                        raise ValueError(f"{name}: index and archive disagree")
                    i = 0
                    while i < len(spots):
                        j, lo = i + 1, spots[i][0]
                        while j < len(spots) and spots[j][0] == spots[j - 1][0] + spots[j - 1][1] and spots[j][0] + spots[j][1] - lo <= RANGE_BYTES:
                            j += 1
                        raw = package.read(start + lo, spots[j - 1][0] + spots[j - 1][1] - lo)
                        yield batch_of([read_record(raw[o - lo : o - lo + m]) for o, m in spots[i:j]])
                        i = j

    return run


def write_archives(pages: DataFrame, limit: int = PACKAGE_BYTES) -> tuple[str, DataFrame]:
    """Writes ``pages(page_id, url, html)``; gives the folder and the manifest (package, records)."""
    plain = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = settle(plain.select("*", F.monotonically_increasing_id().alias("row"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("size")), "pages", codec="zstd")
    long = rows.filter(f"size >= {REVISIT_BYTES}").select("row", "digest", F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row").alias("order"))
    best = group_best(long, "digest", "order", "row").filter("group_size > 1").select("row", F.col("best.page_id").alias("best_id"), F.col("best.row").alias("best_row"))
    told = rows.join(best, "row", "left").select("page_id", "row", "url", "html", "digest", "best_id", "best_row")
    folder = scratch_path(pages.sparkSession, "archives")
    return folder, settle(told.mapInArrow(_write(folder, limit), "package string, records long"), "manifest")


def read_archives(folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the packages that the manifest lists."""
    return manifest.repartition(max(1, manifest.count()), "package").mapInArrow(_read(folder, with_payload), _RECORD if with_payload else _RECORD.rpartition(",")[0])
