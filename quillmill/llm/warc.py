"""Web archives in ZIP packages, written and read by ranges.

A package holds `archive/data.warc.gz` (one gzip member a record) and `indexes/index.cdxj`,
both stored, so that a record is a range of the package. The reader parses the end record,
the ZIP64 records and the central directory itself, finds all stored archive members and
their CDX or CDXJ indexes, and reads only ranges; nothing is extracted. A member that no
index covers is read as a stream, record by record. Files are reached through pyarrow.fs,
so any store that pyarrow knows will do.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the formats.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, STAMP = "2024-01-01T00:00:00Z", "20240101000000"
RECORD_ID = "urn:page:"


@dataclass(frozen=True)
class Settings:
    """archive_bytes: a package is closed beyond this size. span_bytes: records are read
    in runs of about this many bytes. revisit_bytes: smallest payload that may be a
    revisit."""

    archive_bytes: int = 256 << 20
    span_bytes: int = 4 << 20
    revisit_bytes: int = 100


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


# writing


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzipped WARC record. A revisit holds the HTTP head (with the length of the
    full payload) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def sort_key(url: str) -> str:
    """The key of an index line: the host's labels from the last to the first, then the path."""
    host, slash, path = url.partition("://")[2].partition("/")
    key = ",".join(reversed(host.lower().split("."))) + ")" + slash + path
    return quote(key, safe="/?&=,;:@()~!*'+-._%#")


class _Package:
    """A ZIP package that is being written: records first, then the index of them."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, at = open_fs(self.path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(ARCHIVE, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, url: str | None, digest: str, raw: bytes) -> None:
        self.data.write(raw)
        entry = {"url": url or "", "digest": f"sha256:{digest}", "offset": str(self.size), "length": str(len(raw)), "filename": ARCHIVE.split("/")[1]}
        self.lines.append(f"{sort_key(url or '')} {STAMP} {json.dumps(entry)}\n")
        self.size += len(raw)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "".join(sorted(self.lines)))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def write_archives(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html) and return the manifest
    (path, records). Of rows with equal payloads of at least revisit_bytes bytes those
    with the smallest page_id are responses (also if it repeats), the others revisits.
    Null html is the empty payload; a null page_id is never referred to. A task that is
    run again writes new files; only those that the manifest names count."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= settings.revisit_bytes
    firsts = (
        rows.where(large & F.col("page_id").isNotNull()).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    dealt = rows.join(firsts, "digest", "left").withColumn("revisit", F.coalesce(large & (F.col("page_id") != F.col("first")), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page_id, url, payload, digest, first, revisit in zip(*(batch.column(k).to_pylist() for k in range(6))):
                package = package or _Package(folder)
                package.add(url, digest, record(page_id, url, payload, digest, first, revisit))
                if package.size >= settings.archive_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    order = dealt.select("page_id", "url", "payload", "digest", "first", "revisit")
    return store.written(order.mapInArrow(run, "path string, records long"), "manifest")


# reading


def members(source: pa.NativeFile, size: int) -> list[dict]:
    """The members of a ZIP package by its central directory: name, method, size, packed
    and the offset of the data. Raises ValueError on a package that can't be read."""

    def at(offset: int, n: int) -> bytes:
        if offset < 0 or offset + n > size:
            raise ValueError("a ZIP record lies outside of the file")
        source.seek(offset)
        return source.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    found = tail.rfind(END)
    if found < 0 or len(tail) - found < 22:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack("<8xHHII2x", tail[found : found + 22])[1:]
    end_at = tail_at + found
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = at(end_at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record64 = at(struct.unpack("<8xQ4x", locator)[0], 56)
        if record64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack("<24xQQQQ", record64)[1:]
    directory, out, p = at(offset, length), [], 0
    for _ in range(count):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("a broken central directory")
        flags, method, packed, unpacked, n_name, n_extra, n_comment, local = struct.unpack("<8xHH8xIIHHH8xI", directory[p : p + 46])
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                unpacked = wide.pop(0) if unpacked == 0xFFFFFFFF else unpacked
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + n
        head = at(local, 30)
        if head[:4] != LOCAL:
            raise ValueError("a broken local header")
        data = local + 30 + sum(struct.unpack("<HH", head[26:30]))
        out.append({"name": name, "method": method, "size": unpacked, "packed": packed, "offset": data})
        p += 46 + n_name + n_extra + n_comment
    return out


def index_entries(text: io.TextIOBase) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of the lines of a CDXJ index, or of a CDX one whose header
    names its fields (V offset, S length, g file name)."""
    fields: list[str] = []
    for line in text:
        line = line.rstrip("\n")
        if line.lstrip().startswith("CDX "):
            fields = line.split()[1:]
        elif fields:
            row = dict(zip(fields, line.split()))
            if row.get("V", "-").isdigit() and row.get("S", "-").isdigit() and "g" in row:
                yield row["g"], int(row["V"]), int(row["S"])
        elif "{" in line:
            row = json.loads(line[line.index("{") :])
            if "offset" in row and "length" in row and "filename" in row:
                yield row["filename"], int(row["offset"]), int(row["length"])


class Range(io.RawIOBase):
    """The bytes of a file from offset on, length of them."""

    def __init__(self, source: pa.NativeFile, offset: int, length: int):
        source.seek(offset)
        self.source, self.left = source, length

    def readable(self) -> bool:
        return True

    def readinto(self, into: bytearray) -> int:
        piece = self.source.read(min(len(into), self.left))
        into[: len(piece)] = piece
        self.left -= len(piece)
        return len(piece)


def spans(path: str, span_bytes: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of whole records in a package. A stored archive member that
    its indexes don't cover from end to end is one run, which is read as a stream."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as source:
        stored = [m for m in members(source, source.size()) if m["method"] == 0]
        listed: dict[str, list[tuple[int, int]]] = {}
        for m in stored:
            if m["name"].startswith("indexes/") and m["name"].endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
                raw = io.BufferedReader(Range(source, m["offset"], m["size"]))
                with io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if m["name"].endswith(".gz") else raw, "utf-8") as text:
                    for name, start, n in index_entries(text):
                        listed.setdefault(name.rsplit("/", 1)[-1], []).append((start, n))
        for m in stored:
            if not (m["name"].startswith("archive/") and m["name"].endswith((".warc", ".warc.gz"))):
                continue
            places = sorted(set(listed.get(m["name"].rsplit("/", 1)[-1], [])))
            begin, end, runs = 0, 0, []
            for start, n in places:
                if start != end:  # a gap: the index leaves records out
                    break
                if end > begin and start + n - begin > span_bytes:
                    runs.append((m["offset"] + begin, end - begin))
                    begin = start
                end = start + n
            if end != m["size"]:
                runs, begin, end = [], 0, m["size"]
            if end > begin:
                runs.append((m["offset"] + begin, end - begin))
            yield from runs


def records(raw: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each WARC record of a run, gzipped or plain, one held at a time."""
    stream = io.BufferedReader(raw, 1 << 20)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.lower()] = v.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("a WARC record ends early")
        yield headers, block


def _page(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(RECORD_ID)
    return int(text) if text.lstrip("-").isdigit() else None


def _row(headers: dict[str, str], block: bytes, path: str) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    if revisit:
        size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    else:
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} in {path} has another digest")
    return (_page(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], _page(headers.get("warc-refers-to")), size, digest, None if revisit else payload)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def read_archives(manifest: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each record of the packages of manifest(path): page_id, target_uri,
    record_type, refers_to, payload_bytes, payload_digest (of the full payload), payload
    (null for a revisit). A response whose payload doesn't have its digest raises."""
    spark: SparkSession = manifest.sparkSession

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, a, n) for p in batch["path"] for a, n in spans(p, settings.span_bytes)]
            yield pd.DataFrame(rows, columns=["path", "offset", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as source:
                    rows, held = [], 0
                    for headers, block in records(Range(source, offset, length)):
                        rows.append(_row(headers, block, path))
                        held += len(block)
                        if held > settings.span_bytes:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    todo = manifest.select("path").repartition(n, "path").mapInPandas(plan, "path string, offset long, length long")
    return todo.repartition(n, "path", "offset").mapInArrow(
        run, "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )
