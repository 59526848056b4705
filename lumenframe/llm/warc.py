"""WARC records in ZIP archives: written by Spark tasks, read back by range without extraction."""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, materialize

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20  # an archive is closed beyond so many bytes of records
READ_BYTES = 4 << 20  # neighbouring records are fetched together up to this
BATCH_BYTES = 8 << 20
MOST_READERS = 100_000  # tasks that read archives; a task then takes several

# --- ZIP structures (PKWARE APPNOTE 4.3) ------------------------------------------------------

_END, _END64, _LOC64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def central_directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the local header, stored size, method), from the central or ZIP64 directory."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(_END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_END, 0, end)  # the signature may also stand inside the comment
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        spot = tail_at + end - 20
        locator = file.read_at(20, spot) if spot >= 0 else b""
        if locator[:4] != _LOC64:
            raise ValueError("ZIP64 locator is missing")
        where = struct.unpack_from("<Q", locator, 8)[0]
        record = file.read_at(56, where)
        if record[:4] != _END64:
            raise ValueError("ZIP64 end of central directory is missing")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    directory = file.read_at(length, at)
    found, p = {}, 0
    for _ in range(count):
        if directory[p : p + 4] != _ENTRY:
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, full, n, m, c = struct.unpack_from("<IIHHH", directory, p + 20)
        offset = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + n, p + 46 + n + m
        while q + 4 <= stop:
            kind, width = struct.unpack_from("<HH", directory, q)
            if kind == 1:  # 64-bit values stand only for the fields that are full, in this order
                values = iter(struct.unpack_from(f"<{width // 8}Q", directory, q + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            q += 4 + width
        found[name] = (offset, packed, method)
        p = stop + c
    return found


def stored_member(file, entry: tuple[int, int, int]) -> tuple[int, int]:
    """(offset, size) of a stored member's bytes in the archive."""
    offset, size, method = entry
    if method != 0:
        raise ValueError("only stored members can be read by range")
    head = file.read_at(30, offset)
    if head[:4] != _LOCAL:
        raise ValueError("local header is missing")
    n, m = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n + m, size


# --- records ----------------------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 response or, given ``refers_to``, a revisit without payload; gzipped as one member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", date)]
    if page_id is not None:
        head.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        head.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url)))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """Headers, and the payload where the record holds one."""
    head, _, rest = zlib.decompress(raw, wbits=31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda key: int(fields[key].strip("<>").rpartition(":")[2]) if key in fields else None
    response = fields["WARC-Type"] == "response"
    if response and len(payload) != length:
        raise ValueError("payload is cut short")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload_bytes": length,
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": payload if response else None,
    }


class _Archive:
    """One ZIP archive under way: records stream into a stored member, their index follows."""

    def __init__(self, folder: str, name: str, force_zip64: bool) -> None:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        self.path = f"{folder}/{name}"
        self.out = system.open_output_stream(f"{root}/{name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(DATA, "w", force_zip64=force_zip64 or ARCHIVE_BYTES >= 1 << 31)
        self.index: list[str] = []
        self.at = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.member.write(raw)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(raw)}))
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.at


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES, force_zip64: bool = False) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns (path, records, bytes) an archive.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is the
    response and the others are revisits of it; all others are responses. Only (page_id, digest) pairs
    are shuffled to decide this, with minima combined before the shuffle, and payloads only if there are too many revisits to broadcast their ids.

    Archives go to ``folder`` (any URI that Arrow's file systems open; by default the cluster's shared folder).
    A task names its archives by its attempt; those of a failed attempt are never listed. Null html is an empty
    payload, null url no target URI. Rows without page_id are responses without a record id. Repeated
    rows of a page are a record each, responses if the page is the smallest. An empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    ids = rows.filter((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = materialize(ids.join(first, "digest").filter("page_id > refers_to").distinct(), "revisits")
    decided = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, archive = TaskContext.get(), [], None
        label = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if archive is None:
                    archive = _Archive(folder, f"part-{label}-{len(made):05d}.wacz", force_zip64)
                archive.add(row[0], record_bytes(*row, date))
                if archive.at >= archive_bytes:
                    made.append(archive.close())
                    archive = None
        if archive is not None:
            made.append(archive.close())
        if made:
            path, records, size = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(records, pa.int64()), pa.array(size, pa.int64())], ["path", "records", "bytes"])

    return materialize(decided.mapInArrow(write, "path string, records long, bytes long"), "archives")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_ARROW = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
          ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]


def archive_records(path: str) -> Iterator[dict]:
    """All records of one archive, found through its directory and index and read by range."""
    system, local = pafs.FileSystem.from_uri(path)
    with system.open_input_file(local) as file:
        members = central_directory(file, file.size())
        at, size = stored_member(file, members[INDEX])
        index = [json.loads(x) for x in file.read_at(size, at).split(b"\n") if x]
        start, _ = stored_member(file, members[DATA])
        k = 0
        while k < len(index):
            end = k
            while end < len(index) and (end == k or index[end]["offset"] + index[end]["length"] - index[k]["offset"] <= READ_BYTES):
                end += 1
            base = index[k]["offset"]
            span = index[end - 1]["offset"] + index[end - 1]["length"] - base
            chunk = file.read_at(span, start + base)
            for x in index[k:end]:
                yield parse_record(chunk[x["offset"] - base : x["offset"] - base + x["length"]])
            k = end


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives listed in column ``path``: one row each, payload null for revisits.

    An archive is read by one task, in ranges; archives are bounded in size, so is a task. Digests of
    responses are computed from the bytes read, those of revisits are as recorded. An empty list gives
    an empty result.
    """
    fields = _ARROW if with_payload else _ARROW[:-1]

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], [n for n, _ in fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for record in archive_records(path):
                    rows.append(record)
                    held += 200 + len(record["payload"] or b"") * with_payload
                    if held >= BATCH_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    paths = archives.select("path", (F.row_number().over(W.orderBy("path")) - 1).alias("number"))  # a short list: one row an archive
    paths = paths.repartitionById(max(1, min(archives.count(), MOST_READERS)), "number").select("path")
    return paths.mapInArrow(read, RECORD + (", payload binary" if with_payload else ""))
