"""WARC records in ZIP packages: written per task, located through the package's directories, read by range.

A package holds ``archive/data.warc.gz``, stored without compression as every record is a gzip member of its
own, and ``indexes/index.cdx``, a line per record: offset and length in the archive member. The reader parses the end of the
central directory, its ZIP64 form where a field overflows, and the local header of each member, and then
reads single records by their byte range; nothing is extracted.

Defined cases: a null payload is empty; of records with equal payloads of at least ``min_bytes`` those with
the largest id are responses, all others revisit it (a null id is the least; where all are null all are
responses); repeated rows give repeated records; an empty table gives no packages and no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.common import durable

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
RECORD_COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_CRLF = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), n (payload bytes), sha1, refers_to (null for responses).

    The join is on digests alone; it carries one row per digest on one side, so a digest with very many
    pages can be split over tasks."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"n": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    heads = rows.filter(F.col("n") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("head"))
    found = rows.join(heads, "sha1", "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return found.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n", "sha1", F.when(revisit, F.col("head")).alias("refers_to")
    )


def _record(page_id, url, payload, n, sha1, refers_to) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "" if url is None else json.dumps(url)[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    if refers_to is None:
        block += payload
    else:
        head += [
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + _CRLF
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text + block + _CRLF * 2) + packer.flush()


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Writes a package per task; returns path, bytes and n_records of each. A task that runs again replaces
    its package only once the new one is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        name, lines, at = f"{top}/pages-{task.partitionId():06d}.wacz", [], 0
        part = f"{name}.{task.taskAttemptId()}"
        with store.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open(ARCHIVE, "w", force_zip64=True) as member:
                for batch in batches:
                    for row in batch.to_pylist():
                        data = _record(**row)
                        member.write(data)
                        lines.append(f"{at} {len(data)}\n")
                        at += len(data)
            package.writestr(INDEX, "".join(lines))
        if lines:
            store.move(part, name)
            yield pa.RecordBatch.from_pylist([{"path": name, "bytes": store.get_file_info(name).size, "n_records": len(lines)}])
        else:
            store.delete_file(part)

    return durable(records.select("page_id", "url", "payload", "n", "sha1", "refers_to").mapInArrow(run, "path string, bytes long, n_records long"))


# ---- reading


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header_at: int


def members(f, size: int) -> list[Member]:
    """The central directory of a ZIP file of which only the end and the directory are read."""
    tail_at = max(0, size - 65_557)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, n_bytes, at = struct.unpack_from("<HII", tail, end + 10)
    if n == 0xFFFF or n_bytes == 0xFFFFFFFF or at == 0xFFFFFFFF:
        locator = tail[end - 20 : end]
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = f.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, n_bytes, at = struct.unpack_from("<QQQ", record, 32)
    data, found, k = f.read_at(n_bytes, at), [], 0
    for _ in range(n):
        if data[k : k + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", data, k + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, k + 20)
        header_at = struct.unpack_from("<I", data, k + 42)[0]
        name = data[k + 46 : k + 46 + n_name].decode()
        extra, e = data[k + 46 + n_name : k + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # ZIP64: only the fields that overflow, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header_at = next(wide) if header_at == 0xFFFFFFFF else header_at
            e += 4 + length
        found.append(Member(name, method, packed, header_at))
        k += 46 + n_name + n_extra + n_comment
    return found


def data_at(f, member: Member) -> int:
    """Where a member's bytes begin, behind its local header."""
    head = f.read_at(30, member.header_at)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header_at + 30 + n_name + n_extra


def locate(packages: DataFrame, index_bytes: int = 1 << 22) -> DataFrame:
    """path, at and length of every record, from the index members; an index is read in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, file = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
                with store.open_input_file(file) as f:
                    by_name = {m.name: m for m in members(f, f.size())}
                    archive, index = by_name[ARCHIVE], by_name[INDEX]
                    if archive.method or index.method:
                        raise ValueError("members must be stored")
                    base, start, rest = data_at(f, archive), data_at(f, index), b""
                    for k in range(0, index.size, index_bytes):
                        *lines, rest = (rest + f.read_at(min(index_bytes, index.size - k), start + k)).split(b"\n")
                        spans = [tuple(map(int, x.split())) for x in lines]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(spans), "string"), pa.array([base + a for a, _ in spans], "int64"), pa.array([n for _, n in spans], "int64")],
                            ["path", "at", "length"],
                        )

    return packages.select("path").mapInArrow(run, "path string, at long, length long")


def parse_record(data: bytes) -> dict:
    """The fields of RECORD_COLUMNS from one gzip member."""
    text = zlib.decompress(data, 31)
    head, _, rest = text.partition(_CRLF * 2)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(_CRLF * 2)
    n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda x: None if x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    response = field["WARC-Type"] == "response"
    if response and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": number(field["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": field["WARC-Type"],
        "refers_to": None if response else number(field["WARC-Refers-To"]), "url": json.loads(f'"{field["WARC-Target-URI"]}"'), "payload": payload if response else None,
    }


def read_records(spans: DataFrame, stretch: int = 8 << 20) -> DataFrame:
    """RECORD_COLUMNS of the records at (path, at, length), each read by its range. Ranges are dealt by package and
    stretch to as many tasks as there are stretches to read: a large package is read by many tasks, each in order."""
    spans = durable(spans)
    total = spans.agg(F.sum("length")).first()[0] or 0
    schema = pa.schema([("page_id", "int64"), ("payload_bytes", "int64"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "int64"), ("url", "string"), ("payload", "binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                if row["path"] != path:
                    if f:
                        f.close()
                    path = row["path"]
                    store, file = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
                    f = store.open_input_file(file)
                out.append(parse_record(f.read_at(row["length"], row["at"])))
                held += len(out[-1]["payload"] or b"")
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)
        if f:
            f.close()

    dealt = spans.repartition(max(1, math.ceil(total / stretch)), "path", F.floor(F.col("at") / stretch)).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, RECORD_COLUMNS)
