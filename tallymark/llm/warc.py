"""Web archives packed in ZIP files: written, indexed and read by byte ranges.

An archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``,
one gzip member for each WARC record, and ``indexes/index.cdxj``, one line for each record
with its offset and length. The reader finds the end record, with the ZIP64 one where sizes
ask for it, walks the central directory, locates all stored ``.warc`` and ``.warc.gz`` members and
all ``.cdx``/``.cdxj`` indexes (stored, deflated or gzipped), and reads records by their ranges:
nothing is extracted. A member that no index names is walked record by record. Archives live in the shared folder, opened through the file
system of their URI, so any executor reads any archive.

Pages with equal payloads are grouped by digest: the one with the largest page_id is a
``response`` and the others ``revisit`` it. The groups are aggregated and stored before they are
joined back on the digest, so the join's skewed partitions are split by AQE where a third of all
pages share a payload.

Defined results: a null html is an empty payload; a null url gets ``urn:page:<id>``; of equal
payloads, all rows that hold the largest page_id are responses (repeated rows included), and a
null page_id counts as smaller than any, so a group with only null ids is all responses;
payloads shorter than ``min_bytes`` are responses; an archive or record that can't be parsed
raises an error with its path and offset; other columns are left out.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Batcher, shared_path, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes after which a task begins another archive, and that one read task is given.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the payload's length and digest, not its bytes."""
    body = b"" if kind == "revisit" else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url if url is not None else f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and the stored body."""
    head, sep, block = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not sep:
        raise ValueError("not a WARC record")

    def fields(lines: list[bytes]) -> dict[str, str]:
        return {k.strip().decode("latin-1").lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}

    warc = fields(head.split(b"\r\n")[1:])
    if len(block) < int(warc["content-length"]):
        raise ValueError("the record is cut off")
    block = block[: int(warc["content-length"])]
    if not block.startswith(b"HTTP/"):
        return warc, {}, block
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, fields(http.split(b"\r\n")[1:]), body


@contextlib.contextmanager
def _told(place: str) -> Iterator[None]:
    """Errors of parsing say where."""
    try:
        yield
    except (ValueError, KeyError, EOFError, OSError, struct.error, zlib.error) as e:
        raise ValueError(f"{place}: {type(e).__name__}: {e}") from e


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def directory(f: pa.NativeFile) -> dict[str, Member]:
    """The central directory of a ZIP file, ZIP64 fields included."""
    size = f.size()
    tail_at = max(0, size - 65557)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while end >= 0 and struct.unpack_from("<H", tail, end + 20)[0] != len(tail) - end - 22:
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = f.read_at(20, tail_at + end - 20) if tail_at + end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        record_at = struct.unpack_from("<Q", locator, 8)[0]
        far = f.read_at(56, record_at)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, start = struct.unpack_from("<QQQ", far, 32)
    raw, at, out = f.read_at(length, start), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is cut off")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only the fields that are full, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            k += 4 + n
        out[name] = Member(name, method, packed, header)
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(f: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members are read by ranges")
    local = f.read_at(30, member.header)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def whole_member(f: pa.NativeFile, member: Member) -> bytes:
    """A small member's bytes, deflated ones too; gzip files unpacked."""
    if member.method not in (0, 8):
        raise ValueError(f"{member.name} is compressed by method {member.method}")
    raw = f.read_at(member.size, data_start(f, replace(member, method=0)))
    raw = zlib.decompress(raw, -15) if member.method == 8 else raw
    return gzip.decompress(raw) if member.name.endswith(".gz") else raw


def _walked(f: pa.NativeFile, base: int, end: int, packed: bool) -> list[tuple[int, int]]:
    """(offset, length) of the records of a member without an index."""
    out, start = [], base
    while start < end:
        if packed:
            unzip, at = zlib.decompressobj(31), start
            while not unzip.eof and at < end:
                part = f.read_at(min(1 << 16, end - at), at)
                unzip.decompress(part)
                at += len(part)
            if not unzip.eof:
                raise ValueError(f"the record at {start} is cut off")
            length = at - start - len(unzip.unused_data)
        else:
            head, size = b"", 1 << 12
            while b"\r\n\r\n" not in head and len(head) < end - start:
                head, size = f.read_at(min(size, end - start), start), 2 * size
            lines, found, _ = head.partition(b"\r\n\r\n")
            n = re.search(rb"(?im)^content-length:\s*(\d+)", lines)
            if not found or not n:
                raise ValueError(f"no record at {start}")
            length = len(lines) + 4 + int(n[1]) + 4
        out.append((start, length))
        start += length
    return out


def index(f: pa.NativeFile) -> list[tuple[int, int]]:
    """(offset in the file, length) of every record of every archive member, by the indexes and by walking what they leave out."""
    members = directory(f)
    archives = {name: m for name, m in members.items() if name.endswith((".warc", ".warc.gz"))}
    if not archives:
        raise ValueError("no WARC member")
    base, short = {name: data_start(f, m) for name, m in archives.items()}, defaultdict(list)
    for name in archives:
        short[name.rpartition("/")[2]].append(name)
    found: dict[str, set[tuple[int, int]]] = defaultdict(set)
    for name, member in members.items():
        if re.search(r"\.cdxj?(\.gz)?$", name):
            for line in whole_member(f, member).decode().split("\n"):
                if "{" not in line:
                    continue
                e = json.loads(line[line.index("{") :])
                named = str(e.get("filename", ""))
                at = [n for n in archives if n == named] or short.get(named.rpartition("/")[2]) or (list(archives) if len(archives) == 1 else [])
                if not at:
                    raise ValueError(f"{name} names a file that isn't there: {e.get('filename')!r}")
                if len(at) == 1:  # of several members with this name in different folders all records are walked
                    found[at[0]].add((base[at[0]] + int(e["offset"]), int(e["length"])))
    return [span for name, m in archives.items() for span in _completed(f, sorted(found[name]), base[name], base[name] + m.size, name.endswith(".gz"))]


def _completed(f: pa.NativeFile, spans: list[tuple[int, int]], start: int, end: int, packed: bool) -> list[tuple[int, int]]:
    """spans, and the records that stand between them."""
    out = []
    for at, length in [*spans, (end, 0)]:
        head = b"" if packed else f.read_at(min(4, max(0, at - start)), start)
        start += len(head) - len(head.lstrip(b"\r\n"))  # an index may leave a record's last line ends out
        if at > start:
            out += _walked(f, start, at, packed)
        if length:
            out.append((at, length))
        start = max(start, at + length)
    return out


def write_archive(stream: io.IOBase, records: Iterator[tuple[int | None, str | None, bytes]]) -> int:
    """Write (page id, url, record) into one ZIP file; gives the number of records."""
    lines, offset = [], 0
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(DATA, "w", force_zip64=True) as out:
            for page_id, url, raw in records:
                packed = gzip.compress(raw, 6, mtime=0)
                out.write(packed)
                key = quote(url or "-", safe="/:?&=%#,;+@!")
                lines.append(f"{key} {DATE[:4]} {json.dumps({'offset': offset, 'length': len(packed), 'page': page_id})}")
                offset += len(packed)
        z.writestr(INDEX, "\n".join(lines))
    return len(lines)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to) for every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    groups = own.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    groups = staged(groups.select("digest", "last"), "payload-groups")  # as a table it is one side of a join that AQE splits where a digest is hot
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return own.join(groups, "digest", "left").select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write a record for every page; gives the archives as rows (path, records).

    A task's archives bear the attempt's number, and only the rows of attempts that succeed
    count, so a lost executor leaves at most files that nothing refers to.
    """
    spark = pages.sparkSession
    at = folder or shared_path(spark, "archives")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, paths, counts = TaskContext.get().taskAttemptId(), 0, [], []
        files, root = _file_system(at)
        files.create_dir(root, recursive=True)
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4)), strict=True))
        held = next(rows, None)
        while held is not None:
            written = 0

            def part() -> Iterator[tuple[int | None, str | None, bytes]]:
                nonlocal held, written
                while held is not None and written < ARCHIVE_BYTES:
                    page_id, url, payload, kind, refers_to = held
                    raw = record(page_id, url, payload.as_py(), kind, refers_to)
                    written += len(raw)
                    yield page_id, url, raw
                    held = next(rows, None)

            name = f"part-{task}-{number}.wacz"
            with files.open_output_stream(f"{root}/{name}") as stream:
                counts.append(write_archive(_Forward(stream), part()))
            paths.append(f"{at}/{name}")
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], schema=schema)

    return staged(with_revisits(pages, min_bytes).mapInArrow(write, "path string, records long"), "archive-list")


class _Forward(io.RawIOBase):
    """A stream that only goes forward, as object stores have."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.place = stream, 0

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.place += len(data)
        return len(data)

    def tell(self) -> int:
        return self.place

    def seekable(self) -> bool:
        return False


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the archives in column ``path``, by ranges given in their indexes.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if
    asked for, payload (null for revisits).
    """
    spark: SparkSession = archives.sparkSession

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("ranges", pa.list_(pa.int64()))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, inner = _file_system(path)
                with files.open_input_file(inner) as f, _told(path):
                    rows, held, n = [], [], 0
                    for start, length in index(f):
                        held += [start, length]
                        n += length
                        if n >= READ_BYTES:
                            rows.append(held)
                            held, n = [], 0
                    if held:
                        rows.append(held)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.int64()))], schema=schema)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    if with_payload:
        fields, ddl = [*fields, ("payload", pa.binary())], ddl + ", payload binary"
    schema = pa.schema(fields)

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batcher(schema)
        for batch in batches:
            for path, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, inner = _file_system(path)
                with files.open_input_file(inner) as f:
                    for start, length in zip(spans[::2], spans[1::2], strict=True):
                        with _told(f"{path} at {start}"):
                            raw = f.read_at(length, start)
                            warc, http, body = parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                            kind, own = warc["warc-type"], base32_sha1(body)
                            digest = warc.get("warc-payload-digest", "sha1:" + own).removeprefix("sha1:")
                            n = number(http.get("content-length")) if kind == "revisit" else len(body)
                            if kind != "revisit" and own != digest:
                                raise ValueError(f"the payload's digest isn't {digest}")
                            row = (number(warc.get("warc-page-id")), warc.get("warc-target-uri"), kind, number(warc.get("warc-refers-to-page-id")), n, digest)
                        yield from out.add(row + ((body if kind != "revisit" else None,) if with_payload else ()), 256 + len(body) * with_payload)
        yield out.flush()

    spread = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(spread).mapInArrow(ranges, "path string, ranges array<long>").repartition(spread).mapInArrow(read, ddl)
