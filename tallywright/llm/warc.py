"""Web archives inside ZIP packages: written by Spark, read back by ranges without unpacking.

A page becomes a WARC 1.1 record, compressed on its own. Records stand in archive members of a package, and a package's
index member says which range of which member holds each record; members are stored, not compressed, so a record is a
range of the package file. A package is one file of the text sink (a row and its line break, which is the ZIP comment),
so it can be written to every store that Spark writes to, and a lost task is simply written again.

Of records with equal payloads of at least `least` bytes, that with the greatest key is the response and the others are
revisits that refer to it; smaller payloads are all responses. Payloads are told apart by SHA-1 and length. Equal keys with
equal payloads are all responses. The greatest key per payload is an aggregate; only payloads that occur twice or more are
joined back, with a salt, since one may be a third of all rows.

The reader knows a package by its path and length. It parses the end record (the ZIP64 one too) and the central directory,
finds the stored members and reads the index and the wanted records by range. Stores that only Spark reaches are read
through Spark's binary files instead; both ways take the same ranges of the same bytes.

Null and empty pages are empty payloads; a null key or address is a record without that header and comes back as null. Keys
come back as text. Blanks and control characters in an address are percent-encoded. Empty tables give no records, and empty
files hold none. Compressed members are listed but not read. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from hashlib import sha1
from typing import NamedTuple, Protocol

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import textkit

#: Bytes of records after which a member and a package are closed; a longer record has them to itself.
MEMBER, PACKAGE = 4 << 20, 16 << 20
SALTS = 16
# fixed values: names of the package's parts, the revisit profile, and signatures of ZIP records
ARCHIVES, INDEX = "archive/", "indexes/index.jsonl"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
WIDE = 0xFFFFFFFF


# writing


def deduplicated(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """(key, url, payload, digest, first): `first` is the key of the response that a revisit refers to, else null."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int"))
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = groups.select("digest", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.join(salted, ["digest", "size", "salt"], "left")
    return joined.select("key", "url", "payload", "digest", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def record_id(key: str | None, digest: bytes) -> str:
    h = sha1(f"{key}:".encode() + digest).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def warc_record(key: str | None, url: str | None, payload: bytes, digest: bytes, first: str | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if first is None else head
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if key is not None:
        fields.append(("Page-Key", json.dumps(key)))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("Refers-To-Key", json.dumps(first))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class Package:
    """Collects compressed records into archive members with an index."""

    def __init__(self):
        self.members: list[io.BytesIO] = []
        self.lines: list[str] = []
        self.size = 0

    def add(self, record: bytes, kind: str, key: str | None, url: str | None) -> None:
        if not self.members or self.members[-1].tell() >= MEMBER:
            self.members.append(io.BytesIO())
        packer = zlib.compressobj(3, wbits=31)
        packed = packer.compress(record) + packer.flush()
        name = f"{ARCHIVES}{len(self.members):04d}.warc.gz"
        self.lines.append(json.dumps({"member": name, "offset": self.members[-1].tell(), "length": len(packed), "type": kind, "key": key, "url": url}))
        self.members[-1].write(packed)
        self.size += len(packed)

    def close(self) -> bytes:
        """The file's bytes but for its last, the line break that the sink adds."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, strict_timestamps=False) as z:
            for k, member in enumerate(self.members, 1):
                z.writestr(zipfile.ZipInfo(f"{ARCHIVES}{k:04d}.warc.gz"), member.getbuffer())
            z.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
            z.comment = b"\n"
        return out.getvalue()[:-1]


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write all pages as packages into a new folder."""
    textkit.bounded_batches(pages.sparkSession)
    rows = deduplicated(pages, key, url, html, least)
    rows = rows.select(F.col("key").cast("string"), "url", "payload", "digest", F.col("first").cast("string"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = Package()
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                package.add(warc_record(*row, date), "response" if row[4] is None else "revisit", row[0], row[1])
                if package.size >= PACKAGE:
                    yield pa.RecordBatch.from_arrays([pa.array([package.close()], pa.binary())], names=["package"])
                    package = Package()
        if package.lines:
            yield pa.RecordBatch.from_arrays([pa.array([package.close()], pa.binary())], names=["package"])

    # the sink writes a string's bytes as they are
    packages = rows.mapInArrow(pack, "package binary").select(F.col("package").cast("string"))
    packages.write.option("maxRecordsPerFile", 1).text(path)


# reading


class Ranges(Protocol):
    def read_at(self, n: int, at: int) -> bytes: ...


class Held:
    """Ranges of bytes that are already here."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)

    def read_at(self, n: int, at: int) -> bytes:
        return bytes(self.data[at : at + n])


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int  # where the local header begins


def directory(file: Ranges, length: int) -> list[Member]:
    """The members of a ZIP file by its central directory, with ZIP64 fields where they are used, and with the shift of
    all offsets if something was put before the file."""
    if not length:
        return []
    reach = min(length, 22 + 65535)
    tail = file.read_at(reach, length - reach)
    at = len(tail)
    while True:
        at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        # a signature inside the comment is told by the comment's length
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    ends = length - reach + at
    if ends >= 20:
        locator = file.read_at(20, ends - 20)
        if locator[:4] == LOCATOR64:
            # where the locator says, or, if something stands before the file, right before the locator
            for at in (struct.unpack_from("<Q", locator, 8)[0], ends - 20 - 56):
                record = file.read_at(56, at) if 0 <= at <= length - 56 else b""
                if record[:4] == END64:
                    count, size, offset = struct.unpack_from("<QQQ", record, 32)
                    ends = at
                    break
            else:
                if count == 0xFFFF or WIDE in (size, offset):
                    raise ValueError("no ZIP64 end of the central directory")
    shift = ends - size - offset
    central = file.read_at(size, offset + shift)
    members, p = [], 0
    for _ in range(count):
        if central[p : p + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", central, p + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", central, p + 20)
        header = struct.unpack_from("<I", central, p + 42)[0]
        name = central[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        extra = central[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # 64-bit values of the fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain = next(wide) if plain == WIDE else plain
                packed = next(wide) if packed == WIDE else packed
                header = next(wide) if header == WIDE else header
            q += 4 + n
        members.append(Member(name, method, packed, header + shift))
        p += 46 + n_name + n_extra + n_comment
    return members


def begins(file: Ranges, member: Member) -> int:
    """Where a member's bytes begin: behind its local header, whose lengths may differ from the directory's."""
    local = file.read_at(30, member.header)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def index_of(file: Ranges, length: int) -> list[dict]:
    """The lines of a package's stored index members, each with `start`, its record's place in the file."""
    members = {m.name: m for m in directory(file, length) if m.method == 0}
    starts = {m.name: begins(file, m) for m in members.values() if m.name.startswith(ARCHIVES)}
    lines = []
    for name, m in members.items():
        if name.startswith("indexes/"):
            for line in file.read_at(m.size, begins(file, m)).decode().splitlines():
                entry = json.loads(line)
                if entry["member"] in starts:
                    lines.append(entry | {"start": starts[entry["member"]] + entry["offset"]})
    return lines


def head_fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse_record(packed: bytes) -> dict:
    """A record's fields; for a response the digest and length are those of the payload that was read."""
    raw = zlib.decompress(packed, wbits=31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = head_fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(head_fields(http)["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    own = stated if revisit else sha1(payload).hexdigest()
    return {
        "key": json.loads(fields.get("Page-Key", "null")), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload": None if revisit else payload,
        "payload_bytes": size if revisit else len(payload), "payload_digest": own, "refers_to": json.loads(fields.get("Refers-To-Key", "null")),
        "intact": own == stated and (revisit or size == len(payload)),
    }


def reachable(path: str) -> bool:
    """Can tasks open this store by themselves?"""
    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError, ImportError):
        return False
    return True


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content): content is null where tasks read ranges themselves."""
    files = spark.read.format("binaryFile").load(path)
    known = files.select("path", "length")
    first = known.limit(1).collect()
    by_range = not first or reachable(first[0]["path"])
    return known.withColumn("content", F.lit(None).cast("binary")) if by_range else files.select("path", "length", "content")


def opened(path: str, content: bytes | None) -> Ranges:
    if content is not None:
        return Held(content)
    store, place = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


ENTRY = {"path": pa.string(), "start": pa.int64(), "length": pa.int64(), "member": pa.string(), "type": pa.string(), "key": pa.string(), "url": pa.string()}
RECORD = {
    "key": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "refers_to": pa.string(), "intact": pa.bool_(),
}
ENTRY_DDL = "path string, start long, length long, member string, type string, key string, url string"
RECORD_DDL = "key string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, intact boolean"


def batches_of(rows: Iterator[dict], kinds: dict[str, pa.DataType], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about so many bytes of payload."""
    held: list[dict] = []
    n = 0
    schema = pa.schema(list(kinds.items()))
    for row in rows:
        held.append(row)
        n += 200 + len(row.get("payload") or b"")
        if n >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, length, member, type, key, url): every indexed record and its range, without reading records."""
    textkit.bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for package in batch.to_pylist():
                    for e in index_of(opened(package["path"], package["content"]), package["length"]):
                        yield {c: e.get(c) for c in ENTRY} | {"path": package["path"]}

        yield from batches_of(rows(), ENTRY)

    return packages(spark, path).mapInArrow(run, ENTRY_DDL)


def fetch(wanted: DataFrame) -> DataFrame:
    """Records of chosen entries, by range, from stores that tasks reach."""
    textkit.bounded_batches(wanted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            path, file = None, None
            for batch in batches:
                for e in batch.to_pylist():
                    if e["path"] != path:
                        path, file = e["path"], opened(e["path"], None)
                    yield parse_record(file.read_at(e["length"], e["start"]))

        yield from batches_of(rows(), RECORD)

    return wanted.select("path", "start", "length").mapInArrow(run, RECORD_DDL)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every indexed record of the packages in a folder."""
    textkit.bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for package in batch.to_pylist():
                    file = opened(package["path"], package["content"])
                    for e in index_of(file, package["length"]):
                        yield parse_record(file.read_at(e["length"], e["start"]))

        yield from batches_of(rows(), RECORD)

    return packages(spark, path).mapInArrow(run, RECORD_DDL)
