"""WARC archives packaged in ZIP files: writing, and reading by ranges.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, in which every
record is a gzip member of its own, and ``indexes/index.cdxj``, which says where each
record begins.  A reader needs the end of the file for the directory, the index, and
then the ranges of the records it wants; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.store import Scratch

DATA = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
#: Packages are closed at about this size; records are read in runs of about this size.
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20

# Signatures and layouts of the ZIP format (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_LAYOUT, CENTRAL_LAYOUT = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I")
END_LAYOUT, END64_LAYOUT = struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q")
LOCATOR_LAYOUT = struct.Struct("<4sIQI")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Member:
    name: str
    offset: int  # of the member's data
    size: int
    stored: bool


class PackageWriter:
    """A ZIP file of stored members written front to back.

    Sizes are not known when a member begins, so its local header announces a data
    descriptor; ZIP64 records are written where a number needs them, or always with
    ``zip64``.
    """

    def __init__(self, stream, zip64: bool = False):
        self.stream, self.zip64 = stream, zip64
        self.at, self.entries = 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header, self.crc, self.size = name.encode(), self.at, 0, 0
        self._put(LOCAL_LAYOUT.pack(LOCAL, 45, 8 | 1 << 11, 0, 0, 0x21, 0, 0, 0, len(self.name), 0))
        self._put(self.name)

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)

    def finish(self) -> None:
        wide = self.zip64 or self.size >= FULL32
        self._put(struct.pack("<4sI2Q" if wide else "<4s3I", b"PK\x07\x08", self.crc, self.size, self.size))
        self.entries.append((self.name, self.crc, self.size, self.header))

    def close(self) -> None:
        start = self.at
        for name, crc, size, header in self.entries:
            extra = b""
            wide_size, wide_at = self.zip64 or size >= FULL32, self.zip64 or header >= FULL32
            if wide_size or wide_at:
                body = struct.pack("<2Q", size, size) * wide_size + struct.pack("<Q", header) * wide_at
                extra = struct.pack("<2H", 1, len(body)) + body
            shown = FULL32 if wide_size else size
            self._put(CENTRAL_LAYOUT.pack(CENTRAL, 45, 45, 8 | 1 << 11, 0, 0, 0x21, crc, shown, shown, len(name), len(extra), 0, 0, 0, 0, FULL32 if wide_at else header))
            self._put(name + extra)
        n, size, end = len(self.entries), self.at - start, self.at
        wide = self.zip64 or end >= FULL32 or n >= FULL16
        if wide:
            self._put(END64_LAYOUT.pack(END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(LOCATOR_LAYOUT.pack(LOCATOR, 0, end, 1))
        shown = (FULL16, FULL16, FULL32, FULL32) if wide else (n, n, size, start)
        self._put(END_LAYOUT.pack(END, 0, 0, *shown, 0))


def members(file, size: int) -> list[Member]:
    """The directory of a ZIP file, from its last bytes; any comment and ZIP64 included."""
    tail_at = max(0, size - END_LAYOUT.size - LOCATOR_LAYOUT.size - FULL16)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (
        len(tail) - at < END_LAYOUT.size
        or at + END_LAYOUT.size + END_LAYOUT.unpack_from(tail, at)[7] != len(tail)
    ):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    *_, n, length, start, _ = END_LAYOUT.unpack_from(tail, at)
    locator = at - LOCATOR_LAYOUT.size
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR:
        file.seek(LOCATOR_LAYOUT.unpack_from(tail, locator)[2])
        _, _, _, _, _, _, _, n, length, start = END64_LAYOUT.unpack(file.read(END64_LAYOUT.size))
    file.seek(start)
    directory = file.read(length)
    out, at = [], 0
    for _ in range(n):
        entry = CENTRAL_LAYOUT.unpack_from(directory, at)
        method, packed, whole, name_n, extra_n, note_n, header = entry[4], *entry[8:13], entry[16]
        at += CENTRAL_LAYOUT.size
        name = directory[at : at + name_n].decode()
        extra = directory[at + name_n : at + name_n + extra_n]
        at += name_n + extra_n + note_n
        while len(extra) >= 4:
            kind, n_bytes = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n_bytes // 8}Q", extra, 4))
                whole = wide.pop(0) if whole == FULL32 else whole
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            extra = extra[4 + n_bytes :]
        file.seek(header)
        local = LOCAL_LAYOUT.unpack(file.read(LOCAL_LAYOUT.size))
        data = header + LOCAL_LAYOUT.size + local[9] + local[10]
        out.append(Member(name, data, packed, method == 0))
    return out


def warc_record(kind: str, page_id, url: str, refers_to, payload: bytes, digest: str) -> bytes:
    """One record.  A revisit repeats the HTTP head, with the length of the payload that
    it leaves out."""
    named = "" if page_id is None else page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{named}>",
        f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        other = "" if refers_to is None else refers_to
        lines += [f"WARC-Refers-To: <urn:page:{other}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, fields_of(http), payload


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, kind, refers_to`` per page.

    Of pages with equal payloads of at least ``min_bytes``, the one with the largest
    page_id is the response (of rows that share it, one), the others revisit it; smaller
    ones are all responses.
    """
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"), payload.alias("payload"),
        F.unhex(F.sha1(payload)).alias("sha"), F.monotonically_increasing_id().alias("at"),
    )
    # the last in order of page_id and place; a partial maximum runs before the exchange
    last = F.max(F.struct("page_id", "at")).alias("last")
    chosen = rows.groupBy(F.col("sha").alias("_sha")).agg(last)
    joined = rows.join(chosen, F.col("sha") == F.col("_sha"))
    large = F.octet_length("payload") >= min_bytes
    first = ~large | (F.col("at") == F.col("last.at"))
    return joined.select(
        "page_id", "url", "payload", "sha",
        F.when(first, "response").otherwise("revisit").alias("kind"),
        F.when(~first, F.col("last.page_id")).alias("refers_to"),
    )


def write_packages(
    plan: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False
) -> DataFrame:
    """Write the planned records into packages under ``folder``; ``path, size`` of each.

    Each task writes its own files; a file is named after the task's partition and try,
    and only those that the result names count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = open_fs(folder)
        system.create_dir(root, recursive=True)
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        done, stream = [], None

        def close() -> None:
            package.finish()
            package.begin(INDEX)
            package.write("".join(index).encode())
            package.finish()
            package.close()
            stream.close()
            done.append((path, package.at))

        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    path = f"{root}/{name}-{len(done):05d}.wacz"
                    stream = system.open_output_stream(path)
                    package, index = PackageWriter(stream, zip64), []
                    package.begin(DATA)
                digest = base64.b32encode(row["sha"]).decode()
                url = "".join(row["url"].split())
                record = warc_record(
                    row["kind"], row["page_id"], url, row["refers_to"], row["payload"], digest
                )
                squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = squeeze.compress(record) + squeeze.flush()
                entry = {"offset": package.size, "length": len(data), "digest": f"sha1:{digest}", "filename": DATA}
                index.append(f"{url or '-'} 19700101000000 {json.dumps(entry)}\n")
                package.write(data)
                if package.size >= package_bytes:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
            ["path", "size"],
        )

    return plan.mapInArrow(run, "path string, size long")


def read_index(packages: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, start, lengths``: runs of neighbouring records in the archive member of each
    package, found from its directory and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as file:
                    found = {m.name: m for m in members(file, row["size"])}
                    data, index = found[DATA], found[INDEX]
                    if not (data.stored and index.stored):
                        raise ValueError(f"{row['path']}: members must be stored")
                    file.seek(index.offset)
                    lines = file.read(index.size).decode().splitlines()
                places = [json.loads(x.split(" ", 2)[2]) for x in lines]
                runs: list[tuple[int, list[int]]] = []
                for p in sorted(places, key=lambda p: p["offset"]):
                    at = data.offset + p["offset"]
                    if runs and runs[-1][0] + sum(runs[-1][1]) == at and at - runs[-1][0] < range_bytes:
                        runs[-1][1].append(p["length"])
                    else:
                        runs.append((at, [p["length"]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["path"]] * len(runs)), pa.array([a for a, _ in runs], pa.int64()),
                        pa.array([n for _, n in runs], pa.list_(pa.int64())),
                    ],
                    ["path", "start", "lengths"],
                )

    return packages.mapInArrow(run, "path string, start long, lengths array<long>")


def read_records(ranges: DataFrame, folder: str) -> DataFrame:
    """``record_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``
    of every record in the ranges; a response's digest is checked against its payload,
    a revisit has none of its own."""
    names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as file:
                    file.seek(row["start"])
                    data = file.read(sum(row["lengths"]))
                rows, at = [], 0
                for n in row["lengths"]:
                    fields, http, payload = parse_record(zlib.decompress(data[at : at + n], 31))
                    at += n
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"{row['path']}: a payload does not match its digest")
                    rows.append((
                        fields["warc-record-id"], fields["warc-target-uri"], kind, fields.get("warc-refers-to"),
                        int(http["content-length"]), digest, payload if kind == "response" else None,
                    ))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names
                )

    schema = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return ranges.mapInArrow(run, schema)


def page_of(record_id: Column) -> Column:
    """The page_id in a record id; null where the page had none."""
    digits = F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*)>$", 1)
    return F.nullif(digits, F.lit("")).cast("long")


def round_trip(pages: DataFrame, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write every page as a record, read all records back: ``page_id, url, record_type,
    refers_to, payload_bytes, payload_digest, payload``.

    A null html is an empty payload, a null url an empty one; a null page_id comes back
    null, also as what a revisit refers to; white space in a url is left out.  Repeated rows are records of their own.  An
    empty table gives no package and an empty result.  Only page_id, url and html are
    read.  The pages should be a stored table, whose rows keep their places.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("packages")
    written = scratch.keep(write_packages(planned(pages, min_bytes), folder, package_bytes, zip64), "written")
    ranges = scratch.keep(read_index(written, folder), "ranges")
    spread = ranges.repartition(max(1, ranges.count()), F.xxhash64("path", "start"))
    records = read_records(spread, folder)
    return records.select(
        page_of(F.col("record_id")).alias("page_id"), "url", "record_type",
        page_of(F.col("refers_to")).alias("refers_to"), "payload_bytes", "payload_digest", "payload",
    )
