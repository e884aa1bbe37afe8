"""Legacy archive converter: ARC files become WARC files.

An ARC file starts with a version block whose second line names the version, and each record has one header line: five fields in
version 1 (address, IP, date, type, length), ten in version 2 (result code, checksum, location, offset and file name in
between). The length declared there, not a search for the next header, gives the record's end. Addresses may hold blanks in bad archives, so
fields are taken from the right. Every record is a gzip member of its own.

The converter synthesises what WARC wants and ARC lacks: a record id (a version 8 UUID that carries the page number), the
date in ISO form, the type, block and payload digests. Of the records with equal payloads of at least 100 bytes the one with
the smallest page number is the response and the others are revisits that refer to it, with headers but no payload.

The work by steps: tasks write ARC files; their records' digests are grouped by digest (minimum per group, summed before the shuffle, so a
payload that makes up a third of all pages is harmless); decisions travel to the files by file, small rows only; tasks convert
file by file; Spark reads the WARC files back. Files hold at most FILE_BYTES of payload or one record.

Edge cases: a null or empty html is an empty payload and a response; a null address becomes "dns:unknown"; control characters and blanks
in addresses are percent-encoded; a null page number is a response of its own and stays null; rows that repeat a page number with
equal payload are all kept, each as what its number says; an empty table gives no rows. In archives from elsewhere a block that is no
HTTP response becomes a resource, header lines may be Latin-1 and end in bare line feeds, dates may be short, a record cut off by
the end of the file is kept as far as it goes and marked, and a record without a page number gets a negative one from file and place.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.shared import get_file, put_file, work_folder, written

FILE_BYTES = 8_000_000
LEAST_REVISIT = 100
SLICE = 1 << 14
#: Tasks that convert files; beyond that a task converts several.
MOST_TASKS = 20_000
#: Field lists of the two versions, fixed values of the format.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
DATE = "20240131120000"
HEAD_END = re.compile(rb"\r?\n\r?\n")


def member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=1, mtime=0)


def version_block(version: int, name: str) -> bytes:
    """The first record of an ARC file."""
    body = f"{version} 0 converter\n{FIELDS[version]}\n".encode()
    middle = {1: "", 2: f"200 - - 0 {name} "}[version]
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {middle}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, name: str, at: int, http: bytes) -> bytes:
    """One record of an ARC file; ``at`` is its offset there."""
    middle = {1: "", 2: f"200 {base64.b32encode(hashlib.sha1(http).digest()).decode()} - {at} {name} "}[version]
    return f"{url} 127.0.0.1 {DATE} text/html {middle}{len(http)}\n".encode() + http + b"\n"


def arc_entries(data: bytes):
    """(url, date, type, block, whether it is cut off) of each record of an uncompressed ARC file, by declared lengths."""
    at, version = 0, None
    while at < len(data):
        if data[at] == 0x0A:  # the separator behind a record
            at += 1
            continue
        stop = data.index(b"\n", at)
        line = text_of(data[at:stop]).rstrip("\r")
        fields = line.rsplit(" ", 4 if version in (None, 1) else 9)
        length = int(fields[-1])
        block = data[stop + 1:stop + 1 + length]
        at = stop + 1 + length
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        yield fields[0], fields[2], fields[3], block, len(block) < length


def arc_records(data: bytes):
    """(url, date, type, block) of each record; an error if the last one is cut off."""
    for *record, is_cut in arc_entries(data):
        if is_cut:
            raise ValueError("an ARC record is cut off")
        yield tuple(record)


def text_of(line: bytes) -> str:
    """A header line, which old archives hold in any encoding."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def unpacked(data: bytes) -> bytes:
    """All gzip members of a file, one after another; zero bytes and empty tails are allowed."""
    parts, view, at = [], memoryview(data), 0
    while at < len(view):
        d = zlib.decompressobj(31)
        while not d.eof and at < len(view):
            parts.append(d.decompress(view[at:at + SLICE]))
            at += SLICE
        # what follows the member within the last slice; slices keep the copy small however long the file is
        at = min(at, len(view)) - len(d.unused_data)
        parts.append(d.flush())
    return b"".join(parts)


def http_block(page_id, payload: bytes) -> bytes:
    number = "-" if page_id is None else page_id
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Number: {number}\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload


def http_parts(block: bytes) -> tuple[bytes, dict, bytes]:
    """(head with its empty line, headers, payload) of an HTTP response; lines may end in bare line feeds. A block that is no HTTP
    response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    found = HEAD_END.search(block)
    stop = found.end() if found else len(block)
    lines = block[:stop].decode("latin-1").replace("\r", "").split("\n")[1:]
    return block[:stop], dict(x.split(": ", 1) for x in lines if ": " in x), block[stop:]


def number_of(headers: dict, name: str, place: int) -> int | None:
    """The page number a record carries; of archives from elsewhere a negative one made from file and place."""
    number = headers.get("X-Page-Number")
    if number is None:
        return -1 - (int.from_bytes(hashlib.sha256(f"{name}/{place}".encode()).digest()[:8]) >> 2)
    return None if number == "-" else int(number)


def record_id(page_id, salt: str) -> str:
    """A version 8 UUID: for a numbered page 12 + 52 bits of its number, else a hash."""
    if page_id is None:
        return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(salt.encode()).digest()[:16], version=5)}"
    bits = page_id & (2**64 - 1)
    return f"urn:uuid:{uuid.UUID(int=0xFACADE000000 << 80 | 8 << 76 | (bits >> 52) << 64 | 2 << 62 | bits & (2**52 - 1))}"


def page_of(urn: str | None) -> int | None:
    """The page number in a record id, if there is one."""
    n = uuid.UUID(urn.removeprefix("urn:uuid:")).int if urn else 0
    if n >> 80 != 0xFACADE000000:
        return None
    bits = (n >> 64 & 0xFFF) << 52 | n & (2**52 - 1)
    return bits - 2**64 if bits >> 63 else bits


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(data: bytes):
    """(headers, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8").split("\r\n")[1:])
        n = int(headers["Content-Length"])
        yield headers, data[stop + 4:stop + 4 + n]
        at = stop + 4 + n + 4


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages as ARC files of either version in turn; a row (path) per file."""

    def run(batches):
        task, file, parts, size, at = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in batches:
            for page_id, url, html in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")]):
                version, name = file % 2 + 1, f"pages-{task:06d}-{file:05d}.arc"
                if not parts:
                    parts, size = [member(version_block(version, name))], 0
                    at = len(parts[0])
                where = "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "dns:unknown")
                http = http_block(page_id, (html or "").encode())
                parts.append(member(arc_record(version, where, name, at, http)))
                at += len(parts[-1])
                size += len(http)
                if size >= FILE_BYTES:
                    put_file(f"{folder}/{name}.gz", b"".join(parts))
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.gz"])], ["path"])
                    parts, file = [], file + 1
        if parts:
            name = f"pages-{task:06d}-{file:05d}.arc"
            put_file(f"{folder}/{name}.gz", b"".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.gz"])], ["path"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "path string")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, place, page_id, digest, n, http) of every ARC record."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                out, name = [], path.rsplit("/", 1)[1]
                for place, (_, _, _, block, _) in enumerate(arc_entries(unpacked(content.as_buffer()))):
                    head, headers, payload = http_parts(block)
                    out.append((path, place, number_of(headers, name, place), hashlib.sha256(payload).hexdigest(), len(payload), bool(head)))
                cols = list(zip(*out)) or [[]] * 6
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["path", "place", "page_id", "digest", "n", "http"])

    return _files(spark, folder).mapInArrow(run, "path string, place int, page_id long, digest string, n long, http boolean")


def _convert(decided: DataFrame, folder: str) -> DataFrame:
    """Convert each ARC file by its decisions: (path, records) where a record has its number, digest and the response's number."""

    def run(batches):
        for batch in batches:
            for path, known in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                name = path.rsplit("/", 1)[1].removesuffix(".gz").removesuffix(".arc") + ".warc.gz"
                info = b"software: framewright\r\nformat: WARC File Format 1.1\r\n"
                parts = [member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(None, name)}>"),
                                             ("WARC-Date", iso_date(DATE)), ("WARC-Filename", name),
                                             ("Content-Type", "application/warc-fields")], info))]
                for place, (url, date, kind, block, is_cut) in enumerate(arc_entries(unpacked(get_file(path)))):
                    number, first, digest = known[place]["page_id"], known[place]["first"], known[place]["digest"]
                    again = first is not None and first != number
                    kept = http_parts(block)[0] if again else block
                    is_http = known[place]["http"]
                    fields = [("WARC-Type", "revisit" if again else "response" if is_http else "resource"),
                              ("WARC-Record-ID", f"<{record_id(number, f'{name}/{place}')}>"), ("WARC-Date", iso_date(date)),
                              ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"),
                              ("Content-Type", "application/http; msgtype=response" if is_http else kind)]
                    if not is_http:  # the block is the payload
                        fields.append(("WARC-Block-Digest", f"sha256:{digest}"))
                    if is_cut:
                        fields.append(("WARC-Truncated", "unspecified"))
                    if again:
                        fields += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(kept).hexdigest()}"),
                                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                   ("WARC-Refers-To", f"<{record_id(first, '')}>")]
                    parts.append(member(warc_record(fields, kept)))
                put_file(f"{folder}/{name}", b"".join(parts))
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    return decided.mapInArrow(run, "path string")


def iso_date(digits: str) -> str:
    """The date of an ARC record (YYYYMMDDhhmmss, shorter ones from the front) in ISO form."""
    d = digits + "00000101000000"[len(digits):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page record of the WARC files of a folder."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for headers, block in warc_records(unpacked(content.as_buffer())):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    _, http, payload = http_parts(block)
                    size = int(http["Content-Length"]) if headers["WARC-Type"] == "revisit" else len(payload)
                    out.append((page_of(headers["WARC-Record-ID"].strip("<>")), size,
                                headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"],
                                page_of(headers.get("WARC-Refers-To", "").strip("<>"))))
                cols = list(zip(*out)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _files(spark, folder).mapInArrow(run, READ)


def convert(spark: SparkSession, arcs: str, warcs: str) -> DataFrame:
    """Convert all ARC files of a folder; a row (path) per WARC file."""
    records = written(_digests(spark, arcs), "arc-records")
    equal = records.where((F.col("n") >= LEAST_REVISIT) & F.col("page_id").isNotNull() & F.col("http"))
    firsts = equal.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
    known = records.join(firsts.where("times > 1").drop("times"), ["digest", "n"], "left")
    # one row per file, which holds a bounded number of records
    first = F.when(F.col("page_id").isNotNull() & F.col("http"), F.col("first")).alias("first")
    decided = known.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "page_id", first, "digest", "http"))).alias("records"))
    files = max(1, min(records.select("path").distinct().count(), MOST_TASKS))  # the rows are small, the files behind them not
    return written(_convert(decided.repartition(files, "path"), warcs), "warc-files")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as ARC, convert, and read every record back from the WARC files."""
    spark = pages.sparkSession
    arcs, warcs = work_folder(spark, "arcs"), work_folder(spark, "warcs")
    if not written(write_arcs(pages, arcs), "arc-files").take(1):
        return spark.createDataFrame([], READ)
    convert(spark, arcs, warcs)
    return read_warcs(spark, warcs)
