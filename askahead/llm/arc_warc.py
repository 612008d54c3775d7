"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a version block; its version line tells which header line every record has. Version 1 lines hold
url, address, date, type and length, version 2 lines also result code, checksum, location, offset and file name. The
declared length, not any separator, ends a record. A response record's block is an HTTP response, whose body is the
payload. The converter synthesises what WARC has beyond that: record ids (name-based, so a repeated conversion gives the
same), dates in ISO form, record types and payload digests.

Records of both kinds are gzip members of their own. Files are listed by the tasks that finished them, and one WARC file
is written per ARC file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm.common import fresh_path, read_file, stored, write_file
from askahead.operators.codesets import numbered

# Field names of ARC header lines by version, as the version block states them.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD, REFERS_FIELD = "X-Page-Id", "X-Refers-To-Page-Id"
FILE_BYTES = 16 << 20
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
_READ = 1 << 15
_CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=1, mtime=0)


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a file."""
    view, at = memoryview(data), 0
    while at < len(data):
        unzip, out, end = zlib.decompressobj(wbits=31), [], at
        while not unzip.eof:
            if end >= len(data):
                raise ValueError(f"gzip member at {at} is cut off")
            out.append(unzip.decompress(view[end : end + _READ]))
            end += _READ
        yield at, b"".join(out)
        at = min(end, len(data)) - len(unzip.unused_data)


def url_field(url: str | None) -> str:
    """A URL as one field of a header line: no white space or control characters; ``-`` where there is none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


def arc_version_block(name: str, version: int, date: str) -> bytes:
    """The record that opens an ARC file."""
    body = f"{version} 0 converter\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {
        "URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
        "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name,
        "Archive-length": str(len(body)),
    }
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, page_id: int | None, html: bytes) -> bytes:
    """One response record; the page's number travels as an HTTP header."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(html)}".encode()]
    if page_id is not None:
        head.append(f"{PAGE_FIELD}: {page_id}".encode())
    block = _CRLF.join(head) + _CRLF * 2 + html
    values = {
        "URL": url_field(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
        "Result-code": "200", "Checksum": hashlib.md5(html).hexdigest(), "Location": "-", "Offset": str(offset),
        "Filename": name, "Archive-length": str(len(block)),
    }
    return b"\n" + " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


@dataclass
class ArcRecord:
    """A parsed record: its place, the fields of its header line and its block of the declared length."""

    offset: int
    fields: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[bytes, dict[str, str], bytes]:
        """(HTTP header lines, header fields, payload)."""
        head, _, payload = self.block.partition(_CRLF * 2)
        pairs = (line.partition(b":") for line in head.split(_CRLF)[1:])
        return head, {k.strip().decode().lower(): v.strip().decode() for k, _, v in pairs}, payload


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block of a gzipped ARC file, by the header line of the file's version."""
    names: list[str] = []
    for offset, content in members(data):
        content = content.lstrip(b"\n")
        line, _, rest = content.partition(b"\n")
        values = line.decode("utf-8", "replace").split(" ")
        if not names:
            version, _, described = rest.partition(b"\n")
            names = described.partition(b"\n")[0].decode().split(" ")
            if names != ARC_FIELDS.get(int(version.split(b" ")[0])) or len(values) != len(names):
                raise ValueError(f"unknown ARC version line {version!r}")
            continue
        if len(values) != len(names):
            raise ValueError(f"header line with {len(values)} fields at {offset}")
        fields = dict(zip(names, values, strict=True))
        length = int(fields["Archive-length"])
        if len(rest) < length:
            raise ValueError(f"record at {offset} is shorter than declared")
        yield ArcRecord(offset, fields, rest[:length])


def iso_date(date: str) -> str:
    """A 14-digit ARC date (or a shorter one, filled up) in the form WARC uses."""
    full = date + "00000101000000"[len(date) :] if len(date) < 14 else date
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(url: str, page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {url}')}>"


def _warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in [*fields, ("Content-Length", str(len(block)))])]
    return _CRLF.join(lines) + _CRLF * 2 + block + _CRLF * 2


def warc_info(name: str) -> bytes:
    fields = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
    ]
    return _warc_record(fields, b"format: WARC File Format 1.1\r\nsoftware: arc converter\r\n")


def warc_of(record: ArcRecord, refers: dict | None) -> bytes:
    """The WARC record that an ARC record becomes: a response, or a revisit of the response in ``refers``."""
    head, http, payload = record.http
    url, page = record.fields["URL"], http.get(PAGE_FIELD.lower(), "")
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id(url, page)),
        ("WARC-Date", iso_date(record.fields["Archive-date"])),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", record.fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if not refers:
        return _warc_record(fields, record.block)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers["url"], refers["page"]))]
    fields.append(("WARC-Refers-To-Target-URI", refers["url"]))
    if refers["page"]:
        fields.append((REFERS_FIELD, refers["page"]))
    return _warc_record(fields, head + _CRLF * 2)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a gzipped WARC file."""
    for offset, content in members(data):
        head, _, rest = content.partition(_CRLF * 2)
        first, *lines = head.split(_CRLF)
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        fields = {k.strip(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines)}
        length = int(fields["Content-Length"])
        if len(rest) < length:
            raise ValueError(f"record at {offset} is shorter than declared")
        yield fields, rest[:length]


def _write_arcs(folder: str, version: int | None, date: str, file_bytes: int):
    """Pages to ARC files of about ``file_bytes``; without a version, files of both alternate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, count
            parts = held
            name, _ = write_file(folder, f"pages-{task:06d}-{count:06d}", ".arc.gz", lambda out: out.writelines(parts))
            held, size, count = [], 0, count + 1
            return pa.RecordBatch.from_pydict({"file": [name]})

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = version or 1 + (task + count) % 2
                title = f"pages-{task:06d}-{count:06d}.arc.gz"
                if not held:
                    held.append(_member(arc_version_block(title, kind, date)))
                    size = len(held[0])
                held.append(_member(arc_record(kind, title, size, url, date, page_id, html or b"")))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def write_arcs(
    pages: DataFrame,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    version: int | None = None,
    date: str = "20200101000000",
    file_bytes: int = FILE_BYTES,
) -> tuple[str, DataFrame]:
    """Write pages as legacy ARC files; returns their folder and the table of file names."""
    folder = fresh_path(pages.sparkSession, "arc")
    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url).cast("string"), F.col(html).cast("binary"))
    files = rows.mapInArrow(_write_arcs(folder, version, date, file_bytes), "file string")
    return folder, stored(files, "arc_files")


_INDEX = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
     ("digest", pa.string()), ("payload_bytes", pa.int64())]
)


def _index_arcs(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for record in parse_arc(read_file(folder, file)):
                    _, http, payload = record.http
                    page = http.get(PAGE_FIELD.lower())
                    rows.append((file, record.offset, int(page) if page else None, record.fields["URL"],
                                 payload_digest(payload), len(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX
                    )

    return run


def _convert(arc_folder: str, warc_folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refers = {r["offset"]: r for r in revisits or []}
                stem = file.removesuffix(".arc.gz")
                data = read_file(arc_folder, file)

                def write(out, data=data, refers=refers, stem=stem) -> None:
                    out.write(_member(warc_info(f"{stem}.warc.gz")))
                    for record in parse_arc(data):
                        out.write(_member(warc_of(record, refers.get(record.offset))))

                name, _ = write_file(warc_folder, stem, ".warc.gz", write)
                yield pa.RecordBatch.from_pydict({"file": [name]})

    return run


def dealt(files: DataFrame) -> DataFrame:
    """The rows (file, ...) dealt in turn to as many tasks as shuffles have, or as there are files.

    Files are about equally large. They are dealt by a number, since a shuffle by name would be merged into few tasks: the
    names are small, the work behind them is not.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = numbered(files.select("file"), ["file"], "_n").select("file", (F.col("_n") % tasks).alias("_turn"))
    return files.join(turn, "file").repartitionByRange(tasks, "_turn").drop("_turn")


def convert(arc_folder: str, arc_files: DataFrame, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Convert ARC files to WARC files; returns their folder and the table of file names.

    Of records with equal payloads of at least ``min_bytes`` the one with the smallest page number is a response and the
    others revisit it; records without a number come last, ties go to the first by file and offset.
    """
    spark = arc_files.sparkSession
    folder = fresh_path(spark, "warc")
    index = stored(
        dealt(arc_files.select("file")).mapInArrow(
            _index_arcs(arc_folder),
            "file string, offset bigint, page_id bigint, url string, digest string, payload_bytes bigint",
        ),
        "arc_index",
    )
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "file", "offset", "url")
    firsts = (
        index.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    # A file's revisits are bounded by the file's size, so one row can hold them.
    revisits = (
        index.where(F.col("payload_bytes") >= min_bytes)
        .join(firsts, "digest")
        .where((F.col("first.file") != F.col("file")) | (F.col("first.offset") != F.col("offset")))
        .select(
            "file",
            F.struct(
                "offset",
                F.coalesce(F.col("first.page_id").cast("string"), F.lit("")).alias("page"),
                F.col("first.url").alias("url"),
            ).alias("r"),
        )
        .groupBy("file")
        .agg(F.collect_list("r").alias("revisits"))
    )
    work = dealt(arc_files.join(revisits, "file", "left").select("file", "revisits"))
    return folder, stored(work.mapInArrow(_convert(arc_folder, folder), "file string"), "warc_files")


_PAGES = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _read_warcs(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for fields, block in parse_warc(read_file(folder, file)):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    _, http, payload = ArcRecord(0, {}, block).http
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    page, refers = http.get(PAGE_FIELD.lower()), fields.get(REFERS_FIELD)
                    rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES, strict=True)], schema=_PAGES
                    )

    return run


def read_warcs(folder: str, files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit record.

    The payload's size and digest are those of the full payload also for revisits, which hold only its HTTP headers.
    """
    return dealt(files.select("file")).mapInArrow(
        _read_warcs(folder),
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    )


def pages_through_warc(pages: DataFrame, min_bytes: int = 0, **options) -> DataFrame:
    """Pages written as ARC files, converted to WARC files and read back.

    Null html is an empty payload, null urls are written as ``-``. Repeated rows give a record each; equal page numbers
    with equal payloads have one response, whose number the others refer to. Records without a page number are told apart
    by place. Other columns are ignored; an empty table gives an empty one.
    """
    arc_folder, arcs = write_arcs(pages, **options)
    return read_warcs(*convert(arc_folder, arcs, min_bytes))
