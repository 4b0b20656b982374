"""Legacy web archives (ARC) and their conversion to WARC.

An ARC file opens with a version block that names its record layout: version 1
has five header fields, version 2 ten. Every record is a header line, as many
bytes as it declares, and a line feed. The converter reads both layouts and
writes WARC records with what ARC lacks: record identifiers, ISO timestamps,
record types and payload digests. Of records with equal payloads one is a
response, the others are revisits that refer to it.

Files are bounded in size, one Spark row each while read or written, and gzipped
as a whole by Spark's writer. A null html is an empty payload, a null url a blank
one, a null page_id leaves its header out; repeated rows are repeated records.
An empty table gives archives without records.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_folder
from .common import read_files, staged, write_files

FILE_BYTES = 8 << 20  # a file is closed once it holds as many
FIELDS = {  # fixed values of the format: the header fields of each version
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_HEADER = "X-Page-Id"
HEAD_END = b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- ARC ----


def arc_opening(name: str, version: int, date: str) -> bytes:
    """The version block of a file."""
    body = f"{version} 0 archive\n{FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(url: str, date: str, block: bytes, version: int, name: str, offset: int) -> bytes:
    fields = [quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") or "-", "0.0.0.0", date, "text/html"]
    if version == 2:
        fields += ["200", hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_records(data: bytes):
    """Yield (offset, header fields by name, block) of every record after the version block.

    The name that the version block gives the file is added as the field ``File``.
    """
    at, fields, name = 0, FIELDS[1].split(" "), ""
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # blank lines between records
            at += 1
            continue
        line_end = data.index(b"\n", at)
        line = data[at:line_end].decode("utf-8", "replace").rstrip("\r")
        opening = line.startswith("filedesc://")
        # the count of fields of the opening line itself tells its version
        count = (10 if len(line.split(" ")) >= 10 else 5) if opening else len(fields)
        parts = line.rsplit(" ", count - 1)
        if len(parts) != count or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:80]!r}")
        start = line_end + 1
        block = data[start : start + int(parts[-1])]
        if len(block) != int(parts[-1]):
            raise ValueError(f"the record at byte {at} is cut short")
        if opening:
            fields = block.split(b"\n")[1].decode().split(" ")
            name = parts[0].removeprefix("filedesc://")
        else:
            yield at, dict(zip(fields, parts), File=name), block
        at = start + len(block)


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a stored HTTP response; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(HEAD_END)
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", file_bytes: int = FILE_BYTES) -> None:
    """Pages as gzipped ARC files, versions 1 and 2 in turn."""

    def files(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()

        def file(number):
            version = 1 + (partition + number) % 2
            name = f"pages-{partition:05d}-{number:05d}.arc"
            return version, name, [arc_opening(name, version, date)]

        def row(parts):
            # the writer ends the row, and so the last record, with the line feed
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["content"])

        number, any_ = 0, False
        version, name, parts = file(number)
        held = len(parts[0])
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html = (batch.column(k)[i].as_py() for k in range(3))
                payload = (html or "").encode()
                own = "" if page_id is None else f"{PAGE_HEADER}: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}"
                parts.append(arc_record(url or "", date, head.encode() + HEAD_END + payload, version, name, held))
                held, any_ = held + len(parts[-1]), True
                if held >= file_bytes:
                    yield row(parts)
                    number, any_ = number + 1, False
                    version, name, parts = file(number)
                    held = len(parts[0])
        if any_:
            yield row(parts)

    rows = pages.select("page_id", "url", "html").mapInArrow(files, "content binary")
    write_files(rows, path, "gzip", per_file=1)


# ---- WARC ----


def record_id(fields: dict, place: int, page: str) -> str:
    """The same record always gets the same identifier."""
    known = f"{fields['File']} {place} {fields['Archive-date']} {page} {fields['URL']}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, known)}>"


def warc_date(date: str) -> str:
    return datetime.datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(data: bytes):
    """Yield (headers by lower-case name, block) of every record."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        head_end = data.index(HEAD_END, at)
        lines = data[at:head_end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = head_end + 4
        at = start + int(headers["content-length"])
        yield headers, data[start:at]


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_revisit: int = 0) -> None:
    """Convert a folder of ARC files to one of WARC files.

    Of records with equal payloads of at least ``least_revisit`` bytes the one
    with the largest page id (by place where equal or missing) stays a response.
    """

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for at, fields, block in arc_records(gzip.decompress(content.as_py())):
                    headers, payload = http_parts(block)
                    page = headers.get(PAGE_HEADER.lower(), "")
                    digest, own = sha1_base32(payload), record_id(fields, at, page)
                    rows.append((path.as_py(), at, int(page) if page else None, len(payload), digest, own))
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["path", "place", "page_id", "size", "digest", "record_id"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    records = staged(
        read_files(spark, arc_path).mapInArrow(
            listed, "path string, place long, page_id long, size long, digest string, record_id string"
        ),
        "arc-records",
    )
    first = (
        records.filter(F.col("size") >= least_revisit)
        .groupBy("digest", "size")
        .agg(F.max(F.struct("page_id", "record_id")).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )
    revisits = (
        records.join(first, ["digest", "size"])
        .filter("first.record_id != record_id")
        .groupBy("path")
        .agg(F.collect_list(F.struct("place", F.col("first.page_id").alias("page"), F.col("first.record_id").alias("record"))).alias("revisits"))
    )  # a file's records, so bounded by the size of a file

    def converted(batches):
        import pyarrow as pa

        for batch in batches:
            for content, found in zip(batch.column(1), batch.column(2)):
                refers = {x["place"]: x for x in found.as_py() or []}
                out = []
                for at, fields, block in arc_records(gzip.decompress(content.as_py())):
                    headers, payload = http_parts(block)
                    page = headers.get(PAGE_HEADER.lower(), "")
                    revisit = at in refers
                    known = [
                        ("WARC-Type", "revisit" if revisit else "response"),
                        ("WARC-Record-ID", record_id(fields, at, page)),
                        ("WARC-Date", warc_date(fields["Archive-date"])),
                        ("WARC-Target-URI", fields["URL"]),
                        ("WARC-IP-Address", fields["IP-address"]),
                        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
                        ("Content-Type", "application/http; msgtype=response"),
                        ("X-Payload-Length", str(len(payload))),
                    ]
                    if page:
                        known.append((PAGE_HEADER, page))
                    if revisit:
                        known.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                        known.append(("WARC-Refers-To", refers[at]["record"]))
                        if refers[at]["page"] is not None:
                            known.append(("X-Refers-To-Page-Id", str(refers[at]["page"])))
                        block = block[: len(block) - len(payload)]
                    out.append(warc_record(known, block))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["content"])

    files = read_files(spark, arc_path).join(revisits, "path", "left")
    write_files(files.mapInArrow(converted, "content binary"), warc_path, "gzip", per_file=1)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder of WARC files; a response whose payload does not match its digest is an error."""

    def records(batches):
        import pyarrow as pa

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in warc_records(gzip.decompress(content.as_py())):
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(headers["x-payload-length"])
                    if headers["warc-type"] == "response":
                        payload = http_parts(block)[1]
                        if len(payload) != size or sha1_base32(payload) != digest:
                            raise ValueError(f"{headers['warc-record-id']} does not match its digest")
                    page, refers = headers.get(PAGE_HEADER.lower()), headers.get("x-refers-to-page-id")
                    rows.append(
                        (
                            page and int(page), headers["warc-target-uri"], size, digest, headers["warc-type"],
                            refers and int(refers), headers["warc-record-id"], headers["warc-date"],
                        )
                    )
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return read_files(spark, path).mapInArrow(
        records,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, record_id string, date string",
    )


def archive_pages(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Write pages as ARC, convert to WARC, and return the records read back."""
    spark = pages.sparkSession
    arc, warc = run_folder(spark, "arc"), run_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least_revisit)
    return read_warc(spark, warc)
