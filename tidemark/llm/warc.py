"""Web archives: legacy ARC records converted to WARC, written, and read back.

ARC.  A file begins with a ``filedesc://`` record that names its version; each record is a header line of the version's
fields (version 1: URL, address, date, type, length; version 2 puts result code, checksum, location, offset and file name
before the length) and as many bytes as declared.  The converter reads the line by its version and the declared length, and
makes the WARC record: an identifier derived from the record, the 14-digit date in ISO form, the type (``response`` for HTTP
content, ``resource`` for other), and block and payload digests (SHA-1 in base 32).

Repeats.  Of records with equal payloads the one with the largest id is the response; the others become ``revisit`` records,
which hold the HTTP header only and refer to it.  Which is which comes from an aggregate of digests; payloads take part in
one join on their (id, digest) and are never gathered by digest.

Tasks write files under names of their own attempt into the shared folder, and only accepted attempts are in the manifest.

Nulls: a null payload is the empty one; a null URL becomes ``urn:page:<id>``; a null id is smaller than every other.  Rows that
share both id and payload are all of one kind.  A URL that begins with ``filedesc://`` gets a ``urn:`` ahead of it.  Very long
payloads go through whole, in one task each.  Empty tables give no archives.  Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, opened_store, partitions, shared_dir, stored, tune

# The fields of the header lines by version, as the format has them.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes

    @property
    def url(self) -> str:
        return self.fields["url"]


def arc_bytes(url: str, date: str, kind: str, content: bytes, version: int = 1, ip: str = "0.0.0.0") -> bytes:
    """A record in a version's form."""
    values = {"url": url, "ip": ip, "date": date, "type": kind, "code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "-", "length": str(len(content))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + content + b"\n"


def arc_file_head(name: str, date: str, version: int = 1) -> bytes:
    """The first record of a file, which names the version and its fields."""
    own = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 tidemark\n{own[version]}\n".encode()
    return arc_bytes(f"filedesc://{name}", date, "text/plain", body, version)


def parse_arc(stream, version: int | None = None, refused: list[str] | None = None) -> Iterator[ArcRecord]:
    """The records of a stream.  The version comes from the file's first record unless it is given.

    A header line with the fields of another version, or a length that the stream falls short of, is refused: it raises, or
    goes to the list ``refused``, one entry for each stretch of bytes without a header, and reading goes on at the next line
    that is a header with a date.
    """
    lost = False
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        shape = version or next((v for v, f in ARC_FIELDS.items() if len(f) == len(parts)), None)
        fields = dict(zip(ARC_FIELDS.get(shape, ()), parts, strict=False))
        if shape is None or len(parts) != len(ARC_FIELDS[shape]) or not parts[-1].isdigit() or lost and not re.fullmatch(r"\d{8,14}", fields["date"]):
            if refused is None:
                raise ValueError(f"not a header line of an ARC record: {line[:80]!r}")
            if not lost:
                refused.append(f"no header: {line[:80]!r}")
            lost = True
            continue
        lost = False
        content = stream.read(int(fields["length"]))
        if len(content) < int(fields["length"]):
            why = f"{fields['url']}: {len(content)} of {fields['length']} bytes"
            if refused is None:
                raise ValueError(why)
            refused.append(why)
            return
        if fields["url"].startswith("filedesc://"):
            version = int(content[:1]) if content[:1].isdigit() and int(content[:1]) in ARC_FIELDS else shape
            continue
        yield ArcRecord(shape, fields, content)


def iso_date(date: str) -> str:
    """A 14-digit date in ISO form; shorter ones are filled up, others become the epoch."""
    if not re.fullmatch(r"\d{4,14}", date):
        return "1970-01-01T00:00:00Z"
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def to_warc(record: ArcRecord, *, name: str | None = None, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record.  name: what its identifier is made of (default: URL, date and digest).
    refers_to: the name of the record with the same payload, of which this one is a revisit."""
    http = record.content.startswith(b"HTTP/")
    head, mark, payload = record.content.partition(b"\r\n\r\n") if http else (b"", b"", record.content)
    digest = base32_sha1(payload)
    block = head + mark if refers_to is not None else record.content
    fields = {
        "WARC-Type": "revisit" if refers_to is not None else "response" if http else "resource",
        "WARC-Record-ID": record_id(name if name is not None else (record.url, record.fields["date"], digest)),
        "WARC-Date": iso_date(record.fields["date"]),
        "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.fields["ip"],
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response" if http else record.fields["type"],
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": REVISIT_PROFILE}
    fields |= (extra or {}) | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip()] = v.strip()
        block = stream.read(int(fields["Content-Length"]))
        if len(block) < int(fields["Content-Length"]):
            raise ValueError("a WARC record is cut short")
        yield fields, block


def packed(record: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def convert_arc(df: DataFrame, path: str, *, content: str = "content") -> DataFrame:
    """Converts whole ARC files (a binary column, as of Spark's ``binaryFile`` source; gzip or plain) to WARC files below
    ``path``, one for each; returns the manifest (file, records, refused): what cannot be read is counted, not fatal."""

    def convert(batches):
        files, top = opened_store(path)
        files.create_dir(top, recursive=True)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                name, n, refused = f"{uuid.uuid4().hex}.warc.gz", 0, []
                stream = io.BytesIO(raw or b"")
                with files.open_output_stream(f"{top}/{name}", compression=None) as out:
                    try:
                        for record in parse_arc(gzip.GzipFile(fileobj=stream) if (raw or b"")[:2] == b"\x1f\x8b" else stream, refused=refused):
                            out.write(packed(to_warc(record)))
                            n += 1
                    except (EOFError, zlib.error, gzip.BadGzipFile) as e:
                        refused.append(str(e))
                yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64()), "refused": pa.array([len(refused)], pa.int64())})

    return stored(df.select(content).mapInArrow(convert, "file string, records long, refused long"), "manifest")


#: Compressed bytes after which an archive file ends.
ARCHIVE_BYTES = 256 << 20


class Archive:
    """A file of WARC records that is being written."""

    def __init__(self, files, path: str, top: str):
        self.path, self.name, self.records, self.written = path, f"{uuid.uuid4().hex}.warc.gz", 0, 0
        self.out = files.open_output_stream(f"{top}/{self.name}", compression=None)

    def add(self, record: bytes) -> None:
        member = packed(record)
        self.out.write(member)
        self.records, self.written = self.records + 1, self.written + len(member)

    def close(self) -> pa.RecordBatch:
        """The file's row of the manifest."""
        self.out.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "file": [self.name], "records": pa.array([self.records], pa.int64())})


def write_pages(
    df: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "20240101000000", path: str | None = None, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a WARC record for each row and returns the manifest (path, file, records).

    The rows of a batch are laid down as an ARC file, of version 1 and 2 in turn, and that file is converted.
    least_bytes: records with smaller payloads are never revisits.
    """
    spark = df.sparkSession
    tune(spark)
    path = path or f"{shared_dir(spark)}/warc"
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    pages = df.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), raw.alias("payload"), F.monotonically_increasing_id().alias("row"))
    pages = pages.withColumn("sha1", F.sha1("payload"))
    known = pages.where(F.length("payload") >= least_bytes).groupBy("sha1", "id").agg(F.min("row").alias("row"))
    # Written, so that the join has a shuffle of its own on either side and Spark can split a payload that very many pages have.
    space = Workspace(spark)
    known = space.stored(known, "known")
    kept = space.stored(known.where("id is not null").groupBy("sha1").agg(F.max("id").alias("of"), F.max_by("row", "id").alias("of_row")), "kept")
    refers = known.drop("row").join(kept, "sha1").where("id is null or id < of").select(F.col("id").alias("rid"), F.col("sha1").alias("rsha1"), "of", "of_row")
    joined = pages.join(refers, F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha1") == F.col("rsha1")) & (F.length("payload") >= least_bytes), "left").select("id", "url", "payload", "of", "row", "of_row")

    def write(batches):
        files, top = opened_store(path)
        files.create_dir(top, recursive=True)
        archive: Archive | None = None
        for k, batch in enumerate(batches):
            pages, addresses, bodies, of, rows, of_rows = (c.to_pylist() for c in batch.columns)
            version = 1 + k % 2
            legacy = [arc_file_head(f"pages-{k}.arc", date, version)]
            for page, address, body in zip(pages, addresses, bodies, strict=True):
                address = re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", address) if address else f"urn:page:{page}"
                address = f"urn:{address}" if address.startswith("filedesc://") else address
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                legacy.append(arc_bytes(address, date, "text/html", head + body, version))
            del bodies
            for page, refers, row, of_row, record in zip(pages, of, rows, of_rows, parse_arc(io.BytesIO(b"".join(legacy))), strict=True):
                if archive and archive.written >= archive_bytes:
                    yield archive.close()
                    archive = None
                archive = archive or Archive(files, path, top)
                extra = ({} if page is None else {"X-Page-Id": str(page)}) | ({} if refers is None else {"X-Refers-To-Page-Id": str(refers)})
                archive.add(to_warc(record, name=f"row {row}", refers_to=None if refers is None else f"row {of_row}", extra=extra))
        if archive:
            yield archive.close()

    manifest = stored(joined.mapInArrow(write, "path string, file string, records long"), "manifest")
    space.drop()
    return manifest


def read_pages(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri, date) of every record of the archives."""
    tune(manifest.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("date", pa.string())])

    def read(batches):
        for batch in batches:
            for path, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, top = opened_store(path)
                rows: list[tuple] = []
                with files.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for fields, block in parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=f))):
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", head + b"\r\n")[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(body), base32_sha1(body)) != (size, digest):
                            raise ValueError(f"{name}: a payload does not agree with its digest")
                        page, of = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        rows.append((page and int(page), size, digest, fields["WARC-Type"], of and int(of), fields["WARC-Target-URI"], fields["WARC-Date"]))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    dealt = manifest.select("path", "file").repartition(2 * partitions(manifest.sparkSession), "file")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, date string")
