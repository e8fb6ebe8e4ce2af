"""WARC archives: one gzip member per record, written and read record by record.

Writing. Records whose payloads are equal (by SHA-1) and of at least min_bytes become one
response, that of the smallest page_id, and revisits that refer to it. The smallest ids
come from an aggregation that combines in the map tasks; they are joined back to the rows,
where a payload that many pages share can be split by the engine. Each task writes one
file to the shared folder under a name of its own and returns the name; only names of
tasks that ended well are listed, so attempts that were lost leave nothing that is read.

Reading. Files are read sequentially in chunks: gzip members are inflated incrementally,
a record's block is framed by its Content-Length, the payload is digested as it passes and
compared with the record's digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, working_path, written

CHUNK = 1 << 16
MIN_BYTES = 0
#: Compressed bytes from which on a task begins another archive.
ARCHIVE_BYTES = 1 << 30
NAME = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class DamagedArchive(ValueError):
    pass


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def filesystem(path: str):
    """The file system and the path in it; one slash after a scheme stands for three."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path)) if re.match(r"\w+:/", path) else (pyarrow.fs.LocalFileSystem(), path)


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member: a response, or a revisit if refers_to is given."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F%]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if revisit:
        head += [f"WARC-Refers-To: <{NAME}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_digest: str = ""
    payload: bytes | None = None


class Members:
    """The inflated bytes of a stream of gzip members, one member at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.ready, self.inflater = stream, b"", b"", None

    def open(self) -> bool:
        """Go to the next member; False at the end."""
        self.raw = self.raw or self.stream.read(CHUNK)
        self.inflater, self.ready = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bool:
        while not self.inflater.eof:
            self.raw = self.raw or self.stream.read(CHUNK)
            if not self.raw:
                raise DamagedArchive("the archive ends inside a record")
            new = self.inflater.decompress(self.raw, CHUNK)
            self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if new:
                self.ready += new
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > most or not self.more():
                raise DamagedArchive("a header does not end")
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.more():
                raise DamagedArchive("a block is shorter than its Content-Length")
            part, self.ready = self.ready[:size], self.ready[size:]
            size -= len(part)
            yield part

    def rest(self) -> bytes:
        while self.more():
            if len(self.ready) > CHUNK:
                break
        return self.ready


def fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip(" \t").lower()] = value.strip(" \t")
    return out


def records(stream, keep_payload: bool = False) -> Iterator[Record]:
    """The records of a stream; a damaged one raises DamagedArchive."""
    members = Members(stream)
    while members.open():
        version, _, lines = members.until(b"\r\n\r\n").partition(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise DamagedArchive(f"not a record: {version[:20]!r}")
        out = Record(fields(lines))
        block, payload = hashlib.sha1(), hashlib.sha1()
        head, kept = b"", []
        in_head = out.headers.get("content-type", "").startswith("application/http")
        for part in members.take(int(out.headers["content-length"])):
            block.update(part)
            if in_head:
                head += part
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                out.http, part, in_head = fields(head[:at]), head[at + 4 :], False
            payload.update(part)
            out.payload_bytes += len(part)
            if keep_payload:
                kept.append(part)
        if members.rest() != b"\r\n\r\n":
            raise DamagedArchive("a record does not end after its block")
        digest = out.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if out.headers.get("warc-type") == "revisit":
            out.payload_bytes = int(out.http["content-length"])
        elif digest and digest != base32(payload.digest()):
            raise DamagedArchive(f"payload digest of {out.headers.get('warc-record-id')}")
        if (own := out.headers.get("warc-block-digest")) and own != "sha1:" + base32(block.digest()):
            raise DamagedArchive(f"block digest of {out.headers.get('warc-record-id')}")
        out.payload_digest = digest or base32(payload.digest())
        out.payload = b"".join(kept) if keep_payload else None
        yield out


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives under path; FILES lists them.

    A null html is an empty payload. Of equal payloads all rows with the smallest page_id
    are responses, and so is every row if no page_id is known. Other columns are ignored."""
    text = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", text.alias("html"), F.sha1(text.cast("binary")).alias("digest"))
    first = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    known = rows.join(first, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        system, base = filesystem(path)
        stream, name, n, size = None, "", 0, 0

        def closed():
            nonlocal stream, n, size
            stream.close()
            full = name if not re.match(r"\w+:/", path) else f"{path}/{name.rpartition('/')[2]}"
            done = pa.RecordBatch.from_pydict({"path": pa.array([full]), "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})
            stream, n, size = None, 0, 0
            return done

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns):
                if stream is None:
                    system.create_dir(base, recursive=True)
                    name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    stream = system.open_output_stream(name)
                out = record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers_to.as_py())
                stream.write(out)
                n, size = n + 1, size + len(out)
                if size >= most:
                    yield closed()
        if stream is not None:
            yield closed()

    return written(known.mapInArrow(write, FILES), "archives")


def page_id(name: str | None) -> int | None:
    digits = (name or "").strip("<>").removeprefix(NAME)
    return int(digits) if digits else None


def read_archives(files: DataFrame) -> DataFrame:
    """RECORDS of the archives that files lists, one task for each file."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = filesystem(path)
                with system.open_input_stream(inner) as stream:
                    cols: list[list] = [[] for _ in range(6)]
                    for r in records(stream):
                        url = r.headers.get("warc-target-uri")
                        row = (page_id(r.headers["warc-record-id"]), url and re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url), r.payload_bytes, r.payload_digest, r.headers["warc-type"], page_id(r.headers.get("warc-refers-to")))
                        for col, value in zip(cols, row):
                            col.append(value)
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in RECORDS.split(", ")])

    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of pages after writing and reading them; an empty table gives none."""
    files = write_archives(pages, working_path(pages.sparkSession, "warc"))
    return read_archives(files)


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
bits AS (SELECT hex, list_transform(range(8), lambda k: ('0x' || hex[5 * k + 1 : 5 * k + 5])::INTEGER) AS parts FROM first)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((parts[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN first USING (hex) JOIN bits USING (hex)
"""
