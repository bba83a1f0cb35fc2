"""Writing pages as WARC archives, one gzip member per record, and reading archives in byte ranges.

Archives are plain files in a folder that driver and executors share, opened through pyarrow's file systems (local, HDFS,
S3, GCS by the path's scheme). A writing task gives every file a name of its own and returns the names; only files of
tasks that Spark committed are in the resulting manifest, whatever a lost or repeated attempt left behind.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.session import fresh_path, settle

MAGIC = b"\x1f\x8b\x08"
#: Payloads shorter than this are always stored.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, bytes bigint, n_records bigint"
RECORD = ("path string, offset bigint, record_type string, record_id string, target_uri string, page_id bigint, "
          "refers_to bigint, stored_digest string, stored_length bigint, payload binary")


def _file(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path within it of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type and refers_to of each page.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least LEAST_REVISIT bytes the smallest page_id is
    the response and the others revisit it; rows that repeat that page_id are responses too. A null page_id
    comes after all others: such a row revisits, and is a response only where its group has no other id.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", body.alias("payload")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    slim = known.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy(F.col("payload_digest").alias("digest"))
    firsts = settle(slim.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-firsts")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.join(firsts, F.col("payload_digest") == F.col("digest"), "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC record."""
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page}')}>"
    block = HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(digest if page_id is None else page_id)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", most_bytes: int = 1 << 30) -> DataFrame:
    """Write the pages' records and return the manifest (path, bytes, n_records), itself written beside them.

    Each task begins a new archive when one has reached ``most_bytes``. An empty table gives an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file(folder)
        files.create_dir(root, recursive=True)
        done, out, path, count, size = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = files.open_output_stream(path, compression=None), 0, 0
                member = gzip.compress(record(page_id, url, payload, digest, kind, refers_to, date), mtime=0)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= most_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        prefix = folder[:len(folder.rstrip("/")) - len(root.rstrip("/"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([prefix + p for p, _, _ in done], pa.string()), pa.array([s for _, s, _ in done], pa.int64()),
             pa.array([n for _, _, n in done], pa.int64())], ["path", "bytes", "n_records"])

    rows = record_types(pages).select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    return settle(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class RangeReader:
    """The records of one archive whose members begin in a byte range."""

    CHUNK = 1 << 18

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at, self.buffer = handle, size, 0, b""

    def bytes_at(self, offset: int, n: int) -> bytes:
        """Up to n bytes at an offset, from a buffer that moves forward."""
        end = min(offset + n, self.size)
        if offset < self.at or end > self.at + len(self.buffer):
            self.handle.seek(offset)
            self.at, self.buffer = offset, self.handle.read(min(max(n, self.CHUNK), self.size - offset))
        return self.buffer[offset - self.at:end - self.at]

    def candidate(self, offset: int, end: int) -> int | None:
        """Where the next gzip magic begins, if before ``end``."""
        while offset < end:
            chunk = self.bytes_at(offset, min(self.CHUNK, end - offset + len(MAGIC) - 1))
            found = chunk.find(MAGIC)
            if found >= 0:
                return offset + found if offset + found < end else None
            offset += max(1, len(chunk) - len(MAGIC) + 1)
        return None

    def member(self, offset: int) -> tuple[bytes, int] | None:
        """The decoded member at an offset and where it ends, or None if it is none.

        It must begin as a WARC record, which its first bytes tell, decode to its end with the right checksum, and be followed by
        another member or the end of the file.
        """
        decoder, parts, n, at = zlib.decompressobj(31), [], 0, offset
        try:
            while not decoder.eof:
                chunk = self.bytes_at(at, 1 << 16)
                if not chunk:
                    return None
                parts.append(decoder.decompress(chunk))
                n, at = n + len(parts[-1]), at + len(chunk)
                if n >= 7 and (len(parts) == 1 or n - len(parts[-1]) < 7) and not b"".join(parts).startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        end = at - len(decoder.unused_data)
        data = b"".join(parts)
        follows = self.bytes_at(end, len(MAGIC))
        return (data, end) if data.startswith(b"WARC/1.") and (not follows or follows == MAGIC) else None

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        while (at := self.candidate(start, end)) is not None:
            found = self.member(at)
            if found:
                yield at, found[0]
            start = found[1] if found else at + 1


def parse(data: bytes) -> tuple:
    """record_type, record_id, target_uri, page_id, refers_to, stored_digest, stored_length and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode()] = v.strip().decode()
    number = lambda k: int(fields[k]) if k in fields else None
    block = rest[:int(fields["content-length"])]
    kind = fields["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    return (kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page"),
            fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, number("x-payload-length"), payload)


def read_archives(manifest: DataFrame, split: int = 64 << 20) -> DataFrame:
    """The records of all archives in a manifest (path, bytes), read in ranges of ``split`` bytes.

    A range owns the records that begin in it and reads on past its end to finish the last. Counts the ranges first, so
    that each can be a task of its own.
    """
    ranges = manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split).cast("bigint"))).alias("start"))
    n = max(1, min(ranges.count(), 100_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                files, inner = _file(path)
                held, rows = 0, []
                with files.open_input_file(inner) as handle:
                    for at, data in RangeReader(handle, size).records(start, min(start + split, size)):
                        rows.append((path, at, *parse(data)))
                        held += len(data)
                        if held > 4 << 20:
                            yield pack(rows)
                            held, rows = 0, []
                if rows:
                    yield pack(rows)

    return ranges.repartition(n, "path", "start").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, split: int = 4 << 20) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back.

    payload_bytes and payload_digest are of the payload that was read; a revisit has none and says them in its header.
    """
    records = read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc")), split)
    stored = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(stored, F.octet_length("payload").cast("bigint")).otherwise(F.col("stored_length")).alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("stored_digest")).alias("payload_digest"),
        "record_type", "refers_to")
