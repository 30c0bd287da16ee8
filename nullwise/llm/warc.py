"""WARC archives: deduplicated writer and salvage reader.

Writer: every page becomes a gzip member with one record.  Of pages with the
same payload the one with the largest id is written as a response, the
others as revisits of it.  Tasks write archives to the shared folder; an
archive counts only if the manifest lists it.

Reader: reads member after member and checks each (gzip checksum, version
line, content length, block digest).  After a failed check it searches for
the next member, or version line of a plain archive, that passes, goes on
there and reports the bytes in between as a quarantined gap.  Memory is
bounded by the largest record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored
from .files import open_input, open_output

#: Bytes after which a task starts a new archive.
ARCHIVE_BYTES = 64 << 20
#: Payloads that occur more than once up to which their table is broadcast.
REPEATED = 500_000
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_CHUNK = 1 << 16
_URN = "urn:page:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the HTTP header alone."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    target = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
             f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    coder = zlib.compressobj(4, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


class _Window:
    """Bytes of a stream from a moving start; ``at(n)`` makes n bytes visible if there are as many."""

    def __init__(self, stream):
        self.stream, self.data, self.start, self.ended = stream, bytearray(), 0, False

    def at(self, n: int) -> bytearray:
        while len(self.data) < n and not self.ended:
            more = self.stream.read(max(_CHUNK, n - len(self.data)))
            self.ended = not more
            self.data += more
        return self.data

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.start += n


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, length) of the record at the start of data; ValueError says which check failed."""
    if not data.startswith(VERSION):
        raise ValueError("version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("header end")
    headers = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("content length")
    size = int(headers["content-length"])
    block = data[end + 4:end + 4 + size]
    if len(block) < size or data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
        raise ValueError("record end")
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(bytes(block)):
        raise ValueError("block digest")
    return headers, bytes(block), end + 8 + size


def _gzip_record(window: _Window) -> tuple[dict, bytes, int]:
    """The record of the member at the window's start, with the member's length."""
    if bytes(window.at(3)[:3]) != MAGIC:
        raise ValueError("member start")
    coder, used, out = zlib.decompressobj(31), 0, []
    try:
        while not coder.eof:
            data = window.at(used + _CHUNK)
            if used >= len(data):
                raise ValueError("member end")
            piece = bytes(data[used:used + _CHUNK])
            out.append(coder.decompress(piece))
            used += len(piece) - len(coder.unused_data)
            if used > 2 * _CHUNK and not b"".join(out[:1]).startswith(VERSION):
                raise ValueError("version line")
    except zlib.error as e:
        raise ValueError("member checksum" if "check" in str(e) else "member data") from e
    headers, block, length = parse(b"".join(out))
    if length != sum(map(len, out)):
        raise ValueError("one record per member")
    return headers, block, used


def _plain_record(window: _Window) -> tuple[dict, bytes, int]:
    if bytes(window.at(len(VERSION))[:len(VERSION)]) != VERSION:
        raise ValueError("version line")
    n = _CHUNK
    while (end := window.at(n).find(b"\r\n\r\n")) < 0 and len(window.data) >= n and n < 16 * _CHUNK:
        n += _CHUNK
    size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*\r\n", window.data[:end + 2]) if end >= 0 else None
    if size is None:
        raise ValueError("content length")
    need = end + 8 + int(size[1])
    if window.data.find(b"\r\n\r\n" + VERSION, end, end + 8 + len(VERSION)) >= 0 and int(size[1]) > 0:
        raise ValueError("record end")
    return parse(bytes(window.at(need)[:need]))


def salvage(stream) -> Iterator[tuple]:
    """("record", offset, headers, block) and ("gap", start, end, failed check) in order of place.

    An archive of gzip members and one of plain records are both read; empty
    input gives nothing.  Bytes behind the last valid record are a gap.
    """
    window = _Window(stream)
    gap_start, reason = None, ""
    while window.at(1):
        read = _gzip_record if window.data[:1] == MAGIC[:1] else _plain_record
        try:
            headers, block, length = read(window)
        except ValueError as e:
            if gap_start is None:
                gap_start, reason = window.start, str(e)
            while True:  # the next place where a member or a version line may begin
                places = [p for p in (window.data.find(MAGIC, 1), window.data.find(VERSION, 1)) if p > 0]
                if places:
                    window.skip(min(places))
                    break
                window.skip(max(0, len(window.data) - len(VERSION) + 1) or 1)
                if window.ended and len(window.data) < len(VERSION):
                    window.skip(len(window.data))
                    break
                window.at(len(window.data) + _CHUNK)
            continue
        if gap_start is not None:
            yield "gap", gap_start, window.start, reason
            gap_start = None
        yield "record", window.start, headers, block
        window.skip(length)
    if gap_start is not None:
        yield "gap", gap_start, window.start, reason


def with_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, refers_to): refers_to is the largest id with the same payload, null for that page itself.

    Payloads are grouped by digest with map-side combining, and only digests
    that occur more than once are joined back: as a broadcast table while
    there are at most REPEATED of them (28 bytes each), so that no payload is
    shuffled, else by a shuffle that Spark splits where one digest is hot.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    hashed = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("html"),
                          F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    wide = F.octet_length("html") >= min_bytes
    twice = hashed.where(wide).groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    twice = stored(twice.select("digest", "keeper"), "repeated")
    out = hashed.join(F.broadcast(twice) if twice.count() <= REPEATED else twice, "digest", "left")
    refers = F.when(F.col("keeper").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("keeper"))), F.col("keeper"))
    return out.select("id", "url", "html", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (id, url, html, refers_to) as archives; the manifest: file, n_records, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n, size = None, "", 0, 0
        done = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if out is None:
                        name, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = open_output(name)
                    data = member(record(page_id, url, (html or "").encode(), refers_to))
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        done.append((name, n, size))
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                                             names=["file", "n_records", "n_bytes"])

    return rows.select("id", "url", "html", "refers_to").mapInArrow(run, "file string, n_records long, n_bytes long")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows of all archives: file, start, stop, kind (record or gap), problem, page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    schema = ("file string, start long, stop long, kind string, problem string, page_id long, payload_bytes long, "
              "payload_digest string, record_type string, refers_to long")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def page(urn: str) -> int | None:
        number = urn.strip("<>").removeprefix(_URN)
        return int(number) if number.lstrip("-").isdigit() else None

    def row(file: str, what: tuple) -> tuple:
        kind, start = what[:2]
        if kind == "gap":
            return file, start, what[2], kind, what[3], None, None, None, None, None
        headers, block = what[2:]
        kind_of = headers.get("warc-type")
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        size = int(headers.get("x-payload-length", 0))
        if kind_of == "response":  # measured from what was read, not copied from the header
            payload = block[block.find(b"\r\n\r\n") + 4:]
            size, digest = len(payload), base32_sha1(payload)
        return (file, start, None, kind, None, page(headers.get("warc-record-id", "")), size, digest, kind_of,
                page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                out = []
                with open_input(file) as stream:
                    for what in salvage(stream):
                        out.append(row(file, what))
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    parts = max(1, manifest.sparkSession.sparkContext.defaultParallelism, manifest.count())
    return manifest.select("file").repartition(parts).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back.

    A null html is an empty payload; a null id is written without a number
    and read back null (it can be a revisit, never the response of others);
    repeated rows with the largest id are each a response; an empty table
    writes no archive and gives an empty table; other columns are neither
    read nor written.  If an archive is damaged in between, its other records
    are read, but fewer than were written: that raises an error that names
    the table of the quarantined gaps.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    manifest = stored(write_archives(with_revisits(pages, min_bytes, **columns), folder), "manifest")
    read = stored(read_archives(manifest), "records")
    written = manifest.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    found = read.where(F.col("kind") == "record")
    if (n := found.count()) != written or read.where(F.col("kind") == "gap").take(1):
        raise ValueError(f"read {n} of {written} records; gaps are the rows of kind 'gap' in {read.inputFiles()[:1]}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
