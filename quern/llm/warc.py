"""WARC archives: a writer and a sequential reader.

*Writer.*  One gzip member per record.  Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is a response, the others are revisits that refer to it.  Each task writes its own archives to the shared folder under a
temporary name and renames them, so a task that runs again leaves whole files only, and just
the files of the attempt that counted are listed.

*Reader.*  Archives of any writer that has one gzip member a record are read front to back in pieces of 64 KB.  A member is inflated only as far as
its record is read: the head to its empty line, then as much as Content-Length says, then the end.  Names of
head fields have any case and may go on over lines; all record types are read; of HTTP responses and requests the payload is the body, chunks put together, of
others the block.  Recorded digests (SHA-1, SHA-256, SHA-512 or MD5, in hexadecimal or Base32) are verified: of the block, and of the payload
unless the record is a revisit or truncated; a chunked body may have either form's digest.  Missing digests and
unknown algorithms are let pass.  A broken record raises an error that names the archive and the record's offset.

Defined results: a null payload is empty, null url and id are written as absent and read back as null,
repeated rows are repeated records, and an empty table makes an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import new_path, ship, written

PIECE = 1 << 16
ROLL_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "archive string, offset long, record_id string, record_type string, url string, date string, content_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
HEAD_BYTES = 1 << 20  # of a head at most
# Digest algorithms by name.
DIGESTS = {"sha1": "sha1", "sha256": "sha256", "sha512": "sha512", "md5": "md5"}


class _Local:
    """The few file operations that are needed, on a path that this machine mounts."""

    def write(self, path: str) -> BinaryIO:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")

    def read(self, path: str) -> BinaryIO:
        return open(path, "rb")

    def move(self, a: str, b: str) -> None:
        os.replace(a, b)


class _Remote:
    def __init__(self, fs: pyarrow.fs.FileSystem):
        self.fs = fs

    def write(self, path: str) -> BinaryIO:
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        return self.fs.open_output_stream(path)

    def read(self, path: str) -> BinaryIO:
        return self.fs.open_input_stream(path)

    def move(self, a: str, b: str) -> None:
        self.fs.move(a, b)


def _files(uri: str) -> tuple[_Local | _Remote, str]:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return _Local(), unquote(parts.path) if parts.scheme else uri
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return _Remote(fs), path


def record_name(record_id: int | None) -> str:
    return f"<urn:record:{'' if record_id is None else record_id}>"


def record(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The uncompressed record; a revisit has the HTTP head of the response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(record_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~-._')}")
    if revisit:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Member:
    """One gzip member of a stream, inflated as far as it is read."""

    def __init__(self, stream: BinaryIO, held: bytes):
        self.stream, self.raw, self.z, self.out = stream, held, zlib.decompressobj(31), bytearray()

    def _fill(self) -> bool:
        """A piece more; whether there was one."""
        while not self.z.eof:
            made = self.z.decompress(self.raw, PIECE)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if made:
                self.out += made
                return True
            if not self.z.eof and not self.raw:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    raise ValueError("the archive ends inside a gzip member")
        return False

    def until_blank(self) -> bytes:
        """Up to and without the next empty line."""
        at = 0
        while True:
            ends = [(i, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (i := self.out.find(mark, max(at - 3, 0))) >= 0]
            if ends:
                i, n = min(ends)
                found = bytes(self.out[:i])
                del self.out[: i + n]
                return found
            at = len(self.out)
            if at > HEAD_BYTES or not self._fill():
                raise ValueError("no end of the head")

    def read(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.out and not self._fill():
                raise ValueError("Content-Length goes beyond the record")
            piece = bytes(self.out[:n])
            del self.out[:n]
            n -= len(piece)
            yield piece

    def end(self) -> bytes:
        """What is read of the stream already, after the member's end."""
        while self._fill():
            if len(self.out) > 4:
                break
        if bytes(self.out) not in (b"\r\n\r\n", b"\n\n"):
            raise ValueError("Content-Length does not frame the block")
        return self.raw


def _fields(head: str) -> dict[str, str]:
    """Fields of a head by name in lower case; lines that begin with white space go on with the last one."""
    out: dict[str, str] = {}
    last = ""
    for line in head.replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] = (out[last] + " " + line.strip()).strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
        elif line.strip():
            raise ValueError(f"no field: {line[:80]!r}")
    return out


def _dechunked(body: bytes) -> bytes:
    """The body of a chunked message; as it is where it is none."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return body
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _digest(recorded: str | None) -> tuple[str | None, str]:
    """(algorithm that can be verified or None, value) of ``algorithm:value``."""
    name, _, value = (recorded or "").partition(":")
    return DIGESTS.get(name.strip().lower().replace("-", "")), value.strip()


def _same(value: str, made: bytes) -> bool:
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def _one(member: _Member, keep: bool) -> tuple:
    """FIELDS from the record's id on, verified; without ``keep`` the payload is hashed and let go."""
    version, _, rest = member.until_blank().decode("utf-8", "replace").replace("\r\n", "\n").lstrip("\n").partition("\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC head")
    fields = _fields(rest)
    kind = fields.get("warc-type", "").lower()
    if not kind or not fields.get("content-length", "").isdigit():
        raise ValueError("no type or length")
    (block_name, block_value), (name, value) = _digest(fields.get("warc-block-digest")), _digest(fields.get("warc-payload-digest"))
    whole = hashlib.new(block_name) if block_name else None
    http = kind in ("response", "request", "revisit") and fields.get("content-type", "").lower().replace(" ", "").startswith("application/http")
    revisit = kind == "revisit"
    checked = name and not revisit and "warc-truncated" not in fields
    sums = [hashlib.sha256(), *([hashlib.new(name)] if checked and name != "sha256" else [])]
    kept, size, head, message = [], 0, b"", None if http else {}
    for piece in member.read(int(fields["content-length"])):
        if whole:
            whole.update(piece)
        if message is None:
            head += piece
            ends = [(i, n) for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := head.find(mark)) >= 0]
            if not ends:
                continue
            at, n = min(ends)
            lines = head[:at].decode("latin-1").replace("\r\n", "\n").partition("\n")[2]
            message, piece = _fields("\n".join(x for x in lines.split("\n") if ":" in x or x[:1] in (" ", "\t"))), head[at + n :]
            keep = keep or message.get("transfer-encoding", "").lower() == "chunked"
        size += len(piece)
        for x in sums:
            x.update(piece)
        if keep:
            kept.append(piece)
    if message is None:
        message = {}  # an HTTP head alone, without its empty line
    if whole and not _same(block_value, whole.digest()):
        raise ValueError("block digest differs")
    body = b"".join(kept) if keep else None
    right = not checked or _same(value, sums[-1].digest())
    if message.get("transfer-encoding", "").lower() == "chunked" and not revisit:
        body = _dechunked(body or b"")
        right = right or _same(value, hashlib.new(name, body).digest())
        size, sums = len(body), [hashlib.sha256(body)]
    if not right:
        raise ValueError("payload digest differs")
    if http and not revisit and kind == "response" and "warc-truncated" not in fields and "transfer-encoding" not in message and message.get("content-length", str(size)) != str(size):
        raise ValueError("the payload is not as long as its head says")
    digest = sums[0].hexdigest()
    if revisit:
        size = int(message["content-length"]) if message.get("content-length", "").isdigit() else None
        digest = value.lower() if name == "sha256" and len(value) == 64 else fields.get("warc-payload-digest")
        body = None
    url = fields.get("warc-target-uri")
    url = None if url is None else unquote(url.removeprefix("<").removesuffix(">"))
    return (fields.get("warc-record-id"), kind, url, fields.get("warc-date"), fields.get("content-type"), fields.get("warc-refers-to"), size, digest, body)


def records(stream: BinaryIO, keep: bool = True) -> Iterator[tuple]:
    """(offset, fields from the record's id on) of each record of a stream, read front to back."""
    held, offset = stream.read(PIECE), 0
    seen = len(held)
    while held:
        member = _Member(_Counting(stream), held)
        try:
            out = _one(member, keep)
            held = member.end()
        except (ValueError, zlib.error) as e:
            raise ValueError(f"the record at {offset}: {e}") from e
        yield offset, *out
        seen += member.stream.n
        if not held:
            held = stream.read(PIECE)
            offset, seen = seen, seen + len(held)
        else:
            offset = seen - len(held)


class _Counting:
    """A stream that counts what is read."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.n = stream, 0

    def read(self, n: int) -> bytes:
        out = self.stream.read(n)
        self.n += len(out)
        return out


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 100, level: int = 4, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row; (path, records) of the archives in the shared folder."""
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    # Digests of several records: counted on each map side first, so a payload that very many pages share is no hot key.
    again = rows.where(F.length("body") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = written(again, "repeated-payloads")
    placed = rows.join(again, "digest", "left").select("id", "url", "body", "digest", "first")
    folder = new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, at, n, size = [], None, "", 0, 0
        files, base = _files(folder)
        for batch in batches:
            for i, url, body, digest, first in zip(*(batch.column(k) for k in range(5))):
                if out is None:
                    at, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.write(at + ".part")
                i, first = i.as_py(), first.as_py()
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                plain = record(i, url.as_py(), body.as_py(), digest.as_py(), first, first is not None and i != first, date)
                packed = z.compress(plain) + z.flush()
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= ROLL_BYTES:
                    out.close()
                    files.move(at + ".part", at)
                    done.append((at, n))
                    out = None
        if out is not None:
            out.close()
            files.move(at + ".part", at)
            done.append((at, n))
        top = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
        yield pa.RecordBatch.from_arrays([pa.array([top + p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["path", "records"])

    return written(placed.mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """FIELDS of every record of the archives (path).

    payload_bytes and payload_digest (bare SHA-256 in hexadecimal) are the payload's; of a revisit, whose payload is null, they are
    what its head says: null, or another algorithm with its name, where it does not say these.
    """
    spark = archives.sparkSession
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in FIELDS.split(", "))])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = _files(path)
                rows, held = [], 0
                with files.read(at) as stream:
                    try:
                        for offset, *fields, body in records(stream, with_payload):
                            body = body if with_payload else None
                            rows.append((path, offset, *fields, body))
                            held += len(body or b"") + 200
                            if held >= 8 << 20:
                                yield pack(rows)
                                rows, held = [], 0
                    except ValueError as e:
                        raise ValueError(f"{path}, {e}") from e
                if rows:
                    yield pack(rows)

    return archives.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(read, FIELDS)
