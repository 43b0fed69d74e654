"""The WARC reader on hand-built records of other writers."""

import base64
import gzip
import hashlib
import io

import pytest

URN = "<urn:uuid:12345678-1234-1234-1234-1234567890ab>"
CRLF = "\r\n"


def b32(name, data):
    return f"{name}:{base64.b32encode(hashlib.new(name, data).digest()).decode()}"


def made(kind, block, *more, length=None, version="WARC/1.0", end=b"\r\n\r\n"):
    head = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: {URN}", "WARC-Date: 2024-01-02T03:04:05Z", *more, f"Content-Length: {len(block) if length is None else length}"]
    return CRLF.join(head).encode() + b"\r\n\r\n" + block + end


def read(*plain, piece=None, keep=True):
    from quern.llm import warc

    if piece:
        warc_piece, warc.PIECE = warc.PIECE, piece
    try:
        return list(warc.records(io.BytesIO(b"".join(gzip.compress(p) for p in plain)), keep))
    finally:
        if piece:
            warc.PIECE = warc_piece


BODY = "<html>é</html>".encode()
HTTP = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\nServer: x\r\n y\r\n\r\n"
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
CHUNKS = b"5;x=1\r\n" + BODY[:5] + b"\r\n" + f"{len(BODY) - 5:X}".encode() + b"\r\n" + BODY[5:] + b"\r\n0\r\n\r\n"


@pytest.mark.parametrize("piece", [None, 1, 7])
@pytest.mark.parametrize("keep", [True, False])
def test_records_of_all_types(piece, keep):
    response = HTTP + BODY
    plain = [
        made("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", "WARC-Filename: a.warc.gz"),
        made("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/"),
        made("response", response, "CONTENT-TYPE: application/http;msgtype=response", "warc-target-uri: <http://a/%C3%A9>", f"WARC-Payload-Digest: {b32('sha1', BODY)}", f"warc-block-digest: sha256:{hashlib.sha256(response).hexdigest().upper()}"),
        made("response", CHUNKED + CHUNKS, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {b32('sha1', BODY)}"),
        made("response", CHUNKED + CHUNKS, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: md5:{hashlib.md5(CHUNKS).hexdigest()}"),
        made("metadata", b"via: z", "Content-Type: application/warc-fields", "WARC-Refers-To: <urn:uuid:0>", "WARC-Block-Digest: blake9:zz"),
        made("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", "Content-Type: application/http; msgtype=response", "WARC-Refers-To: <urn:uuid:1>", f"WARC-Payload-Digest: {b32('sha1', BODY)}"),
        made("revisit", b"", "WARC-Profile: http://x", "WARC-Refers-To:", " <urn:uuid:2>"),
        made("resource", b"", "Content-Type: image/png", f"WARC-Payload-Digest: {b32('sha1', b'')}"),
        made("conversion", b"a\r\n\r\nb" * 50_000, "Content-Type: text/plain"),
        made("response", HTTP + BODY[:4], "Content-Type: application/http; msgtype=response", "WARC-Truncated: length", f"WARC-Payload-Digest: {b32('sha1', BODY)}"),
    ]
    got = read(*plain, piece=piece, keep=keep)
    sizes = [len(gzip.compress(p)) for p in plain]
    assert [r[0] for r in got] == [sum(sizes[:i]) for i in range(len(plain))]
    assert [r[2] for r in got] == "warcinfo request response response response metadata revisit revisit resource conversion response".split()
    assert all(r[1] == URN and r[4] == "2024-01-02T03:04:05Z" for r in got) and got[2][3] == "http://a/é"
    assert [r[6] for r in got] == [None] * 5 + ["<urn:uuid:0>", "<urn:uuid:1>", "<urn:uuid:2>", None, None, None]
    assert [r[7] for r in got] == [13, 0, len(BODY), len(BODY), len(BODY), 6, 77, None, 0, 300_000, 4]
    assert {got[i][8] for i in (2, 3, 4)} == {hashlib.sha256(BODY).hexdigest()} and got[6][8] == b32("sha1", BODY) and got[7][8] is None
    if keep:
        assert [got[i][9] for i in (0, 2, 3, 4, 5, 6)] == [b"software: x\r\n", BODY, BODY, BODY, b"via: z", None]


@pytest.mark.parametrize(
    "bad, why",
    [
        (lambda: made("response", HTTP + BODY, "Content-Type: application/http", f"WARC-Payload-Digest: {b32('sha1', b'other')}"), "payload digest"),
        (lambda: made("resource", b"abc", f"WARC-Block-Digest: {b32('sha1', b'abd')}"), "block digest"),
        (lambda: made("resource", b"abc", length=2), "frame"),
        (lambda: made("resource", b"abc", length=9), "beyond"),
        (lambda: made("resource", b"abc", end=b""), "frame"),
        (lambda: made("resource", b"abc", version="HTTP/1.1"), "no WARC head"),
        (lambda: b"WARC/1.0\r\nContent-Length: 1\r\n", "head"),
        (lambda: made("resource", b"abc", length="x"), "length"),
        (lambda: made("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc", "Content-Type: application/http"), "long"),
    ],
)
def test_damage_is_named(bad, why):
    good = made("resource", b"abc")
    with pytest.raises(ValueError, match=f"the record at {len(gzip.compress(good))}: .*{why}"):
        read(good, bad())


def test_cut_archive():
    from quern.llm.warc import records

    whole = gzip.compress(made("resource", b"abc" * 100))
    with pytest.raises(ValueError, match="inside a gzip member"):
        list(records(io.BytesIO(whole[:-20])))
    with pytest.raises(ValueError):
        list(records(io.BytesIO(b"not gzip")))
    assert list(records(io.BytesIO(b""))) == []


def test_archives_of_others_through_spark(spark, tmp_path):
    from quern.llm.warc import read_archives

    paths = []
    for k in range(3):
        p = tmp_path / f"{k}.warc.gz"
        p.write_bytes(b"".join(gzip.compress(made("resource", f"{k}{i}".encode() * 30)) for i in range(5)))
        paths.append((str(p),))
    out = read_archives(spark.createDataFrame(paths, "path string")).collect()
    assert len(out) == 15 and sorted({bytes(r.payload[:2]) for r in out}) == sorted(f"{k}{i}".encode() for k in range(3) for i in range(5))
    (tmp_path / "3.warc.gz").write_bytes(gzip.compress(made("resource", b"abc", length=2)))
    with pytest.raises(Exception, match="3.warc.gz, the record at 0"):
        read_archives(spark.createDataFrame([(str(tmp_path / "3.warc.gz"),)], "path string")).collect()
