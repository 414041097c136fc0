"""WARC records as gzip members, and parsing them back; free of Spark."""

from __future__ import annotations

import base64
import gzip
import hashlib

CRLF = b"\r\n"


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base32, the usual form of WARC digests."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def filesystem(uri: str):
    """The file system and the path that a URI names, on whatever store."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if colon and rest.startswith("/") and not rest.startswith("//"):
        uri = f"{scheme}://{rest}"
    return fs.FileSystem.from_uri(uri)


def header_value(text: str, also: str = "") -> str:
    """A header is one line: control characters, and those in `also`, are percent-escaped."""
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if c < " " or c == "\x7f" or c in also else c for c in text)


def record(kind: str, record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One compressed record. A revisit holds no payload, only its digest and full length. A record without id has a name of
    another kind, so that no id can be taken for it."""
    block = payload if kind == "response" else b""
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", "<urn:nopage>" if record_id is None else f"<urn:page:{header_value(record_id, '%')}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", header_value(url) if url is not None else None), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", f"<urn:page:{header_value(refers_to, '%')}>" if refers_to is not None else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block))),
    ]
    head = b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + CRLF
    return gzip.compress(head + block + CRLF + CRLF, compresslevel=4, mtime=0)


def parse(member: bytes) -> dict:
    """Header fields, with `payload` (None for a revisit). Raises when the block is cut short or its digest differs."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != CRLF + CRLF:
        raise ValueError(f"cut record {fields['WARC-Record-ID']}")
    payload = block if fields["WARC-Type"] == "response" else None
    if payload is not None and f"sha1:{digest_of(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"digest differs in {fields['WARC-Record-ID']}")
    return fields | {"payload": payload}


def page_of(reference: str | None) -> str | None:
    from urllib.parse import unquote

    return unquote(reference[len("<urn:page:") : -1]) if reference and reference.startswith("<urn:page:") else None
