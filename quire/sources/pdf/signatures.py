"""Signature fields: digests of the signed ranges and the RSA signature over them. Integrity only, no trust."""

from __future__ import annotations

import hashlib
from typing import Any

from quire.sources.pdf.cos import text_string
from quire.sources.pdf.document import Document

#: Object identifiers in DER.
DIGESTS = {bytes.fromhex("2b0e03021a"): "sha1", bytes.fromhex("608648016503040201"): "sha256", bytes.fromhex("608648016503040202"): "sha384", bytes.fromhex("608648016503040203"): "sha512"}
MESSAGE_DIGEST, COMMON_NAME = bytes.fromhex("2a864886f70d010904"), bytes.fromhex("550403")
MAX_MODULUS = 1024


def der(data: bytes, pos: int = 0) -> tuple[int, bytes, int, int]:
    """Tag, content, start and end of the element at a position."""
    tag, size, at = data[pos], data[pos + 1], pos + 2
    if size & 0x80:
        n = size & 0x7F
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    if at + size > len(data):
        raise ValueError("truncated")
    return tag, data[at : at + size], pos, at + size


def children(data: bytes) -> list[tuple[int, bytes, bytes]]:
    """(tag, content, whole element) of a constructed element's content."""
    out, pos = [], 0
    while pos < len(data):
        tag, body, begin, end = der(data, pos)
        out.append((tag, body, data[begin:end]))
        pos = end
    return out


def _padded(kind: bytes, digest: bytes, size: int) -> set[bytes]:
    """The blocks that a signature of PKCS #1 version 1.5 may open to: all of the padding, the algorithm, the digest.

    The algorithm's parameters are null or, as some writers have it, missing.
    """
    out = set()
    for parameters in (b"\x05\x00", b""):
        algorithm = bytes([6, len(kind)]) + kind + parameters
        info = bytes([0x30, len(algorithm)]) + algorithm + bytes([4, len(digest)]) + digest
        info = bytes([0x30, len(info)]) + info
        if size >= len(info) + 11:
            out.add(b"\x00\x01" + b"\xff" * (size - len(info) - 3) + b"\x00" + info)
    return out


def verify(signed: bytes, contents: bytes) -> tuple[str, str | None]:
    """(status, signer's common name): Valid, ContentModified, SignatureInvalid, Unsupported or Malformed."""
    try:
        info = children(children(children(der(contents)[1])[1][1])[0][1])
        certificates = next(b for t, b, _ in info if t == 0xA0)
        signer = children(children(info[-1][1])[0][1])
        tbs = children(children(children(certificates)[0][1])[0][1])
        tbs = tbs[1:] if tbs[0][0] == 0xA0 else tbs
        names = [children(x[1]) for rdn in children(tbs[4][1]) for x in children(rdn[1])]
        name = next((n[1][1].decode("utf-8", "replace") for n in names if n[0][1] == COMMON_NAME), None)
        named = children(signer[2][1])[0][1]
        kind = DIGESTS.get(named)
        key = children(children(children(tbs[5][1])[1][1][1:])[0][1])
        modulus, exponent = (int.from_bytes(x[1], "big") for x in key)
        if not kind or not 0 < modulus.bit_length() <= 8 * MAX_MODULUS:
            return "Unsupported", name
        digest, payload, at = hashlib.new(kind, signed).digest(), signed, 3
        if signer[3][0] == 0xA0:
            held = next(children(children(x[1])[1][1])[0][1] for x in children(signer[3][1]) if children(x[1])[0][1] == MESSAGE_DIGEST)
            if held != digest:
                return "ContentModified", name
            payload, at = b"\x31" + signer[3][2][1:], 4
        size = (modulus.bit_length() + 7) // 8
        opened = pow(int.from_bytes(signer[at + 1][1], "big"), exponent, modulus).to_bytes(size, "big")
        good = opened in _padded(named, hashlib.new(kind, payload).digest(), size)
        return ("Valid" if good else "SignatureInvalid" if at == 4 else "ContentModified"), name
    except (ValueError, IndexError, StopIteration, KeyError):
        return "Malformed", None


def signatures(doc: Document) -> list[dict[str, Any]]:
    out = []
    for ref in doc.find(doc.trailer.get("Root"), "AcroForm", "Fields") or []:
        field = doc.get(ref)
        value = doc.get(field.get("V")) if isinstance(field, dict) and field.get("FT") == "Sig" else None
        spans = [doc.get(x) for x in doc.get(value.get("ByteRange")) or []] if isinstance(value, dict) else []
        contents = doc.get(value.get("Contents")) if isinstance(value, dict) else None
        if len(spans) != 4 or not isinstance(contents, bytes) or not all(isinstance(x, int) and x >= 0 for x in spans):
            continue
        text = {k: text_string(x) if isinstance(x := doc.get(value.get(k)), bytes) else None for k in ("Name", "Reason", "Location", "M")}
        a, n, b, m = spans
        status, name = verify(doc.data[a : a + n] + doc.data[b : b + m], contents)
        label = doc.get(field.get("T"))
        out.append({"field": text_string(label) if isinstance(label, bytes) else None, "signer": text["Name"], "reason": text["Reason"], "location": text["Location"], "signed_at_raw": text["M"], "byte_range": spans, "status": status, "signer_cn": name, "covers_whole_file": a == 0 and b + m == len(doc.data)})
    return out
