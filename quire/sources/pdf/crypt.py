"""The standard security handler: user passwords, RC4 and AES."""

from __future__ import annotations

import hashlib
from typing import Any

from quire.sources.pdf.cos import Name, PdfError, Stream

#: Fixed value: the padding of short passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times2(x: int) -> int:
    return ((x << 1) ^ 0x1B) & 0xFF if x & 0x80 else x << 1


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution box from its definition: inverses in the field, then the affine map."""
    box, p, q = [0] * 256, 1, 1
    while True:
        p ^= _times2(p)
        for shift in (1, 2, 4):
            q ^= q << shift & 0xFF
        q ^= 0x09 if q & 0x80 else 0
        x = q
        for k in range(1, 5):
            x ^= (q << k | q >> (8 - k)) & 0xFF
        box[p] = x ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for k, v in enumerate(box):
        back[v] = k
    return box, back


SBOX, INVERSE = _boxes()


def _mul(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _times2(a), b >> 1
    return out


TIMES = {m: [_mul(x, m) for x in range(256)] for m in (2, 3, 9, 11, 13, 14)}


def _schedule(key: bytes) -> list[bytes]:
    n = len(key) // 4
    words, rcon = [key[k : k + 4] for k in range(0, len(key), 4)], 1
    while len(words) < 4 * (n + 7):
        w = words[-1]
        if len(words) % n == 0:
            w = bytes(SBOX[c] for c in w[1:] + w[:1])
            w = bytes([w[0] ^ rcon]) + w[1:]
            rcon = _times2(rcon)
        elif n == 8 and len(words) % n == 4:
            w = bytes(SBOX[c] for c in w)
        words.append(bytes(a ^ b for a, b in zip(w, words[-n], strict=True)))
    return [b"".join(words[k : k + 4]) for k in range(0, len(words), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


def _columns(block: bytes, weights: tuple[int, ...]) -> bytes:
    tables = [TIMES.get(w) for w in weights]
    out = bytearray()
    for c in range(0, 16, 4):
        for r in range(4):
            x = 0
            for k in range(4):
                t, v = tables[(k - r) % 4], block[c + k]
                x ^= t[v] if t else v
            out.append(x)
    return bytes(out)


def aes_cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool = False) -> bytes:
    """AES in cipher block chaining without padding; a partial last block is dropped."""
    keys, out, last = _schedule(key), [], iv
    for pos in range(0, len(data) - 15, 16):
        block = data[pos : pos + 16]
        if encrypt:
            x = _xor(_xor(block, last), keys[0])
            for n, k in enumerate(keys[1:], 2):
                x = bytes(SBOX[x[(r + 4 * (r % 4)) % 16]] for r in range(16))
                x = _xor(x if n == len(keys) else _columns(x, (2, 3, 1, 1)), k)
            last = x
        else:
            x = _xor(block, keys[-1])
            for n, k in enumerate(reversed(keys[:-1]), 2):
                x = _xor(bytes(INVERSE[x[(r - 4 * (r % 4)) % 16]] for r in range(16)), k)
                x = x if n == len(keys) else _columns(x, (14, 11, 13, 9))
            x, last = _xor(x, last), block
        out.append(x)
    return b"".join(out)


def unpad(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 and data.endswith(bytes([data[-1]]) * data[-1]) else b""


def hardened(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The iterated hash of revision 6."""
    k, n = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = aes_cbc(k[:16], k[16:32], (password + k + extra) * 64, encrypt=True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Decryptor:
    """Key and method of a document that a user password opens; a wrong one raises IncorrectPassword."""

    def __init__(self, encrypt: dict[str, Any], file_id: bytes, password: bytes):
        if encrypt.get("Filter") != "Standard":
            raise PdfError("Encrypted", "unknown handler")
        r, v = encrypt.get("R", 0), encrypt.get("V", 0)
        method = ((encrypt.get("CF") or {}).get(str(encrypt.get("StmF", "Identity"))) or {}).get("CFM", "None") if v >= 4 else "V2"
        self.method = str(method)
        if r >= 5:
            u = encrypt["U"]
            digest = hardened if r >= 6 else lambda p, s: hashlib.sha256(p + s).digest()
            if digest(password[:127], u[32:40]) != u[:32]:
                raise PdfError("IncorrectPassword")
            self.key = aes_cbc(digest(password[:127], u[40:48]), bytes(16), encrypt["UE"])
            return
        size = 5 if r < 3 else max(5, min(16, (encrypt.get("Length", 128 if v >= 4 else 40)) // 8))
        seed = (password + PAD)[:32] + encrypt["O"] + (encrypt.get("P", 0) & 0xFFFFFFFF).to_bytes(4, "little") + file_id
        if r >= 4 and encrypt.get("EncryptMetadata") is False:
            seed += b"\xff" * 4
        key = hashlib.md5(seed).digest()
        for _ in range(50 if r >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        self.key = key[:size]
        if r < 3:
            good = rc4(self.key, PAD) == encrypt["U"]
        else:
            check = hashlib.md5(PAD + file_id).digest()
            for k in range(20):
                check = rc4(bytes(c ^ k for c in self.key), check)
            good = check == encrypt["U"][:16]
        if not good:
            raise PdfError("IncorrectPassword")

    def bytes(self, data: bytes, num: int, gen: int) -> bytes:
        if self.method in ("None", "Identity"):
            return data
        if self.method == "AESV3":
            return unpad(aes_cbc(self.key, data[:16], data[16:]))
        seed = self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if self.method == "AESV2" else b"")
        key = hashlib.md5(seed).digest()[: min(len(self.key) + 5, 16)]
        return unpad(aes_cbc(key, data[:16], data[16:])) if self.method == "AESV2" else rc4(key, data)

    def object(self, value: Any, num: int, gen: int) -> Any:
        if isinstance(value, bytes):
            return self.bytes(value, num, gen)
        if isinstance(value, list):
            return [self.object(x, num, gen) for x in value]
        if isinstance(value, dict):
            return {k: self.object(x, num, gen) for k, x in value.items()}
        if isinstance(value, Stream):
            head = self.object(value.dict, num, gen)
            return value if head.get("Type") == Name("XRef") else Stream(head, self.bytes(value.raw, num, gen))
        return value
