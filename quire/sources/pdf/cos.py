"""Objects: values, tokens, parsing and serialising.

Null, booleans, numbers and arrays are Python's own; strings are bytes, names Name, dictionaries dict,
references Ref and streams Stream.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field
from typing import Any, NamedTuple


class PdfError(Exception):
    """A failure with a code that becomes a row."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Keyword(str):
    __slots__ = ()


@dataclass
class Stream:
    dict: dict[str, Any] = field(default_factory=dict)
    raw: bytes = b""


WHITE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
END = Keyword("")
MAX_DEPTH = 200


#: What most tokens look like, white space and comments in front of them included; the group that matched tells the kind.
_WS, _REGULAR = rb"[\x00\t\n\x0c\r ]", rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
TOKEN = re.compile(
    rb"(?:" + _WS + rb"++|%[^\r\n]*+)*+(?:"
    rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*+)(?!#)"
    rb"|(\d{1,18})" + _WS + rb"++(\d++)" + _WS + rb"++R(?!" + _REGULAR + rb")"
    rb"|(\d{1,18}(?![\d.])|-[1-9]\d{0,17}(?![\d.]))"
    rb"|([+-]?(?:\d++\.\d*+|\.\d++))"
    rb"|\(([^()\\]*+)\)"
    rb"|([A-Za-z]" + _REGULAR + rb"*+)"
    rb"|(<<)|(\[)|(>>)|(\])"
    rb"|<((?:[0-9A-Fa-f]{2})*+)>)"
).match
NAME, REFERENCE, INTEGER, REAL, STRING, WORD, DICTIONARY, ARRAY, END_DICTIONARY, END_ARRAY, HEX = 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12
INDIRECT = re.compile(rb"(?:" + _WS + rb"++|%[^\r\n]*+)*+(\d+)" + _WS + rb"+(\d+)" + _WS + rb"+obj").match
BEHIND = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")


@functools.lru_cache(4096)
def _named(raw: bytes) -> Name:
    return Name(raw.decode("utf-8", "replace"))


@functools.lru_cache(4096)
def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


@functools.lru_cache(4096)
def _word(raw: bytes) -> Any:
    word = raw.decode("latin-1")
    return {"true": True, "false": False, "null": None}.get(word, Keyword(word))


class Parser:
    """Tokens and objects from a position on."""

    def __init__(self, data: bytes, pos: int = 0, references: bool = True):
        self.data, self.pos, self.references = data, pos, references

    def skip(self) -> None:
        self.pos = SKIP.match(self.data, self.pos).end()

    def peek(self, text: bytes) -> bool:
        self.skip()
        return self.data.startswith(text, self.pos)

    def object(self, depth: int = 0) -> Any:
        """The next object, or a Keyword; END at the end."""
        if depth > MAX_DEPTH:
            raise PdfError("TooDeep", f"at byte {self.pos}")
        return self._of(TOKEN(self.data, self.pos), depth)

    def _of(self, m: re.Match | None, depth: int) -> Any:
        """The object that begins with a token."""
        if m is None:
            return self._other()
        self.pos = m.end()
        kind = m.lastindex
        if kind == NAME:
            return _named(m[1])
        if kind == INTEGER:
            return int(m[4])
        if kind == REFERENCE:
            if self.references:
                return Ref(int(m[2]), int(m[3]))
            self.pos = m.end(2)
            return int(m[2])
        if kind == REAL:
            return float(m[5])
        if kind == WORD:
            return _word(m[7])
        if kind == STRING:
            return m[6]
        if kind == HEX:
            return bytes.fromhex(m[12].decode())
        if kind == ARRAY:
            out = []
            while (m := TOKEN(self.data, self.pos)) is None or m.lastindex != END_ARRAY:
                out.append(self._inner(m, depth + 1))
            self.pos = m.end()
            return out
        if kind == DICTIONARY:
            return self._dictionary(depth + 1)
        return Keyword(m[kind].decode("latin-1"))

    def _inner(self, m: re.Match | None, depth: int) -> Any:
        if depth > MAX_DEPTH:
            raise PdfError("TooDeep", f"at byte {self.pos}")
        value = self._of(m, depth)
        if isinstance(value, Keyword):
            raise PdfError("UnexpectedToken", f"{value!r} at byte {self.pos}")
        return value

    def _dictionary(self, depth: int) -> dict[str, Any]:
        """Entries up to the end; most keys and values are single tokens and need no further calls."""
        data, pos, out = self.data, self.pos, {}
        while True:
            m = TOKEN(data, pos)
            kind = m.lastindex if m else 0
            if kind == END_DICTIONARY:
                self.pos = m.end()
                return out
            if kind == NAME and depth <= MAX_DEPTH:
                key, pos = _text(m[1]), m.end()
            else:
                self.pos = pos
                key = self._inner(m, depth)
                if not isinstance(key, Name):
                    raise PdfError("UnexpectedToken", f"a dictionary key at byte {self.pos}")
                key, pos = str(key), self.pos
            m = TOKEN(data, pos)
            kind = m.lastindex if m else 0
            if kind == NAME:
                out[key], pos = _named(m[1]), m.end()
            elif kind == INTEGER:
                out[key], pos = int(m[4]), m.end()
            elif kind == REFERENCE and self.references:
                out[key], pos = Ref(int(m[2]), int(m[3])), m.end()
            else:
                self.pos = pos
                out[key] = self._inner(m, depth)
                pos = self.pos

    def _other(self) -> Any:
        """Rarer tokens: escapes, odd or broken notation, the end."""
        self.skip()
        data, pos = self.data, self.pos
        if pos >= len(data):
            return END
        c = data[pos : pos + 1]
        if c == b"/":
            return self._name()
        if c == b"(":
            return self._literal()
        if c == b"<":
            return self._hex()
        if m := NUMBER.match(data, pos):
            self.pos = m.end()
            text = m[0]
            if b"." in text:
                return float(text)
            value = int(text)
            if not -(1 << 63) <= value < 1 << 63:
                return float(value)
            return self._reference(value) if self.references and value >= 0 else value
        if m := REGULAR.match(data, pos):
            self.pos = m.end()
            return _word(m[0])
        self.pos += 1
        return Keyword(c.decode("latin-1"))

    def _reference(self, num: int) -> Any:
        m = BEHIND.match(self.data, self.pos)
        if not m:
            return num
        self.pos = m.end()
        return Ref(num, int(m[1]))

    def _name(self) -> Name:
        m = REGULAR.match(self.data, self.pos + 1)
        self.pos = m.end() if m else self.pos + 1
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0]) if m else b""
        return Name(raw.decode("utf-8", "replace"))

    def _literal(self) -> bytes:
        out, depth, pos, data = bytearray(), 1, self.pos + 1, self.data
        while depth:
            if pos >= len(data):
                raise PdfError("UnexpectedEof", "in a string")
            c = data[pos : pos + 1]
            pos += 1
            if c == b"\\":
                c = data[pos : pos + 1]
                if m := re.compile(rb"[0-7]{1,3}").match(data, pos):
                    out.append(int(m[0], 8) & 0xFF)
                    pos = m.end()
                elif c in (b"\r", b"\n"):
                    pos += 2 if data[pos : pos + 2] == b"\r\n" else 1
                else:
                    out += ESCAPES.get(c, c)
                    pos += 1
                continue
            depth += (c == b"(") - (c == b")")
            if depth:
                out += c
        self.pos = pos
        return bytes(out)

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.pos)
        digits = self.data[self.pos + 1 : end].translate(None, WHITE) if end >= 0 else b"?"
        if not re.fullmatch(rb"[0-9A-Fa-f]*", digits):
            raise PdfError("BadHexString", f"at byte {self.pos}")
        self.pos = end + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def indirect(self, length=None) -> tuple[Ref, Any]:
        """`N G obj ...`; length(ref) resolves an indirect /Length."""
        head = INDIRECT(self.data, self.pos)
        if not head:
            raise PdfError("ExpectedObject", f"at byte {self.pos}")
        self.pos = head.end()
        value = self.object()
        if isinstance(value, dict) and self.peek(b"stream"):
            value = self._stream(value, length)
        return Ref(int(head[1]), int(head[2])), None if isinstance(value, Keyword) else value

    def _stream(self, head: dict[str, Any], length) -> Stream:
        """The stated length if `endstream` follows there, else all up to `endstream`, its line break included."""
        begin = self.pos + 6
        begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1 if self.data[begin : begin + 1] in (b"\n", b"\r") else 0
        size = head.get("Length")
        size = length(size) if isinstance(size, Ref) and length else size
        if isinstance(size, int) and size >= 0 and self.data.startswith(b"endstream", SKIP.match(self.data, begin + size).end()):
            self.pos = begin + size
            return Stream(head, self.data[begin : begin + size])
        end = self.data.find(b"endstream", begin)
        if end < 0:
            raise PdfError("UnexpectedEof", "in a stream")
        self.pos = end
        return Stream(head, self.data[begin:end])


def instructions(data: bytes) -> list[tuple[str, list[Any]]]:
    """(operator, operands) of a content stream; inline images are skipped, operands left at the end dropped."""
    parser, out, operands = Parser(data, references=False), [], []
    while (value := parser.object()) is not END:
        if not isinstance(value, Keyword):
            operands.append(value)
            continue
        if value == "BI":
            head = {}
            while isinstance(key := parser.object(), Name):
                head[str(key)] = parser.object()
            size = head.get("L", head.get("Length"))
            begin = parser.pos + 1
            m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(data, begin + size if isinstance(size, int) else begin - 1)
            parser.pos = m.end() if m else len(data)
        out.append((str(value), operands))
        operands = []
    return out


def text_string(raw: bytes) -> str:
    """UTF-16BE after its byte order mark, else UTF-8; what does not decode is replaced."""
    if raw.startswith(b"\xfe\xff"):
        return raw[2 : len(raw) // 2 * 2].decode("utf-16-be", "replace")
    return raw.decode("utf-8", "replace")


@functools.lru_cache(4096)
def _slashed(name: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in name.encode("utf-8"))


def serialise(value: Any) -> bytes:
    """Strings in hex, reals with six places at most, dictionaries by key."""
    kind = type(value)
    if kind is Name:
        return _slashed(value)
    if kind is dict:
        return b"<<" + b" ".join([_slashed(k) + b" " + serialise(value[k]) for k in sorted(value)]) + b">>"
    if kind is list:
        return b"[" + b" ".join([serialise(x) for x in value]) + b"]"
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return (f"{value:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(value, bytes):
        return b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, Stream):
        return serialise(value.dict | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    raise PdfError("NotSerialisable", type(value).__name__)
