"""A file's objects: cross-reference sections, lookup, page tree, outline."""

from __future__ import annotations

import re
from copy import copy
from dataclasses import dataclass
from typing import Any

from quire.sources.pdf.cos import Name, Parser, PdfError, Ref, Stream, text_string
from quire.sources.pdf.crypt import Decryptor
from quire.sources.pdf.filters import decode


STARTXREF = re.compile(rb"startxref\s+(\d+)")
#: Of a classic cross-reference table: the head of a subsection, and an entry.
SUBSECTION, ENTRY = re.compile(rb"\s*(\d+)\s+(\d+)(?=\s)(?!\s+[nf]\b)").match, re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])").match


@dataclass
class Page:
    index: int
    ref: Ref
    dict: dict[str, Any]
    media_box: list[float]
    rotate: int
    resources: dict[str, Any]


class Document:
    """Objects by number, newest revision first. Entries: (section, num, gen, kind, a, b)."""

    def __init__(self, data: bytes, password: bytes = b""):
        self.data, self.cache, self.decryptor = data, {}, None
        self.entries: list[tuple[int, int, int, str, int, int]] = []
        self.trailers: list[dict[str, Any]] = []
        self.rebuilt = False
        try:
            self._sections()
            self._index()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfError("MissingRoot")
        except (PdfError, ValueError, IndexError, RecursionError):
            self._rebuild()
            self._index()
        encrypt = self.get(self.trailer.get("Encrypt"))
        if isinstance(encrypt, dict):
            ids = self.get(self.trailer.get("ID")) or [b""]
            self.decryptor = Decryptor({k: self.get(v) for k, v in encrypt.items()}, self.get(ids[0]) or b"", password)
            self.cache.clear()

    # cross-references

    def _sections(self) -> None:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        m = STARTXREF.match(self.data, at) if at >= 0 else None
        if not m:
            raise PdfError("MissingXref")
        todo, seen = [int(m[1])], set()
        while todo:
            offset = todo.pop(0)
            if offset in seen or not 0 <= offset < len(self.data):
                if not seen:
                    raise PdfError("BadXref", f"offset {offset}")
                continue
            seen.add(offset)
            try:
                trailer = self._section(offset, len(seen) - 1)
            except (PdfError, ValueError, IndexError):
                if len(seen) == 1:
                    raise
                break  # older sections are lost, newer ones stand
            self.trailers.append(trailer)
            todo += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]

    def _section(self, offset: int, order: int) -> dict[str, Any]:
        parser = Parser(self.data, offset)
        if not parser.peek(b"xref"):
            _, stream = parser.indirect()
            if not isinstance(stream, Stream):
                raise PdfError("BadXref", f"offset {offset}")
            body, head = decode(stream), stream.dict
            widths = head["W"]
            index = head.get("Index") or [0, head["Size"]]
            pos = 0
            for first, count in zip(index[::2], index[1::2], strict=True):
                for num in range(first, first + count):
                    row = []
                    for w in widths:
                        row.append(int.from_bytes(body[pos : pos + w], "big"))
                        pos += w
                    kind = row[0] if widths[0] else 1
                    if pos > len(body) or kind not in (0, 1, 2):
                        continue
                    self.entries.append((order, num, row[2] if kind == 1 else 0, ("free", "offset", "compressed")[kind], row[1], row[2]))
            return head
        parser.pos += 4
        while m := SUBSECTION(self.data, parser.pos):
            parser.pos = m.end()
            for num in range(int(m[1]), int(m[1]) + int(m[2])):
                if not (e := ENTRY(self.data, parser.pos)):
                    raise PdfError("BadXref", f"entry {num}")
                parser.pos = e.end()
                self.entries.append((order, num, int(e[2]), "offset" if e[3] == b"n" else "free", int(e[1]), 0))
        if not parser.peek(b"trailer"):
            raise PdfError("BadXref", "no trailer")
        parser.pos += 7
        trailer = parser.object()
        if not isinstance(trailer, dict):
            raise PdfError("BadXref", "trailer")
        return trailer

    def _rebuild(self) -> None:
        """Without usable cross-references: every `N G obj` in the file, the last of a number wins."""
        self.rebuilt, self.entries, self.trailers, self.cache = True, [], [], {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b", self.data):
            self.entries.append((0, int(m[1]), int(m[2]), "offset", m.start(), 0))
        self.entries.reverse()
        for m in reversed(list(re.finditer(rb"trailer", self.data))):
            try:
                trailer = Parser(self.data, m.end()).object()
            except PdfError:
                continue
            if isinstance(trailer, dict) and "Root" in trailer:
                self.trailers.append(trailer)
        self._index()
        for _, num, gen, _, _, _ in sorted(self.entries, key=lambda e: e[1]) if not self.trailers else ():
            value = self.resolve(num)
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                self.trailers.append({"Root": Ref(num, gen)})
                break
        if not self.trailers:
            raise PdfError("MissingRoot")

    def _index(self) -> None:
        self.xref: dict[int, tuple] = {}
        for e in self.entries:
            if e[3] != "free":
                self.xref.setdefault(e[1], e)  # a freed number falls back to its older entry
        self.trailer: dict[str, Any] = {}
        for t in self.trailers:
            for k, v in t.items():
                self.trailer.setdefault(k, v)

    # objects

    def resolve(self, num: int) -> Any:
        if num in self.cache:
            return self.cache[num]
        entry = self.xref.get(num)
        if not entry:
            return None
        self.cache[num] = None  # while it is read, a reference to itself is null
        _, _, gen, kind, a, b = entry
        if kind == "offset":
            ref, value = Parser(self.data, a).indirect(lambda r: self.resolve(r.num))
            encrypt = self.trailer.get("Encrypt")
            if self.decryptor and not (isinstance(encrypt, Ref) and encrypt.num == num):
                value = self.decryptor.object(value, ref.num, ref.gen)
        else:
            stream = self.resolve(a)
            if not isinstance(stream, Stream):
                raise PdfError("BadObjectStream", f"object {a}")
            body = decode(stream, self.get)
            head = Parser(body, references=False)
            numbers = [head.object() for _ in range(2 * stream.dict["N"])]
            value = Parser(body, stream.dict["First"] + numbers[2 * b + 1]).object()
        self.cache[num] = value
        return value

    def get(self, value: Any) -> Any:
        return self.resolve(value.num) if isinstance(value, Ref) else value

    def find(self, value: Any, *path: str) -> Any:
        for key in path:
            value = self.get(value)
            value = (value.dict if isinstance(value, Stream) else value).get(key) if isinstance(value, dict | Stream) else None
        return self.get(value)

    @property
    def next_free(self) -> int:
        return max(self.xref, default=0) + 1

    def over(self, changes: dict[int, Any]) -> Document:
        """The same document with some objects changed or added."""
        out = copy(self)
        out.xref = self.xref | {n: (0, n, 0, "offset", 0, 0) for n in changes}
        out.cache = self.cache | changes
        return out

    # pages

    def pages(self, integer_boxes: bool = False) -> list[Page]:
        """Pages in order, with what they inherit; a node listed twice counts once, broken nodes are skipped."""
        out: list[Page] = []
        seen: set[int] = set()
        todo: list[tuple[Any, dict[str, Any]]] = [(self.find(self.trailer.get("Root")).get("Pages"), {})]
        while todo:
            ref, above = todo.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            try:
                node = self.get(ref)
            except PdfError:
                continue
            if not isinstance(node, dict):
                continue
            own = above | {k: node[k] for k in ("Resources", "MediaBox", "Rotate") if node.get(k) is not None}
            if node.get("Type") == "Pages" or "Kids" in node and node.get("Type") != "Page":
                kids = self.get(node.get("Kids"))
                todo += [(kid, own) for kid in reversed(kids if isinstance(kids, list) else [])]
                continue
            box = [self.get(x) for x in self.get(own.get("MediaBox")) or []]
            box = [float(int(x) if integer_boxes else x) for x in box] if len(box) == 4 and all(isinstance(x, int | float) for x in box) else [0.0, 0.0, 612.0, 792.0]
            rotate = self.get(own.get("Rotate"))
            out.append(Page(len(out), ref if isinstance(ref, Ref) else Ref(0, 0), node, box, int(rotate) if isinstance(rotate, int | float) else 0, self.get(own.get("Resources")) or {}))
        return out

    def content(self, page: Page) -> bytes:
        value = self.get(page.dict.get("Contents"))
        parts = value if isinstance(value, list) else [value]
        return b"\n".join(decode(s, self.get) for s in map(self.get, parts) if isinstance(s, Stream))

    def outline(self) -> list[dict[str, Any]]:
        """Nodes with parent, order among siblings, depth, title and page (null unless the target is explicit)."""
        at = {p.ref: p.index for p in self.pages()}
        out: list[dict[str, Any]] = []
        seen: set[int] = set()
        todo = [(self.find(self.trailer.get("Root"), "Outlines", "First"), self._raw_first(self.trailer.get("Root"), "Outlines"), None, 0)]
        while todo:
            _, ref, parent, depth = todo.pop()
            order = 0
            while isinstance(ref, Ref) and ref.num not in seen and isinstance(item := self.get(ref), dict):
                seen.add(ref.num)
                dest = self.get(item.get("Dest"))
                title = self.get(item.get("Title"))
                node = len(out)
                out.append({"node": node, "parent": parent, "depth": depth, "ord": order, "title": text_string(title) if isinstance(title, bytes) else "", "page": at.get(dest[0]) if isinstance(dest, list) and dest and isinstance(dest[0], Ref) else None})
                if isinstance(item.get("First"), Ref):
                    todo.append((None, item["First"], node, depth + 1))
                ref, order = item.get("Next"), order + 1
        return out

    def _raw_first(self, root: Any, key: str) -> Any:
        top = self.find(root, key)
        return top.get("First") if isinstance(top, dict) else None


def edges(value: Any, path: str = "") -> list[tuple[str, int]]:
    """(key path, object number) of every reference inside a value."""
    if isinstance(value, Ref):
        return [(path, value.num)]
    if isinstance(value, Stream):
        value = value.dict
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [x for k, v in items if isinstance(v, Ref | Stream | dict | list) for x in edges(v, f"{path}/{k}")]


__all__ = ["Document", "Name", "Page", "edges"]
