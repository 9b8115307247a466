"""Writing files: whole documents, appended revisions, page assembly and edits with an undo journal."""

from __future__ import annotations

from typing import Any

from quire.sources.pdf.cos import Name, PdfError, Ref, Stream, serialise, text_string
from quire.sources.pdf.document import Document
from quire.sources.pdf.filters import jpeg_size

HELVETICA = {"Helv": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}}
#: Height of the line of a mark, as a part of its rectangle's.
LINES = {"Underline": 0.08, "StrikeOut": 0.5}


def _table(offsets: dict[int, int]) -> bytes:
    out, nums = [b"xref\n"], sorted(offsets)
    begin = 0
    for k in range(1, len(nums) + 1):
        if k == len(nums) or nums[k] != nums[k - 1] + 1:
            out.append(b"%d %d\n" % (nums[begin], k - begin))
            out += [b"%010d %05d n \n" % (offsets[n], 0) for n in nums[begin:k]]
            begin = k
    return b"".join(out)


def standalone(objects: dict[int, Any], root: int) -> bytes:
    """A complete file of the objects."""
    out, offsets = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for num in sorted(objects):
        offsets[num] = len(out)
        out += b"%d 0 obj\n" % num + serialise(objects[num]) + b"\nendobj\n"
    at = len(out)
    table = _table(offsets).replace(b"xref\n", b"xref\n0 1\n0000000000 65535 f \n", 1)
    return bytes(out + table + b"trailer\n" + serialise({"Size": max(objects, default=0) + 1, "Root": Ref(root, 0)}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


def incremental(doc: Document, changes: dict[int, Any], root: Ref | None = None) -> bytes:
    """The old bytes unchanged, followed by a revision with the changed objects."""
    if doc.decryptor:
        raise PdfError("Encrypted", "a plain revision of an encrypted file would not open")
    if not changes:
        return doc.data
    out, offsets = bytearray(doc.data + (b"" if doc.data.endswith(b"\n") else b"\n")), {}
    for num in sorted(changes):
        offsets[num] = len(out)
        out += b"%d 0 obj\n" % num + serialise(changes[num]) + b"\nendobj\n"
    at, trailer = len(out), {"Size": max(doc.next_free, max(changes) + 1), "Root": root or doc.trailer["Root"]}
    prev = doc.data.rfind(b"startxref")
    if prev >= 0 and not doc.rebuilt:
        trailer["Prev"] = int(doc.data[prev + 9 :].split()[0])
    return bytes(out + _table(offsets) + b"trailer\n" + serialise(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


class Copier:
    """Copies objects of a document to new numbers, each once; parents of pages are not followed."""

    def __init__(self, doc: Document, objects: dict[int, Any]):
        self.doc, self.objects, self.numbers = doc, objects, {}

    def _number(self, num: int, todo: list[int]) -> None:
        """A number for an object on its first sight; none is ever taken away, so their count names the next."""
        if num not in self.numbers:
            self.numbers[num] = len(self.objects) + 1
            self.objects[self.numbers[num]] = None
            todo.append(num)

    def ref(self, ref: Ref) -> Ref:
        todo: list[int] = []
        self._number(ref.num, todo)
        while todo:
            num = todo.pop()
            self.objects[self.numbers[num]] = self._value(self.doc.resolve(num), todo)
        return Ref(self.numbers[ref.num], 0)

    def _value(self, value: Any, todo: list[int]) -> Any:
        if isinstance(value, Ref):
            self._number(value.num, todo)
            return Ref(self.numbers[value.num], 0)
        if isinstance(value, list):
            return [self._value(x, todo) for x in value]
        if isinstance(value, dict):
            return {k: self._value(v, todo) for k, v in value.items() if k != "Parent"}
        return Stream(self._value(value.dict, todo), value.raw) if isinstance(value, Stream) else value


def assemble(selection: list[tuple[Document, int]], keep: Document | None = None) -> bytes:
    """A new file of pages (document, index) in the given order; the catalog entries of `keep` come along."""
    objects: dict[int, Any] = {1: None, 2: None}
    copiers: dict[int, Copier] = {}
    pages = {id(doc): doc.pages() for doc, _ in selection}
    kids = []
    for doc, index in selection:
        if not 0 <= index < len(pages[id(doc)]):
            raise PdfError("PageOutOfRange", str(index))
        page, copier = pages[id(doc)][index], copiers.setdefault(id(doc), Copier(doc, objects))
        ref = copier.ref(page.ref)
        objects[ref.num] = objects[ref.num] | {"Parent": Ref(2, 0), "MediaBox": page.media_box, "Rotate": page.rotate, "Resources": copier._value_now(page.resources)}
        kids.append(ref)
    catalog = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    if keep is not None:
        copier = copiers.setdefault(id(keep), Copier(keep, objects))
        for key, value in keep.find(keep.trailer["Root"]).items():
            if key not in ("Type", "Pages"):
                catalog[key] = copier._value_now(value)
    objects[1], objects[2] = catalog, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    return standalone(objects, 1)


def _value_now(self: Copier, value: Any) -> Any:
    todo: list[int] = []
    out = self._value(value, todo)
    while todo:
        num = todo.pop()
        self.objects[self.numbers[num]] = self._value(self.doc.resolve(num), todo)
    return out


Copier._value_now = _value_now


def _mark(kind: str, rect: list[float], color: list[float], opacity: float) -> tuple[bytes, dict[str, Any]]:
    """Content that paints a mark over a rectangle, and the resources that it needs."""
    x0, y0, x1, y1 = rect
    shade = " ".join(f"{c:g}" for c in color)
    if kind in LINES:
        y = y0 + (y1 - y0) * LINES[kind]
        paint = f"/G gs {shade} RG 1 w {x0} {y} m {x1} {y} l S"
    else:
        paint = f"/G gs {shade} rg {x0} {y0} {x1 - x0} {y1 - y0} re f"
    return paint.encode(), {"ExtGState": {"G": {"ca": opacity, "CA": opacity}}}


def _baseline(height: float, size: float) -> float:
    """Where a line of text stands in a box: about its middle, and above the lower side even if it is too low."""
    return max(height - size, 1.0) / 2 + 0.2 * size


class Session:
    """Edits on one document: pending objects over the base, a journal, and saving as an appended revision."""

    def __init__(self, data: bytes, password: bytes = b""):
        self.doc = Document(data, password)
        self.pending: dict[int, Any] = {}
        self.done: list[dict[int, tuple[Any, Any]]] = []
        self.undone: list[dict[int, tuple[Any, Any]]] = []
        self.next = self.doc.next_free

    def current(self, ref: Ref) -> Any:
        return self.pending[ref.num] if ref.num in self.pending else self.doc.resolve(ref.num)

    def commit(self, changes: dict[int, Any]) -> None:
        self.done.append({n: (self.current(Ref(n, 0)), after) for n, after in changes.items()})
        self.undone.clear()
        self.pending |= changes

    def undo(self) -> bool:
        return self._shift(self.done, self.undone, 0)

    def redo(self) -> bool:
        return self._shift(self.undone, self.done, 1)

    def _shift(self, source: list, target: list, side: int) -> bool:
        if not source:
            return False
        op = source.pop()
        target.append(op)
        self.pending |= {n: states[side] for n, states in op.items()}
        return True

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def save(self) -> bytes:
        return incremental(self.doc, self.pending)

    def now(self) -> Document:
        """The document as it stands: the base's objects, pending ones over them. Nothing is written or read again."""
        return self.doc.over(self.pending) if self.pending else self.doc

    def page_refs(self) -> list[Ref]:
        """Pages as they stand, pending changes included."""
        return [p.ref for p in self.now().pages()]

    def _order(self, refs: list[Ref], extra: dict[int, Any] | None = None) -> None:
        """Commit a flat page tree; every page carries what it inherited."""
        now = self.now()
        root = now.trailer["Root"]
        top = self.new()
        changes = dict(extra or {})
        for p in now.pages():
            if p.ref in refs:
                changes[p.ref.num] = p.dict | {"Parent": Ref(top, 0), "MediaBox": p.media_box, "Rotate": p.rotate, "Resources": p.resources}
        for n in extra or ():
            if isinstance(changes[n], dict) and changes[n].get("Type") == "Page":
                changes[n] |= {"Parent": Ref(top, 0)}
        changes[top] = {"Type": Name("Pages"), "Kids": refs, "Count": len(refs)}
        changes[root.num] = now.resolve(root.num) | {"Pages": Ref(top, 0)}
        self.commit(changes)

    def insert_blank(self, at: int, width: float = 612.0, height: float = 792.0) -> None:
        refs, num = self.page_refs(), self.new()
        refs.insert(max(0, min(at, len(refs))), Ref(num, 0))
        self._order(refs, {num: {"Type": Name("Page"), "MediaBox": [0.0, 0.0, width, height], "Resources": {}}})

    def _checked(self, *indices: int) -> list[Ref]:
        refs = self.page_refs()
        if any(not 0 <= i < len(refs) for i in indices):
            raise PdfError("PageOutOfRange", str(indices))
        return refs

    def delete(self, at: int) -> None:
        refs = self._checked(at)
        del refs[at]
        self._order(refs)

    def move(self, origin: int, target: int) -> None:
        refs = self._checked(origin, target)
        refs.insert(target, refs.pop(origin))
        self._order(refs)

    def rotate(self, at: int, delta: int) -> None:
        page = self.now().pages()[at] if self._checked(at) else None
        self.commit({page.ref.num: page.dict | {"Rotate": (page.rotate + delta) % 360}})

    def _annotate(self, at: int, annotation: dict[str, Any], appearance: bytes, extra: dict[str, Any] | None = None) -> None:
        page = self.now().pages()[self.page_refs().index(self._checked(at)[at])]
        form, num = self.new(), self.new()
        box = annotation["Rect"]
        resources = {"Font": HELVETICA} | (extra or {})
        stream = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": box, "Resources": resources}, appearance)
        annots = self.doc.get(page.dict.get("Annots")) if not isinstance(page.dict.get("Annots"), Ref) else self.current(page.dict["Annots"])
        self.commit({form: stream, num: {"Type": Name("Annot"), "F": 4, "AP": {"N": Ref(form, 0)}} | annotation, page.ref.num: page.dict | {"Annots": [*(annots or []), Ref(num, 0)]}})

    def highlight(self, at: int, rect: list[float], color: list[float], kind: str = "Highlight") -> None:
        """Highlight, Underline or StrikeOut over a rectangle."""
        x0, x1 = sorted((float(rect[0]), float(rect[2])))
        y0, y1 = sorted((float(rect[1]), float(rect[3])))
        x1, y1 = max(x1, x0 + 1), max(y1, y0 + 1)
        paint, states = _mark(kind, [x0, y0, x1, y1], color, 0.4 if kind == "Highlight" else 1.0)
        quad = [x0, y1, x1, y1, x0, y0, x1, y0]
        self._annotate(at, {"Subtype": Name(kind), "Rect": [x0, y0, x1, y1], "QuadPoints": quad, "C": list(color)}, paint, states)

    def free_text(self, at: int, rect: list[float], text: str, size: float = 12.0, cover: bool = False) -> None:
        """A line of text in a rectangle; cover paints it white first, which hides but does not remove what is below."""
        x0, y0, x1, y1 = map(float, rect)
        raw = text.encode("latin-1", "replace")
        paint = (f"1 1 1 rg {x0} {y0} {x1 - x0} {y1 - y0} re f " if cover else "") + f"BT /Helv {size} Tf 0 g {x0 + 2} {y0 + _baseline(y1 - y0, size)} Td "
        self._annotate(at, {"Subtype": Name("FreeText"), "Rect": [x0, y0, x1, y1], "Contents": text.encode(), "DA": b"/Helv %g Tf 0 g" % size}, paint.encode() + serialise(raw) + b" Tj ET")

    def _annotation(self, at: int, index: int) -> tuple[Document, Any, list, dict[str, Any]]:
        """The document as it stands, a page, its annotation entries (inline ones count) and one of them."""
        now = self.now()
        self._checked(at)
        page = now.pages()[at]
        entries = list(now.get(page.dict.get("Annots")) or [])
        if not 0 <= index < len(entries) or not isinstance(now.get(entries[index]), dict):
            raise PdfError("AnnotationOutOfRange", str(index))
        return now, page, entries, now.get(entries[index])

    def _replace_annotation(self, page: Any, entries: list, index: int, value: dict[str, Any], extra: dict[int, Any] | None = None) -> None:
        if isinstance(entries[index], Ref):
            self.commit({entries[index].num: value} | (extra or {}))
        else:
            entries[index] = value
            self.commit({page.ref.num: page.dict | {"Annots": entries}} | (extra or {}))

    def remove_annotation(self, at: int, index: int) -> None:
        _, page, entries, _ = self._annotation(at, index)
        del entries[index]
        self.commit({page.ref.num: page.dict | {"Annots": entries}})

    def restyle(self, at: int, index: int, color: list[float] | None = None, opacity: float | None = None) -> None:
        """Another colour or opacity (0 to 1) of a highlight, underline or strikeout; its appearance is painted anew."""
        now, page, entries, value = self._annotation(at, index)
        kind = str(now.get(value.get("Subtype")))
        if kind not in ("Highlight", *LINES):
            raise PdfError("AnnotationKind", kind)
        rect = [float(now.get(x)) for x in now.get(value["Rect"])]
        key, usual = ("ca", 0.4) if kind == "Highlight" else ("CA", 1.0)
        color = [float(now.get(x)) for x in now.get(value.get("C")) or [0, 0, 0]] if color is None else list(color)
        opacity = float(now.get(value.get(key, usual)) if opacity is None else min(max(opacity, 0.0), 1.0))
        paint, states = _mark(kind, rect, color, opacity)
        form = self.new()
        stream = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": rect, "Resources": states}, paint)
        self._replace_annotation(page, entries, index, value | {"C": color, key: opacity, "AP": {"N": Ref(form, 0)}}, {form: stream})

    def move_annotation(self, at: int, index: int, rect: list[float]) -> None:
        """Another rectangle; the corners of marked text go along, the appearance stays and is fitted by readers."""
        now, page, entries, value = self._annotation(at, index)
        old = [float(now.get(x)) for x in now.get(value["Rect"])]
        new = [float(x) for x in rect]
        new = [min(new[0], new[2]), min(new[1], new[3]), max(new[0], new[2]), max(new[1], new[3])]
        change: dict[str, Any] = {"Rect": new}
        if isinstance(quads := now.get(value.get("QuadPoints")), list):
            moved = []
            for k, raw in enumerate(quads):
                low, high = old[k % 2], old[k % 2 + 2]
                part = (float(now.get(raw)) - low) / (high - low) if high != low else 0.0
                moved.append(new[k % 2] + part * (new[k % 2 + 2] - new[k % 2]))
            change["QuadPoints"] = moved
        self._replace_annotation(page, entries, index, value | change)

    def insert_image(self, at: int, jpeg: bytes) -> None:
        """A page that a JPEG file fills, a point a pixel."""
        width, height, n = jpeg_size(jpeg)
        if n not in (1, 3, 4):
            raise PdfError("BadImage", f"{n} components")
        refs, num, image, content = self.page_refs(), self.new(), self.new(), self.new()
        refs.insert(max(0, min(at, len(refs))), Ref(num, 0))
        space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n]
        picture = Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8, "ColorSpace": Name(space), "Filter": Name("DCTDecode")}, jpeg)
        page = {"Type": Name("Page"), "MediaBox": [0.0, 0.0, float(width), float(height)], "Resources": {"XObject": {"Im": Ref(image, 0)}}, "Contents": Ref(content, 0)}
        self._order(refs, {num: page, image: picture, content: Stream({}, b"q %d 0 0 %d 0 0 cm /Im Do Q" % (width, height))})

    def _field_appearance(self, rect: list[float], value: bytes) -> tuple[int, Stream]:
        """A line of text as high as the field allows, from 6 to 18 points."""
        width, height = abs(rect[2] - rect[0]), abs(rect[3] - rect[1])
        size = min(max(0.7 * height, 6.0), 18.0)
        shown = value.decode("utf-8", "replace").encode("latin-1", "replace")
        paint = b"/Tx BMC BT /Helv %g Tf 0 g 2 %g Td " % (size, _baseline(height, size)) + serialise(shown) + b" Tj ET EMC"
        return self.new(), Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0.0, 0.0, width, height], "Resources": {"Font": HELVETICA}}, paint)

    def find_field(self, name: str) -> tuple[Ref, dict[str, Any]]:
        """The first field of that name as it stands; names compare as text, whatever their encoding."""
        for ref in self.doc.find(self.doc.trailer["Root"], "AcroForm", "Fields") or []:
            field = self.current(ref) if isinstance(ref, Ref) else None
            label = self.doc.get(field.get("T")) if isinstance(field, dict) else None
            if isinstance(label, bytes) and text_string(label) == name:
                return ref, field
        raise PdfError("FieldNotFound", name)

    def set_field(self, name: str, value: Any) -> None:
        """The value of the first field of that name; names (Name) also select the appearance state."""
        ref, field = self.find_field(name)
        state = {"AS": value} if isinstance(value, Name) else {}
        changes = {ref.num: field | {"V": value} | (state if "Kids" not in field else {})}
        rect = [self.doc.get(x) for x in self.doc.get(field.get("Rect")) or []]
        if isinstance(value, bytes) and field.get("FT") in ("Tx", "Ch") and len(rect) == 4:
            form, stream = self._field_appearance([float(x) for x in rect], value)
            changes[form], changes[ref.num] = stream, changes[ref.num] | {"AP": {"N": Ref(form, 0)}}
        for kid in field.get("Kids", []) if isinstance(value, Name) else []:
            own = self.current(kid)
            on = value in (self.doc.find(own, "AP", "N") or {})
            changes[kid.num] = own | {"AS": value if on else Name("Off")}
        self.commit(changes)
