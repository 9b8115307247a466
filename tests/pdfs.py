"""Small PDF files built in code."""

from quire.sources.pdf.cos import Name, Ref, Stream
from quire.sources.pdf.write import standalone


def simple(pages: list[bytes], **catalog) -> bytes:
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | catalog, 3: font}
    kids = []
    for k, content in enumerate(pages):
        page, stream = 10 + 2 * k, 11 + 2 * k
        objects[page] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(stream, 0)}
        objects[stream] = Stream({}, content)
        kids.append(Ref(page, 0))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(3, 0)}}}
    return standalone(objects, 1)


def text_page(*lines: str) -> bytes:
    body = " ".join(f"0 -14 Td ({line}) Tj" for line in lines)
    return f"BT /F1 12 Tf 72 720 Td {body} ET".encode()
