"""Commands on a single file: python -m quire COMMAND FILE ...; collections go through the tables and operators."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable
from pathlib import Path

from quire.operators.editing import edited
from quire.sources.pdf import images, raster
from quire.sources.pdf.cos import PdfError
from quire.sources.pdf.document import Document
from quire.sources.pdf.interpret import Interpreter, text_of
from quire.sources.pdf.tables import rows
from quire.sources.pdf.write import assemble

#: Edits and their arguments: name, then how each argument is read.
EDITS: dict[str, tuple[str, dict[str, Callable]]] = {
    "highlight": ("highlight", {"at": int, "x0": float, "y0": float, "x1": float, "y1": float}),
    "fill-form": ("set_text", {"name": str, "value": str}),
    "insert-blank-page": ("insert_blank", {"at": int}),
    "insert-image-page": ("insert_image", {"at": int, "jpeg": lambda p: Path(p).read_bytes().hex()}),
    "delete-page": ("delete", {"at": int}),
    "move-page": ("move", {"origin": int, "target": int}),
    "rotate-page": ("rotate", {"at": int, "delta": int}),
    "add-text": ("free_text", {"at": int, "x0": float, "y0": float, "x1": float, "y1": float, "text": str}),
    "replace-text": ("replace_text", {"at": int, "x0": float, "y0": float, "x1": float, "y1": float, "text": str}),
    "remove-annotation": ("remove_annotation", {"at": int, "index": int}),
}


def _show(table: str, data: bytes, **options) -> None:
    for row in rows(table, "", data, **options):
        print(json.dumps({k: v for k, v in row.items() if k != "doc" and v is not None}, default=str))


def _bench(data: bytes) -> None:
    began = time.perf_counter()
    doc = Document(data)
    pages = doc.pages()
    opened = time.perf_counter()
    runner = Interpreter(doc)
    shown = [runner.runs(p) for p in pages]
    interpreted = time.perf_counter()
    letters = sum(len(text_of(x)) for x in shown)
    ended = time.perf_counter()
    print(json.dumps({"pages": len(pages), "characters": letters, "open_seconds": opened - began, "interpret_seconds": interpreted - opened, "text_seconds": ended - interpreted}))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("dump", "verify-signatures", "bench"):
        commands.add_parser(name).add_argument("file", type=Path)
    for name in ("render-info", "text"):
        p = commands.add_parser(name)
        p.add_argument("file", type=Path)
        p.add_argument("page", type=int, nargs="?", default=0)
    p = commands.add_parser("render")
    p.add_argument("file", type=Path)
    p.add_argument("out", type=Path)
    p.add_argument("page", type=int, nargs="?", default=0)
    p.add_argument("scale", type=float, nargs="?", default=1.0)
    for name, (_, arguments) in EDITS.items():
        p = commands.add_parser(name)
        p.add_argument("file", type=Path)
        p.add_argument("out", type=Path)
        for argument, kind in arguments.items():
            p.add_argument(argument, type=kind)
    p = commands.add_parser("merge")
    p.add_argument("out", type=Path)
    p.add_argument("files", type=Path, nargs="+")
    p = commands.add_parser("split")
    p.add_argument("file", type=Path)
    p.add_argument("out", type=Path)
    p.add_argument("pages", type=int, nargs="+")
    p = commands.add_parser("optimize")
    p.add_argument("file", type=Path)
    p.add_argument("out", type=Path)
    return top


def main(argv: list[str] | None = None) -> int:
    """Run one command; 0 if it went well, 1 with a message on standard error if not."""
    given = parser().parse_args(argv)
    try:
        if given.command == "merge":
            docs = [Document(p.read_bytes()) for p in given.files]
            given.out.write_bytes(assemble([(d, k) for d in docs for k in range(len(d.pages()))], docs[0]))
            return 0
        data = given.file.read_bytes()
        if given.command == "dump":
            for table in ("files", "trailer", "pages"):
                _show(table, data)
        elif given.command == "verify-signatures":
            _show("signatures", data)
        elif given.command == "bench":
            _bench(data)
        elif given.command == "render-info":
            _show("summary", data, include_annotations=True, pages=[given.page])
        elif given.command in ("text", "render"):
            doc = Document(data)
            page = next((p for p in doc.pages() if p.index == given.page), None)
            if page is None:
                raise PdfError("PageOutOfRange", str(given.page))
            if given.command == "text":
                print(text_of(Interpreter(doc).runs(page)))
            else:
                given.out.write_bytes(images.png(raster.render(doc, page, given.scale)))
        elif given.command in ("split", "optimize"):
            doc = Document(data)
            pages = given.pages if given.command == "split" else range(len(doc.pages()))
            given.out.write_bytes(assemble([(doc, k) for k in pages], doc if given.command == "optimize" else None))
        else:
            action, names = EDITS[given.command]
            arguments = {k: getattr(given, k) for k in names}
            if "x0" in arguments:
                arguments["rect"] = [arguments.pop(k) for k in ("x0", "y0", "x1", "y1")]
            given.out.write_bytes(edited(data, [(action, json.dumps(arguments))]))
    except (PdfError, OSError) as error:
        print(f"quire: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
