"""Images of pages as straight RGBA samples, PNG files of them and the difference of two."""

from __future__ import annotations

import struct
import zlib
from typing import Any

import numpy as np

from quire.sources.pdf.cos import PdfError, Stream
from quire.sources.pdf.document import Document
from quire.sources.pdf.filters import decode

#: Components of the colour spaces that have a fixed number of them.
COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}


def _components(doc: Document, space: Any) -> int:
    space = doc.get(space)
    if isinstance(space, list) and space:
        kind = doc.get(space[0])
        if kind == "ICCBased" and isinstance(profile := doc.get(space[1]), Stream):
            return int(doc.get(profile.dict.get("N")) or 0)
        space = kind
    return COMPONENTS.get(str(space), 0)


def _samples(doc: Document, image: Stream) -> np.ndarray:
    """Samples of 8 bits as (height, width, components)."""
    width, height = (doc.get(image.dict.get(k)) for k in ("Width", "Height"))
    n = _components(doc, image.dict.get("ColorSpace"))
    if n not in (1, 3, 4) or doc.get(image.dict.get("BitsPerComponent", 8)) != 8:
        raise PdfError("UnsupportedImage", "only 8-bit grey, RGB and CMYK")
    data = np.frombuffer(decode(image, doc.get), np.uint8)
    names = doc.get(image.dict.get("Filter"))
    if str(doc.get(names[-1]) if isinstance(names, list) and names else names) in ("DCTDecode", "DCT") and isinstance(width, int) and isinstance(height, int) and width * height > 0:
        n = len(data) // (width * height)  # a JPEG file says itself how many components it has
    if not (isinstance(width, int) and isinstance(height, int) and width > 0 and height > 0) or len(data) < width * height * n:
        raise PdfError("BadImage", "fewer samples than the size asks for")
    return data[: width * height * n].reshape(height, width, n)


def rgba(doc: Document, image: Stream) -> np.ndarray:
    """(height, width, 4) straight RGBA, top row first; a soft mask of another size is read at the nearest sample."""
    samples = _samples(doc, image)
    height, width, n = samples.shape
    out = np.full((height, width, 4), 255, np.uint8)
    if n == 4:
        wide = samples.astype(np.float64) / 255
        out[..., :3] = np.floor(255 * (1 - wide[..., :3]) * (1 - wide[..., 3:]) + 0.5)
    else:
        out[..., :3] = samples
    mask = doc.get(image.dict.get("SMask"))
    if isinstance(mask, Stream):
        alpha = _samples(doc, mask)[..., 0]
        rows, columns = (np.arange(size) * have // size for size, have in zip((height, width), alpha.shape, strict=True))
        out[..., 3] = alpha[rows[:, None], columns]
    return out


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of RGBA pixels."""
    height, width, _ = pixels.shape
    lines = np.zeros((height, 1 + width * 4), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def difference(a: np.ndarray, b: np.ndarray, tolerance: int = 2) -> tuple[int, int]:
    """The largest difference of a sample, and how many pixels differ by more than the tolerance anywhere."""
    if a.shape != b.shape:
        raise PdfError("BadImage", "sizes differ")
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return int(apart.max(initial=0)), int((apart > tolerance).any(axis=2).sum())
