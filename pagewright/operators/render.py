"""Pages as images: a canvas in numpy, PNG by the standard library, a cache by (content hash, page, width)."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO = 1.414
NARROWEST, WIDEST = 200, 2048
WHITE, BORDER, TEXT, HEADING, IMAGE = (255, 255, 255, 255), (200, 200, 200, 255), (60, 60, 60, 255), (20, 40, 120, 255), (180, 190, 200, 255)
HEADING_HEIGHT = 14.0


class Canvas:
    """RGBA pixels; what falls outside is cut off."""

    def __init__(self, width: int, height: int, colour: tuple = WHITE):
        self.pixels = np.empty((height, width, 4), np.uint8)
        self.pixels[:] = colour

    @property
    def size(self) -> tuple[int, int]:
        return self.pixels.shape[1], self.pixels.shape[0]

    def set_pixel(self, x: int, y: int, colour: tuple) -> None:
        w, h = self.size
        if 0 <= x < w and 0 <= y < h:
            self.pixels[y, x] = colour

    def fill(self, x: int, y: int, w: int, h: int, colour: tuple) -> None:
        self.pixels[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = colour

    def rectangle(self, x: int, y: int, w: int, h: int, colour: tuple) -> None:
        self.horizontal(x, y, w, colour)
        self.horizontal(x, y + h - 1, w, colour)
        self.vertical(x, y, h, colour)
        self.vertical(x + w - 1, y, h, colour)

    def horizontal(self, x: int, y: int, w: int, colour: tuple) -> None:
        if y >= 0:
            self.fill(x, y, w, 1, colour)

    def vertical(self, x: int, y: int, h: int, colour: tuple) -> None:
        if x >= 0:
            self.fill(x, y, 1, h, colour)

    def blit(self, image: np.ndarray, x: int, y: int, w: int, h: int) -> None:
        """Puts an RGBA image there, scaled to the nearest pixel."""
        if w < 1 or h < 1 or not image.size:
            return
        scaled = image[np.arange(h) * image.shape[0] // h][:, np.arange(w) * image.shape[1] // w]
        cw, ch = self.size
        x0, y0, x1, y1 = max(0, x), max(0, y), min(cw, x + w), min(ch, y + h)
        if x0 < x1 and y0 < y1:
            self.pixels[y0:y1, x0:x1] = scaled[y0 - y : y1 - y, x0 - x : x1 - x]

    def png(self) -> bytes:
        return encode_png(self.pixels)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


@functools.lru_cache(maxsize=4096)
def _piece(*runs: tuple[bytes, int]) -> tuple[bytes, int, int]:
    """Runs of equal rows, deflated so that pieces can follow one another; their checksum and length."""
    data = b"".join(row * n for row, n in runs)
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    return deflate.compress(data) + deflate.flush(zlib.Z_FULL_FLUSH), zlib.adler32(data), len(data)


def _combined(a: int, b: int, length: int) -> int:
    """The Adler-32 checksum of two stretches of bytes by theirs and the second one's length."""
    base = 65521
    low = ((a & 0xFFFF) + (b & 0xFFFF) - 1) % base
    high = ((a >> 16) + (b >> 16) + length * ((a & 0xFFFF) - 1)) % base
    return high << 16 | low


def _deflated(pixels: np.ndarray) -> bytes:
    """The rows of an image as a zlib stream. Where most rows are as the one before, runs of them are deflated once for all images that have them."""
    h, w = pixels.shape[:2]
    whole = np.ascontiguousarray(pixels).view(np.uint32).reshape(h, w)
    first = np.flatnonzero(np.concatenate([[True], (whole[1:] != whole[:-1]).any(axis=1)]))
    if 2 * len(first) > h:
        return zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 4)], axis=1).tobytes(), 6)
    runs = [(b"\0" + whole[k].tobytes(), n) for k, n in zip(first.tolist(), np.diff([*first, h]).tolist(), strict=True)]
    out, check = [b"\x78\x9c"], 1
    for k in range(0, len(runs), 2):
        data, own, length = _piece(*runs[k : k + 2])
        out.append(data)
        check = _combined(check, own, length)
    return b"".join([*out, b"\x03\x00", struct.pack(">I", check)])


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGBA PNG."""
    h, w = pixels.shape[:2]
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", _deflated(pixels)) + _chunk(b"IEND", b"")


def render_fragments(fragments: list[dict], images: list[np.ndarray], width: int, page_width: float = 612.0, page_height: float = 792.0) -> bytes:
    """A page from its fragments: bars where text is, images in the middle."""
    scale = width / page_width
    canvas = Canvas(width, max(1, round(page_height * scale)))
    w, h = canvas.size
    canvas.rectangle(0, 0, w, h, BORDER)
    for image in images:
        k = min(w * 0.8 / image.shape[1], h * 0.8 / image.shape[0])
        iw, ih = max(1, int(image.shape[1] * k)), max(1, int(image.shape[0] * k))
        canvas.blit(image, (w - iw) // 2, (h - ih) // 2, iw, ih)
    for f in fragments:
        tall = max(1, round(f["height"] * scale * 0.6))
        canvas.fill(round(f["x"] * scale), h - round(f["y"] * scale) - tall, max(1, round(f["width"] * scale)), tall, HEADING if f["height"] >= HEADING_HEIGHT else TEXT)
    return canvas.png()


def render_layout(text: str, kind: str, width: int) -> bytes:
    """A page of which only text and kind are known: a bar for each line, or a frame for a scan."""
    canvas = Canvas(width, round(width * RATIO))
    w, h = canvas.size
    canvas.rectangle(0, 0, w, h, BORDER)
    margin, step = w // 12, max(6, h // 60)
    if kind == "scanned_image":
        canvas.fill(margin, margin, w - 2 * margin, h - 2 * margin, IMAGE)
        canvas.rectangle(margin, margin, w - 2 * margin, h - 2 * margin, BORDER)
    elif kind != "empty":
        y = margin
        for line in (text or "").splitlines():
            for at in range(0, max(1, len(line)), 90):
                if y + step > h - margin:
                    break
                part = line[at : at + 90].strip()
                if part:
                    title = part.isupper() or part.startswith("#")
                    canvas.fill(margin, y, max(2, (w - 2 * margin) * len(part) // 90), max(2, step // 2), HEADING if title else TEXT)
                y += step
    return canvas.png()


def render_pages(pages: DataFrame, max_width: int = 1024, cache: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number, width, png) for pages(doc_id, page_number, text, kind); rows that cache(doc_id, page_number, width, png) has are taken from it."""
    width = max(NARROWEST, min(WIDEST, max_width))
    wanted = pages.select("doc_id", "page_number", "text", "kind")
    if cache is not None:
        own = cache.filter(F.col("width") == width)
        wanted = wanted.join(own.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                yield pd.DataFrame({"doc_id": part["doc_id"], "page_number": part["page_number"], "width": width, "png": [render_layout(t, k, width) for t, k in zip(part["text"], part["kind"], strict=True)]})

    kinds = dict(wanted.dtypes)
    out = wanted.mapInPandas(run, f"doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, width int, png binary")
    if cache is None:
        return out
    hits = own.join(pages.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_semi").select(out.columns)
    return hits.unionByName(out)


def data_uri(png):
    """A column of PNG bytes as data: addresses."""
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))
