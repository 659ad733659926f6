"""Test helpers: PNG writer (zlib + struct) and row comparison."""

import math
import struct
import zlib

import numpy as np


def write_png(path, arr):
    """Write ``arr`` (uint8, HxW grey, HxWx3 RGB or HxWx4 RGBA) as PNG."""
    arr = np.ascontiguousarray(arr, dtype=np.uint8)
    h, w = arr.shape[:2]
    c = 1 if arr.ndim == 2 else arr.shape[2]
    color_type = {1: 0, 3: 2, 4: 6}[c]
    raw = b"".join(b"\x00" + arr[i].tobytes() for i in range(h))

    def chunk(tag, data):
        return (struct.pack(">I", len(data)) + tag + data
                + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF))

    png = (b"\x89PNG\r\n\x1a\n"
           + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color_type, 0, 0, 0))
           + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    with open(path, "wb") as f:
        f.write(png)


def _norm(v, digits=9):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def rows_of(pdf, digits=9):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c], digits) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def same_rows(a, b, digits=9):
    ca, ra = rows_of(a, digits)
    cb, rb = rows_of(b, digits)
    return ca == cb and ra == rb
