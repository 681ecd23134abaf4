"""Minimal PNG writer for fixtures."""

import struct
import zlib


def write_png(path, array):
    h, w = array.shape[:2]
    colour = 2 if array.ndim == 3 else 0
    raw = b"".join(b"\0" + array[y].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
