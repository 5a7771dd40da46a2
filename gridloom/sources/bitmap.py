"""Slices as PNG images, with colour tables and an overlay."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from gridloom.lattice import Lattice
from gridloom.operators.reduce import robust_range

#: Colour tables by control points at equal steps.
TABLES = {
    "gray": [(0, 0, 0), (255, 255, 255)], "red": [(0, 0, 0), (255, 0, 0)], "green": [(0, 0, 0), (0, 255, 0)], "blue": [(0, 0, 0), (0, 0, 255)],
    "cyan": [(0, 0, 0), (0, 255, 255)], "yellow": [(0, 0, 0), (255, 255, 0)], "bluegreen": [(0, 0, 255), (0, 255, 0)], "redyellow": [(255, 0, 0), (255, 255, 0)],
    "viridis": [(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)], "inferno": [(0, 0, 4), (87, 16, 110), (188, 55, 84), (249, 142, 9), (252, 255, 164)],
    "magma": [(0, 0, 4), (81, 18, 124), (183, 55, 121), (252, 137, 97), (252, 253, 191)], "plasma": [(13, 8, 135), (126, 3, 168), (204, 71, 120), (248, 149, 64), (240, 249, 33)],
}


def table(name: str) -> np.ndarray:
    """256 colours."""
    p = np.array(TABLES[name], float)
    at = np.linspace(0, len(p) - 1, 256)
    return np.stack([np.interp(at, np.arange(len(p)), p[:, k]) for k in range(3)], 1).round().astype(np.uint8)


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit image ``[row, column, 3 or 4]``."""
    h, w, c = rgba.shape

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    raw = np.c_[np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, -1)].tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def plane(lat: Lattice, axis: str, fraction: float) -> tuple[np.ndarray, int]:
    """One slice as rows from the top; only its voxels leave Spark."""
    n = dict(zip("xyz", lat.shape, strict=False))
    at = min(n[axis] - 1, max(0, round(fraction * (n[axis] - 1))))
    u, v = [c for c in "xyz" if c != axis]
    p = lat.df.where(f"t = 0 and {axis} = {at}").select(u, v, "v").toPandas()
    out = np.zeros((n[v], n[u]))
    out[p[v], p[u]] = p["v"]
    return out[::-1], at


def bitmap(lat: Lattice, path: str | None = None, slices: dict[str, list[float]] | None = None, lut: str = "gray", window: tuple | None = None, overlay: Lattice | None = None, overlay_lut: str = "redyellow", overlay_min: float = 0.0, alpha: float = 0.5, zoom: int = 1) -> bytes:
    """Tiles of slices in RAS order, side by side, as PNG; written to ``path`` if given."""
    ras = lat.apply("ras")
    lo, hi = window or robust_range(ras).first()
    over = overlay.apply("ras") if overlay is not None else None
    top = over.df.agg({"v": "max"}).first()[0] if over is not None else 1.0
    tiles = []
    for axis, at in (slices or {"z": [0.5], "y": [0.5], "x": [0.5]}).items():
        for f in at:
            a, _ = plane(ras, axis, f)
            level = np.clip((a - lo) / ((hi - lo) or 1.0) * 255, 0, 255).round().astype(int)
            rgb = table(lut)[level].astype(float)
            if over is not None:
                b, _ = plane(over, axis, f)
                c = table(overlay_lut)[np.clip((b - overlay_min) / ((top - overlay_min) or 1.0) * 255, 0, 255).round().astype(int)]
                rgb = np.where((b > overlay_min)[..., None], (1 - alpha) * rgb + alpha * c, rgb)
            tiles.append(np.repeat(np.repeat(rgb, zoom, axis=0), zoom, axis=1))
    h = max(t.shape[0] for t in tiles)
    data = png(np.concatenate([np.pad(t, ((0, h - t.shape[0]), (0, 0), (0, 0))) for t in tiles], axis=1).round())
    if path:
        with open(path, "wb") as f:
            f.write(data)
    return data
