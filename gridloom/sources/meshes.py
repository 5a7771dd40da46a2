"""Mesh files by their ending, and a reader for the compact binary one."""

from __future__ import annotations

import base64
import gzip
import json
import struct
import zlib
from pathlib import Path

import numpy as np

MZ3_MAGIC = 23117


def mz3(v: np.ndarray, f: np.ndarray) -> bytes:
    return struct.pack("<HHIII", MZ3_MAGIC, 3, len(f), len(v), 0) + f.astype("<i4").tobytes() + v.astype("<f4").tobytes()


def read_mz3(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a mesh file, compressed or not."""
    b = Path(path).read_bytes()
    b = gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b
    magic, has, nf, nv, skip = struct.unpack_from("<HHIII", b)
    if magic != MZ3_MAGIC or not has & 1 or not has & 2:
        raise ValueError("not a mesh with faces and vertices")
    at = 16 + skip
    f = np.frombuffer(b, "<i4", 3 * nf, at).reshape(-1, 3)
    return np.frombuffer(b, "<f4", 3 * nv, at + 12 * nf).reshape(-1, 3).astype(float), f.astype(int)


def off(v, f) -> bytes:
    return ("OFF\n%d %d 0\n" % (len(v), len(f)) + "".join("%g %g %g\n" % tuple(p) for p in v) + "".join("3 %d %d %d\n" % tuple(t) for t in f)).encode()


def obj(v, f) -> bytes:
    return ("".join("v %g %g %g\n" % tuple(p) for p in v) + "".join("f %d %d %d\n" % tuple(t + 1) for t in f)).encode()


def stl(v, f) -> bytes:
    p = v[f].astype("<f4")
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-20)
    row = np.zeros(len(f), [("n", "<f4", 3), ("p", "<f4", (3, 3)), ("k", "<u2")])
    row["n"], row["p"] = n, p
    return b"binary".ljust(80, b"\0") + struct.pack("<I", len(f)) + row.tobytes()


def ply(v, f) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(v)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(f)}\nproperty list uchar int vertex_indices\nend_header\n"
    row = np.zeros(len(f), [("n", "u1"), ("f", "<i4", 3)])
    row["n"], row["f"] = 3, f
    return head.encode() + v.astype("<f4").tobytes() + row.tobytes()


def vtk(v, f) -> bytes:
    four = np.c_[np.full(len(f), 3), f].astype(">i4")
    return f"# vtk DataFile Version 3.0\nmesh\nBINARY\nDATASET POLYDATA\nPOINTS {len(v)} float\n".encode() + v.astype(">f4").tobytes() + f"\nPOLYGONS {len(f)} {4 * len(f)}\n".encode() + four.tobytes()


def gii(v, f) -> bytes:
    def array(a, kind, intent):
        data = base64.b64encode(zlib.compress(a.tobytes())).decode()
        return f'<DataArray Intent="{intent}" DataType="{kind}" ArrayIndexingOrder="RowMajorOrder" Dimensionality="2" Dim0="{len(a)}" Dim1="3" Encoding="GZipBase64Binary" Endian="LittleEndian"><Data>{data}</Data></DataArray>'

    return ('<?xml version="1.0" encoding="UTF-8"?><GIFTI Version="1.0" NumberOfDataArrays="2">' + array(v.astype("<f4"), "NIFTI_TYPE_FLOAT32", "NIFTI_INTENT_POINTSET") + array(f.astype("<i4"), "NIFTI_TYPE_INT32", "NIFTI_INTENT_TRIANGLE") + "</GIFTI>").encode()


def freesurfer(v, f) -> bytes:
    return b"\xff\xff\xfe" + b"created by gridloom\n\n" + struct.pack(">ii", len(v), len(f)) + v.astype(">f4").tobytes() + f.astype(">i4").tobytes()


def plain_json(v, f) -> bytes:
    return json.dumps({"vertices": np.round(v, 6).ravel().tolist(), "faces": f.ravel().tolist()}).encode()


def jmsh(v, f) -> bytes:
    def array(a, kind):
        return {"_ArrayType_": kind, "_ArraySize_": list(a.shape), "_ArrayZipType_": "zlib", "_ArrayZipSize_": a.size, "_ArrayZipData_": base64.b64encode(zlib.compress(a.tobytes())).decode()}

    return json.dumps({"MeshVertex3": array(v.astype("<f4"), "single"), "MeshTri3": array((f + 1).astype("<i4"), "int32")}).encode()


WRITERS = {".mz3": mz3, ".off": off, ".obj": obj, ".stl": stl, ".ply": ply, ".vtk": vtk, ".gii": gii, ".inflated": freesurfer, ".pial": freesurfer, ".json": plain_json, ".jmsh": jmsh}


def write(path: str, v: np.ndarray, f: np.ndarray) -> str:
    """Write by the ending; an unknown one gets ``.mz3``."""
    end = Path(path).suffix.lower()
    if end not in WRITERS:
        path, end = path + ".mz3", ".mz3"
    Path(path).write_bytes(WRITERS[end](np.asarray(v, float), np.asarray(f, int)))
    return path
