"""NIfTI-1, NIfTI-2 and ANALYZE images: header codec, a Spark data source, and writers.

``spark.read.format("nifti").load(path)`` yields voxel rows ``img, t, z, y, x, v``. The driver reads headers only;
each partition reads the bytes of a few planes (compressed files, which can't be entered in the middle, are one
partition a file). Files are read through pyarrow's file systems, so a path may name a remote store.
"""

from __future__ import annotations

import gzip
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.lattice import Lattice

#: Data type codes: numpy type and values in a voxel.
TYPES = {2: ("u1", 1), 4: ("i2", 1), 8: ("i4", 1), 16: ("f4", 1), 64: ("f8", 1), 128: ("u1", 3), 256: ("i1", 1), 512: ("u2", 1), 768: ("u4", 1), 1024: ("i8", 1), 1280: ("u8", 1), 2304: ("u1", 4)}
CODES = {"char": 2, "short": 4, "int": 8, "float": 16, "double": 64, "ushort": 512}

# field, format, offset
V1 = {"dim": ("8h", 40), "intent_code": ("h", 68), "datatype": ("h", 70), "bitpix": ("h", 72), "pixdim": ("8f", 76), "vox_offset": ("f", 108), "scl_slope": ("f", 112), "scl_inter": ("f", 116), "xyzt_units": ("B", 123), "cal_max": ("f", 124), "cal_min": ("f", 128), "descrip": ("80s", 148), "qform_code": ("h", 252), "sform_code": ("h", 254), "quatern": ("6f", 256), "srow": ("12f", 280), "intent_name": ("16s", 328), "magic": ("4s", 344)}
V2 = {"magic": ("8s", 4), "datatype": ("h", 12), "bitpix": ("h", 14), "dim": ("8q", 16), "pixdim": ("8d", 104), "vox_offset": ("q", 168), "scl_slope": ("d", 176), "scl_inter": ("d", 184), "cal_max": ("d", 192), "cal_min": ("d", 200), "descrip": ("80s", 240), "qform_code": ("i", 344), "sform_code": ("i", 348), "quatern": ("6d", 352), "srow": ("12d", 400), "xyzt_units": ("i", 500), "intent_code": ("i", 504), "intent_name": ("16s", 508)}


def open_bytes(path: str, at: int = 0, n: int | None = None) -> bytes:
    """Bytes of a file, decompressed by its name's ending."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if path.endswith((".gz", ".zst")):
        with system.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else "zstd") as f:
            data = f.read()
        return data[at : None if n is None else at + n]
    with system.open_input_file(inner) as f:
        f.seek(at)
        return f.read(n)


def parse_header(b: bytes) -> dict:
    """Header fields by name, with ``order`` (byte order) and ``version`` 0 (ANALYZE), 1 or 2."""
    for order in "<>":
        size = struct.unpack(order + "i", b[:4])[0]
        if size in (348, 540):
            break
    else:
        raise ValueError("not a NIfTI or ANALYZE header")
    fields = V1 if size == 348 else V2
    h: dict = {"order": order}
    for name, (fmt, at) in fields.items():
        v = struct.unpack_from(order + fmt, b, at)
        h[name] = v[0] if len(v) == 1 else v
    h["version"] = 2 if size == 540 else 1 if h["magic"][:2] in (b"n+", b"ni") else 0
    for name in ("descrip", "intent_name"):
        h[name] = h[name].split(b"\0")[0].decode("latin-1")
    if h["version"] == 0:
        h |= {"qform_code": 0, "sform_code": 0, "scl_slope": 0.0, "vox_offset": 0}
    return h


def quaternion_affine(h: dict) -> np.ndarray:
    """The 3 by 4 matrix of the quaternion form."""
    b, c, d, x, y, z = h["quatern"]
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])
    p = np.array(h["pixdim"][1:4]) * [1, 1, -1 if h["pixdim"][0] < 0 else 1]
    return np.c_[r * p, [x, y, z]]


def geometry(h: dict) -> tuple[tuple, tuple, tuple]:
    """Shape (axes from the fifth on folded into t), voxel sizes, affine."""
    dim = [max(1, int(n)) for n in h["dim"][1 : 1 + max(1, min(7, int(h["dim"][0])))]] + [1] * 7
    shape = (*dim[:3], int(np.prod(dim[3:7])))
    pix = tuple(float(abs(p)) or 1.0 for p in h["pixdim"][1:4]) + (float(h["pixdim"][4]),)
    if h["sform_code"] <= 0 and h["qform_code"] <= 0:
        m = np.c_[np.diag(pix[:3]), np.zeros(3)]
    elif h["sform_code"] >= h["qform_code"]:
        m = np.array(h["srow"]).reshape(3, 4)
        if abs(np.linalg.det(m[:, :3])) < 1e-12 and h["qform_code"] > 0:
            m = quaternion_affine(h)
    else:
        m = quaternion_affine(h)
    return shape, pix, tuple(tuple(float(v) for v in r) for r in m)


def data_path(path: str) -> str:
    """The file with the voxels: the ``.img`` beside a ``.hdr``."""
    return path.replace(".hdr", ".img") if ".hdr" in path else path


def read_header(path: str) -> dict:
    return parse_header(open_bytes(path, 0, 540).ljust(540, b"\0"))


def scaled(raw: bytes, h: dict) -> np.ndarray:
    """Values with slope and intercept applied; colour voxels have a last axis."""
    kind, n = TYPES[h["datatype"]] if h["datatype"] in TYPES else (None, 0)
    if kind is None:
        raise ValueError(f"data type {h['datatype']} is not supported")
    a = np.frombuffer(raw, h["order"] + kind).astype(float)
    slope = h["scl_slope"] if h["scl_slope"] and np.isfinite(h["scl_slope"]) else 1.0
    inter = h["scl_inter"] if h["scl_slope"] and np.isfinite(h["scl_inter"]) else 0.0
    a = a if n > 1 or (slope == 1 and inter == 0) else a * slope + inter
    return a.reshape(-1, n) if n > 1 else a


class Planes(InputPartition):
    def __init__(self, path: str, header: dict, first: int, last: int):
        self.path, self.header, self.first, self.last = path, header, first, last


class NiftiReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.voxels = int(options.get("voxelsPerPartition", 1 << 22))

    def partitions(self):
        out = []
        for path in self.paths:
            h = read_header(path)
            (nx, ny, nz, nt), _, _ = geometry(h)
            planes = nz * nt
            step = planes if path.endswith((".gz", ".zst")) else max(1, self.voxels // (nx * ny))
            out += [Planes(path, h, i, min(planes, i + step)) for i in range(0, planes, step)]
        return out

    def read(self, part: Planes) -> Iterator:
        import pyarrow as pa

        h = part.header
        (nx, ny, nz, _), _, _ = geometry(h)
        kind, n = TYPES[h["datatype"]]
        plane = nx * ny * n * np.dtype(kind).itemsize
        offset = 0 if ".hdr" in part.path else int(h["vox_offset"]) or (352 if h["version"] == 1 else 544)
        raw = open_bytes(data_path(part.path), offset + part.first * plane, (part.last - part.first) * plane)
        if len(raw) < (part.last - part.first) * plane:
            raise ValueError(f"{part.path} is shorter than its header says")
        v = scaled(raw, h)
        colours = 1 if v.ndim == 1 else v.shape[1]
        v = v.reshape(-1, ny, nx, colours)
        z, y, x = (i.ravel().astype(np.int32) for i in np.indices(v.shape[:3]))
        p = z + part.first
        for c in range(colours):  # colours become volumes
            t = p // nz * colours + c
            cols = (pa.array([part.path] * len(z)), *(pa.array(a.astype(np.int32)) for a in (t, p % nz, y, x)), pa.array(v[..., c].ravel()))
            yield pa.RecordBatch.from_arrays(list(cols), ["img", "t", "z", "y", "x", "v"])


class NiftiSource(DataSource):
    """The data source named ``nifti``."""

    @classmethod
    def name(cls):
        return "nifti"

    def schema(self):
        return "img string, t int, z int, y int, x int, v double"

    def reader(self, schema):
        return NiftiReader(self.options)


def read(spark: SparkSession, path: str, dtype: str = "double") -> Lattice:
    """An image file as a lattice."""
    spark.dataSource.register(NiftiSource)
    h = read_header(path)
    shape, pix, affine = geometry(h)
    colours = TYPES[h["datatype"]][1]
    shape = (*shape[:3], shape[3] * colours)
    df = spark.read.format("nifti").option("path", path).load()
    keep = tuple(sorted((k, h[k]) for k in ("cal_min", "cal_max", "datatype", "descrip", "qform_code", "sform_code", "scl_slope", "scl_inter", "intent_code")))
    return Lattice.of(df, shape, pix=pix, affine=affine, dtype=dtype, header=keep)


def least_version(lat: Lattice) -> int:
    """NIfTI-1 has sizes of 16 bits."""
    return 1 if max(lat.shape) < 1 << 15 else 2


def header_bytes(lat: Lattice, kind: str = "float", version: int = 1, order: str = "<") -> bytes:
    """What stands before the voxels in a single-file image."""
    t = _type(kind, order)
    f = lat.fields()
    nx, ny, nz, nt = lat.shape
    fields, size = (V1, 348) if version == 1 else (V2, 540)
    b = bytearray(size + 4)
    m = np.array(lat.affine, float)
    put = {
        "dim": (4 if nt > 1 else 3, nx, ny, nz, nt, 1, 1, 1), "datatype": CODES[kind], "bitpix": 8 * t.itemsize, "pixdim": (1.0, *map(float, lat.pix), 0.0, 0.0, 0.0),
        "vox_offset": size + 4, "scl_slope": 1.0, "scl_inter": 0.0, "cal_max": float(f.get("cal_max") or 0), "cal_min": float(f.get("cal_min") or 0), "xyzt_units": 10,
        "descrip": str(f.get("descrip", "")).encode("latin-1")[:79], "qform_code": 0, "sform_code": int(f.get("sform_code") or 1), "srow": tuple(m.ravel()),
        "magic": b"n+1\0" if version == 1 else b"n+2\0\r\n\x1a\n",
    }
    struct.pack_into(order + "i", b, 0, size)
    for name, v in put.items():
        fmt, at = fields[name]
        struct.pack_into(order + fmt, b, at, *(v if isinstance(v, tuple) else (v,)))
    return bytes(b)


def _type(kind: str, order: str = "<") -> np.dtype:
    return np.dtype(order + TYPES[CODES[kind]][0])


def voxel_bytes(a: np.ndarray, kind: str = "float", order: str = "<") -> bytes:
    """Values as they stand in a file; integers are rounded half away and saturate."""
    t = _type(kind, order)
    if t.kind in "ui":
        i = np.iinfo(t)
        a = np.clip(np.trunc(np.nan_to_num(a) + np.copysign(0.5, a)), i.min, i.max)
    return a.astype(t).tobytes()


def encode(a: np.ndarray, lat: Lattice, kind: str = "float", version: int = 1, order: str = "<") -> bytes:
    """A single-file image of values ``[t, z, y, x]``; integers are rounded half away and saturate."""
    return header_bytes(lat, kind, version, order) + voxel_bytes(a, kind, order)


#: Voxels of a run of the file that a task encodes.
RUN = 1 << 17


def encoded(lat: Lattice, kind: str = "float") -> DataFrame:
    """The voxels of an image file as runs in the file's order, ``run, data``, made on the executors; the last may be shorter.

    Sites without a row are NaN, but a run without any is left out.
    """
    total = int(np.prod(lat.shape))
    i = lat.linear_index().cast("long")

    def run(key, p):
        k = int(key[0])
        a = np.full(min(RUN, total - k * RUN), np.nan)
        a[p.i.to_numpy() - k * RUN] = p.v.to_numpy()
        return pd.DataFrame({"run": [k], "data": [voxel_bytes(a, kind)]})

    df = lat.df.select(i.alias("i"), F.col("v").cast("double").alias("v"), F.floor(i / RUN).alias("run"))
    return df.groupBy("run").applyInPandas(run, "run long, data binary")


def decoded(runs: DataFrame, head: dict) -> DataFrame:
    """Rows ``t, z, y, x, v`` of the runs of an image with a header, made on the executors."""
    (nx, ny, nz, _), _, _ = geometry(head)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = scaled(data, head)
                i = np.arange(len(v)) + k * RUN
                at = (i // (nx * ny * nz), i // (nx * ny) % nz, i // nx % ny, i % nx)
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in at), pa.array(v)], ["t", "z", "y", "x", "v"])

    return runs.select("run", "data").mapInArrow(run, "t int, z int, y int, x int, v double")


def write(lat: Lattice, path: str, kind: str = "float", version: int = 1) -> None:
    """Write one image file from the driver, which sees a few of the runs that executors encode at a time; ``.gz`` and ``.zst`` names are compressed."""
    version = max(version, least_version(lat))
    head = header_bytes(lat, kind, version)
    if pair := ".hdr" in path or ".img" in path:
        alone = bytearray(head[:-4])
        struct.pack_into("<" + V1["magic"][0], alone, V1["magic"][1], b"ni1\0")
        struct.pack_into("<f", alone, V1["vox_offset"][1], 0.0)
        _put(path.replace(".img", ".hdr"), [bytes(alone)])
    _put(path.replace(".hdr", ".img"), _parts(lat, kind, b"" if pair else head))


def _parts(lat: Lattice, kind: str, head: bytes) -> Iterator[bytes]:
    total, k = int(np.prod(lat.shape)), 0
    gap = lambda at: voxel_bytes(np.full(min(RUN, total - at * RUN), np.nan), kind)
    yield head
    for run, data in encoded(lat, kind).orderBy("run").toLocalIterator():
        yield from map(gap, range(k, run))
        yield bytes(data)
        k = run + 1
    yield from map(gap, range(k, -(-total // RUN)))


def _put(path: str, parts: Iterable[bytes]) -> None:
    """Under another name until it is whole: the parts may still be read from the file it replaces."""
    import pyarrow as pa

    gz, zst = path.endswith(".gz"), path.endswith(".zst")
    with gzip.open(f"{path}.part", "wb", 6) if gz else pa.CompressedOutputStream(f"{path}.part", "zstd") if zst else open(f"{path}.part", "wb") as f:
        for p in parts:
            f.write(p)
    os.replace(f"{path}.part", path)


#: Endings and pairs by the value of the output type setting.
OUTPUT_TYPES = {None: ".nii.gz", "NIFTI": ".nii", "NIFTI_GZ": ".nii.gz", "NIFTI_PAIR": ".hdr", "NIFTI_ZST": ".nii.zst", "NIFTI2": ".nii", "NIFTI2_GZ": ".nii.gz"}


def output_path(name: str, setting: str | None = None, gz: int | None = None) -> tuple[str, int]:
    """A name with its ending, and the version to write."""
    version = 2 if setting and "2" in setting else 1
    if name.endswith((".nii", ".nii.gz", ".nii.zst", ".hdr", ".img")):
        return name, version
    end = OUTPUT_TYPES.get(setting, ".nii.gz")
    if gz is not None and end in (".nii", ".nii.gz") and gz in (0, 1):
        end = ".nii.gz" if gz else ".nii"
    return name + end, version
