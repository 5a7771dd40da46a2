"""Dense numpy blocks for operators that no built-in expression can hold.

``by_slab`` cuts each volume into runs of z planes with a halo, so that one task holds a slab, whatever the
volume's size; ``by_columns`` regroups the sites to whole lines along z; ``by_chain`` is for what reaches through a volume
by its neighbours alone: slabs tell what stands at their first and last planes, one task a volume ties these
together, and slabs finish with what it found. ``by_volume`` hands over whole volumes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lattice import Lattice

ROW = "t int, z int, y int, x int, v double"
SLAB_VOXELS = 1 << 17


def _dense(p: pd.DataFrame, nx: int, ny: int, z0: int, n: int) -> np.ndarray:
    a = np.full((n, ny, nx), np.nan)
    a[p.z.to_numpy() - z0, p.y.to_numpy(), p.x.to_numpy()] = p.v.to_numpy()
    return a


def _rows(t: int, z0: int, a: np.ndarray) -> pd.DataFrame:
    z, y, x = (i.ravel().astype(np.int32) for i in np.indices(a.shape))
    return pd.DataFrame({"t": np.int32(t), "z": z + np.int32(z0), "y": y, "x": x, "v": a.ravel().astype(float)})


def kept(df: DataFrame) -> DataFrame:
    """Written once to the session's checkpoint folder, if it has one; else it is computed anew for each use."""
    sc, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None:
            return df
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def by_slab(lat: Lattice, halo: int, f: Callable[..., np.ndarray], cores: bool = False) -> Lattice:
    """``f(values[z, y, x], first z)`` on slabs with ``halo`` planes on either side, cut at the lattice's ends.

    With ``cores`` it is ``f(values, first z, t, core)``, and what it returns are the planes of the slice ``core`` alone.
    """
    nx, ny, nz, _ = lat.shape
    depth = min(nz, max(2 * halo, 8, SLAB_VOXELS // (nx * ny)))
    z = F.col("z")
    lo, hi = F.greatest(F.lit(0), F.floor((z - halo) / depth)), F.least(F.lit((nz - 1) // depth), F.floor((z + halo) / depth))
    dealt = lat.df.withColumn("v", F.col("v").cast("double")).withColumn("b", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))

    def run(key, p):
        b = int(key[1])
        z0, z1 = max(0, b * depth - halo), min(nz, (b + 1) * depth + halo)
        core = slice(b * depth - z0, b * depth - z0 + min(depth, nz - b * depth))
        a = _dense(p, nx, ny, z0, z1 - z0)
        return _rows(int(key[0]), b * depth, f(a, z0, int(key[0]), core) if cores else f(a, z0)[core])

    return lat.with_df(dealt.groupBy("t", "b").applyInPandas(run, ROW))


def _columns(names: list[str], t: int, z0: int, arrays: list[np.ndarray]) -> pd.DataFrame:
    out = _rows(t, z0, arrays[0]).rename(columns={"v": names[0]})
    for c, a in zip(names[1:], arrays[1:], strict=True):
        out[c] = a.ravel().astype(float)
    return out


def _several(p: pd.DataFrame, names: list[str], nx: int, ny: int, z0: int, n: int) -> list[np.ndarray]:
    at = p.z.to_numpy() - z0, p.y.to_numpy(), p.x.to_numpy()
    out = [np.full((n, ny, nx), np.nan) for _ in names]
    for a, c in zip(out, names, strict=True):
        a[at] = p[c].to_numpy()
    return out


def _schema(names: list[str]) -> str:
    return "t int, z int, y int, x int, " + ", ".join(f"{c} double" for c in names)


def by_planes(df: DataFrame, shape: tuple, names: list[str], f: Callable, out: list[str]) -> DataFrame:
    """``f(*arrays) -> arrays`` on the columns ``names`` of runs of planes, which see nothing of each other."""
    nx, ny, nz = shape[:3]
    depth = max(1, min(nz, SLAB_VOXELS // (nx * ny)))

    def run(key, p):
        z0 = int(key[1]) * depth
        return _columns(out, int(key[0]), z0, f(*_several(p, names, nx, ny, z0, min(depth, nz - z0))))

    dealt = df.select("t", "z", "y", "x", *names, F.floor(F.col("z") / depth).alias("b"))
    return dealt.groupBy("t", "b").applyInPandas(run, _schema(out))


def by_columns(df: DataFrame, shape: tuple, names: list[str], f: Callable, out: list[str]) -> DataFrame:
    """``f(*arrays) -> arrays``, each ``[z, site]``, on the columns ``names`` of whole lines along z; a task holds a few lines."""
    nx, ny, nz = shape[:3]
    lines = max(1, SLAB_VOXELS // nz)

    def run(key, p):
        first = int(key[1]) * lines
        n = min(lines, nx * ny - first)
        at = p.z.to_numpy(), p.y.to_numpy() * nx + p.x.to_numpy() - first
        got = [np.full((nz, n), np.nan) for _ in names]
        for a, c in zip(got, names, strict=True):
            a[at] = p[c].to_numpy()
        z, i = (k.ravel() for k in np.indices((nz, n), np.int32))
        i = i + np.int32(first)
        return pd.DataFrame({"t": np.int32(key[0]), "z": z, "y": i // np.int32(nx), "x": i % np.int32(nx)} | {c: a.ravel().astype(float) for c, a in zip(out, f(*got), strict=True)})

    dealt = df.select("t", "z", "y", "x", *names, F.floor((F.col("y") * nx + F.col("x")) / lines).alias("b"))
    return dealt.groupBy("t", "b").applyInPandas(run, _schema(out))


#: Planes of a slab of ``by_chain`` at least: two of them are told to the task that ties slabs together.
CHAIN_PLANES = 16


def chain_depth(shape: tuple) -> int:
    return min(shape[2], max(CHAIN_PLANES, SLAB_VOXELS // (shape[0] * shape[1])))


def by_chain(df: DataFrame, shape: tuple, names: list[str], tell: Callable, tie: Callable, finish: Callable, out: list[str], pick: Callable | None = None) -> DataFrame:
    """What spreads from neighbour to neighbour, in slabs of z planes.

    ``tell(arrays, b, last)`` yields pairs of a number k and what slab b tells for it; ``tie(list of (b, what it told))`` goes over the slabs of a
    volume in order for one k and yields pairs of a slab and what it gets to know; ``finish(arrays, b, last, {k: what it got})`` returns the arrays of
    the columns ``out``. ``pick`` may choose among the rows ``t, b, k, size, data`` between; there ``tie`` yields a size as well.
    """
    nx, ny, nz = shape[:3]
    depth = chain_depth(shape)
    last = (nz - 1) // depth
    told, sized = "t int, b int, k int, size double, data binary", pick is not None

    def arrays(b, p):
        return _several(p, names, nx, ny, b * depth, min(depth, nz - b * depth))

    def rows(t, found):
        return pd.DataFrame([(t, b, k, size, pickle.dumps(x, 5)) for b, k, size, x in found], columns=["t", "b", "k", "size", "data"])

    def first(key, p):
        b = int(key[1])
        return rows(int(key[0]), ((b, k, 0.0, x) for k, x in tell(arrays(b, p), b, last)))

    def second(key, p):
        t, k = int(key[0]), int(key[1])
        met = [(int(b), pickle.loads(x)) for b, x in sorted(zip(p.b, p.data, strict=True), key=lambda r: r[0])]
        return rows(t, ((b, k, *(x if sized else (0.0, x))) for b, x in tie(met)))

    def third(key, p, q):
        t, b = int(key[0]), int(key[1])
        if not len(p):
            return pd.DataFrame(columns=["t", "z", "y", "x", *out])
        return _columns(out, t, b * depth, finish(arrays(b, p), b, last, {int(k): pickle.loads(x) for k, x in zip(q.k, q.data, strict=True)}))

    dealt = df.select("t", "z", "y", "x", *names, F.floor(F.col("z") / depth).cast("int").alias("b"))
    met = dealt.groupBy("t", "b").applyInPandas(first, told).groupBy("t", "k").applyInPandas(second, told)
    met = pick(met) if pick else met
    return dealt.groupBy("t", "b").cogroup(met.groupBy("t", "b")).applyInPandas(third, _schema(out))


def by_volume(lat: Lattice, f: Callable[[np.ndarray], np.ndarray], shape: tuple | None = None, **more) -> Lattice:
    """``f(values[z, y, x])`` on whole volumes; ``shape`` if the size changes."""
    nx, ny, nz, nt = lat.shape

    def run(key, p):
        return _rows(int(key[0]), 0, f(_dense(p, nx, ny, 0, nz)))

    df = lat.df.withColumn("v", F.col("v").cast("double")).groupBy("t").applyInPandas(run, ROW)
    return lat.with_df(df, shape=(*shape[:3], nt) if shape else lat.shape, **more)


def with_volume(lat: Lattice, other: Lattice, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Lattice:
    """``f(values, other's values)`` on whole volumes of two images of one size."""
    if lat.shape[:3] != other.shape[:3]:
        raise ValueError("images differ in size")
    nx, ny, nz, _ = lat.shape
    b = other.df if other.shape[3] > 1 or lat.shape[3] == 1 else other.df.drop("t").crossJoin(F.broadcast(lat.df.select("t").distinct()))

    def run(key, p, q):
        return _rows(int(key[0]), 0, f(_dense(p, nx, ny, 0, nz), _dense(q, nx, ny, 0, nz)))

    return lat.with_df(lat.df.groupBy("t").cogroup(b.groupBy("t")).applyInPandas(run, ROW))
