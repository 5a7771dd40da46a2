"""Separable operators: Gaussian smoothing, resampling by a factor, distance transforms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.lattice import Lattice
from gridloom.operators import operator
from gridloom.plans import blocks
from gridloom.plans.blocks import ROW, _dense, _rows, by_columns, by_planes, by_slab


def _line_matrix(n: int, sigma: float, width: float) -> np.ndarray:
    """Gaussian weights from each site to each; rows sum to one. A negative width rounds the cut-off."""
    cut = max(1, int(math.floor(abs(width) * sigma + 0.5)) if width < 0 else math.ceil(width * sigma))
    d = np.arange(n)[:, None] - np.arange(n)[None]
    w = np.where(np.abs(d) <= cut, np.exp(-(d.astype(float) ** 2) / (2 * sigma * sigma)), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def gaussian(lat: Lattice, sigma_mm: float, width: float = -6.0) -> Lattice:
    """Smooth every volume along x, y and z; a negative sigma counts voxels. Edges are renormalised."""
    s = [abs(sigma_mm) if sigma_mm < 0 else sigma_mm / d for d in lat.pix[:3]]
    if sigma_mm == 0:
        return lat
    nx, ny, nz, _ = lat.shape
    mats = [_line_matrix(n, k, width) if n > 1 and k > 0 else None for n, k in zip((nx, ny), s, strict=False)]
    mz = (s[2], nz) if nz > 1 and s[2] > 0 else None
    halo = (max(1, int(math.floor(abs(width) * s[2] + 0.5)) if width < 0 else math.ceil(width * s[2]))) if mz else 0

    def run(a, z0):
        a = a @ mats[0].T if mats[0] is not None else a
        a = np.einsum("jk,zkx->zjx", mats[1], a, optimize=True) if mats[1] is not None else a
        if mz:  # weights of this slab's planes; the halo holds all that the core's planes reach
            m = _line_matrix(len(a), s[2], width)
            a = np.tensordot(m, a, axes=(1, 0))
        return a

    return by_slab(lat, halo, run)


@operator("s")
def smooth(lat, sigma):
    return gaussian(lat, float(sigma))


def _dog(lat, first, second):
    a, b = float(first), float(second)
    if a == b or min(a, b) < 0:
        raise ValueError("two different sigmas of at least 0 are needed")
    narrow = gaussian(lat, min(a, b), 2.5)
    wide = gaussian(narrow, math.sqrt(max(a, b) ** 2 - min(a, b) ** 2), 2.5)
    return wide.join(narrow, lambda w, n: w - n if a > b else n - w)


def crossings(a: np.ndarray, axis: str | None = None) -> np.ndarray:
    """Where the sign changes towards a neighbour: 1; in the plane across ``axis``, or in all directions."""
    p = np.pad(a, 1, mode="edge")
    out = np.zeros(a.shape)
    for k, c in enumerate("zyx"):
        if c == axis:
            continue
        for s in (-1, 1):
            b = np.roll(p, s, axis=k)[1:-1, 1:-1, 1:-1]
            out[(a > 0) & (b <= -a)] = 1
            out[(a < 0) & (b > -a)] = 1
    return out


@operator("dogr")
def dogr(lat, a, b):
    """Difference of Gaussians."""
    return _dog(lat, a, b)


def _dog_at(axis):
    return lambda lat, a, b: by_slab(_dog(lat, a, b), 1, lambda v, _: crossings(v, axis))


for _name, _axis in (("dog", None), ("dogx", "x"), ("dogy", "y"), ("dogz", "z")):
    operator(_name)(_dog_at(_axis))


@operator("unsharp")
def unsharp(lat, sigma, amount):
    """Sharpen by the difference to a smoothed image, within the original range."""
    row = lat.df.agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    sharp = lat.join(gaussian(lat, float(sigma), 2.5), lambda v, g: v + (v - g) * float(amount))
    return sharp.with_row(row, lambda v: F.least(F.greatest(v, F.col("mn")), F.col("mx")))


def _sinc(x):
    return np.sinc(x)


def _cubic(b: float, c: float):
    def f(t):
        t = np.abs(t)
        near = ((12 - 9 * b - 6 * c) * t**3 + (-18 + 12 * b + 6 * c) * t**2 + (6 - 2 * b)) / 6
        far = ((-b - 6 * c) * t**3 + (6 * b + 30 * c) * t**2 + (-12 * b - 48 * c) * t + (8 * b + 24 * c)) / 6
        return np.where(t < 1, near, np.where(t < 2, far, 0.0))

    return f


#: Resampling filters by number: support and weight.
FILTERS = {
    0: (0.5, lambda t: ((t > -0.5) & (t <= 0.5)).astype(float)),
    1: (1.0, lambda t: np.maximum(0.0, 1 - np.abs(t))),
    2: (2.0, _cubic(1.0, 0.0)),
    3: (3.0, lambda t: np.where(np.abs(t) < 3, _sinc(t) * _sinc(t / 3), 0.0)),
    4: (2.0, _cubic(1 / 3, 1 / 3)),
}


def resize_matrix(n: int, m: int, method: int, rows: range | None = None, first: int = 0, size: int | None = None) -> np.ndarray:
    """Weights ``m`` by ``n``; indices outside are reflected, and the filter widens when shrinking.

    ``rows`` are some of them alone, over the ``size`` sites from ``first`` on, which must hold all that these reach.
    """
    support, f = FILTERS[method]
    scale = m / n
    stretch = 1 / scale if scale < 1 else 1.0
    rows = range(m) if rows is None else rows
    out = np.zeros((len(rows), n if size is None else size))
    for k, i in enumerate(rows):
        centre = i / scale
        j = np.arange(math.ceil(centre - support * stretch), math.floor(centre + support * stretch) + 1)
        w = f((centre - j) / stretch) / stretch
        at = np.where(j < 0, -j, np.where(j >= n, 2 * n - j - 1, j))
        np.add.at(out[k], np.clip(at, 0, n - 1) - first, w)
    return out


def _planes_reached(n: int, m: int, method: int, rows: range) -> tuple[int, int]:
    """The first site and the one after the last that a run of rows of a resize matrix needs."""
    scale = m / n
    width = FILTERS[method][0] / min(1.0, scale)
    return max(0, math.floor(rows[0] / scale - width) - 1), min(n, math.ceil(rows[-1] / scale + width) + 2)


@operator("resize")
def resize(lat, zx, zy, zz, method=1):
    """Resample by factors: 0 box, 1 triangle, 2 B-spline, 3 Lanczos, 4 Mitchell; runs of planes get the planes that they reach."""
    nx, ny, nz, nt = lat.shape
    method = int(method)
    to = [math.ceil(n * float(z)) for n, z in zip((nx, ny, nz), (zx, zy, zz), strict=True)]
    mats = [resize_matrix(n, m, method) if n != m else None for n, m in zip((nx, ny), to, strict=False)]
    mx, my, mz = to
    depth = max(1, min(mz, blocks.SLAB_VOXELS // (max(nx, mx) * max(ny, my)), max(1, blocks.SLAB_VOXELS * mz // (nz * nx * ny))))
    runs = [range(k, min(mz, k + depth)) for k in range(0, mz, depth)]
    reached = [_planes_reached(nz, mz, method, r) if nz != mz else (r[0], r[-1] + 1) for r in runs]
    z = F.col("z")
    if nz == mz:
        lo = hi = F.floor(z / depth)
    else:  # from the same bounds, a run wider where rounding might matter
        width, scale = FILTERS[method][0] / min(1.0, mz / nz) + 3, mz / nz
        lo, hi = F.floor((z - width) * scale / depth), F.floor((z + width) * scale / depth)
    lo, hi = F.greatest(F.lit(0), lo), F.least(F.lit(len(runs) - 1), hi)
    dealt = lat.df.withColumn("v", F.col("v").cast("double")).withColumn("b", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))

    def run(key, p):
        k = int(key[1])
        z0, z1 = reached[k]
        p = p[(p.z >= z0) & (p.z < z1)]
        a = _dense(p, nx, ny, z0, z1 - z0)
        for axis, m in ((2, mats[0]), (1, mats[1]), (0, resize_matrix(nz, mz, method, runs[k], z0, z1 - z0) if nz != mz else None)):
            if m is not None:
                a = np.moveaxis(np.tensordot(m, a, axes=(1, axis)), 0, axis)
        return _rows(int(key[0]), runs[k][0], a)

    aff = np.array(lat.affine)
    aff[:, :3] = aff[:, :3] / [float(zx), float(zy), float(zz)]
    pix = (*(d / float(z) for d, z in zip(lat.pix[:3], (zx, zy, zz), strict=True)), lat.pix[3])
    return lat.with_df(dealt.groupBy("t", "b").applyInPandas(run, ROW), shape=(*to, nt), pix=pix, affine=tuple(map(tuple, aff.tolist())))


#: Offsets that are tried before lines go through ``_lower``.
TRIED = 64


def envelope(a: np.ndarray, step: float) -> np.ndarray:
    """Along the first axis the lower envelope of the parabolas that stand on ``a``, which isn't negative.

    All lines at once by growing offsets, which end once no offset can win; lines with sites far from all that is finite are done one by one.
    """
    best = a.copy()
    for k in range(1, len(a)):
        cost = (k * step) ** 2
        if not (best > cost).any():
            break
        if k > TRIED:
            flat, out = a.reshape(len(a), -1), best.reshape(len(a), -1)
            for c in np.flatnonzero((out > cost).any(axis=0)):
                out[:, c] = _lower(flat[:, c], step)
            return out.reshape(a.shape)
        np.minimum(best[k:], a[:-k] + cost, out=best[k:])
        np.minimum(best[:-k], a[k:] + cost, out=best[:-k])
    return best


def _lower(f: np.ndarray, step: float) -> np.ndarray:
    """The envelope of one line: the best site moves on with the position, so it is found between those of positions already done."""
    j = np.flatnonzero(np.isfinite(f))
    if not len(j):
        return f
    n = len(f)
    own, arg, best = f[j], np.zeros(n, np.int64), np.empty(n)
    s = 1 << n.bit_length()
    while s := s >> 1:
        i = np.arange(s - 1, n, 2 * s)
        if not len(i):
            continue
        lo = np.where(i >= s, arg[i - s], 0)
        hi = np.where(i + s < n, arg[np.minimum(i + s, n - 1)], len(j) - 1)
        size = hi - lo + 1
        start = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(lo - start, size)
        cost = own[at] + ((np.repeat(i, size) - j[at]) * step) ** 2
        best[i] = np.minimum.reduceat(cost, start)
        hit = np.flatnonzero(cost == np.repeat(best[i], size))[::-1]
        arg[np.repeat(i, size)[hit]] = at[hit]  # the first of equals is written last
    return best


def plane_distance(inside: np.ndarray, pix) -> np.ndarray:
    """Squared distances to the nearest false site of the same plane; infinite without one."""
    d = np.where(inside, np.inf, 0.0)
    for axis, step in ((2, pix[0]), (1, pix[1])):
        d = np.moveaxis(envelope(np.ascontiguousarray(np.moveaxis(d, axis, 0)), step), 0, axis)
    return d


def distance(inside: np.ndarray, pix) -> np.ndarray:
    """Distance of each true site to the nearest false one; infinite without one.

    Squared distances are combined one axis at a time; each step takes the lower envelope of parabolas over the line.
    """
    return np.sqrt(envelope(plane_distance(inside, pix), pix[2]))


#: What a distance is without any site outside.
FAR = 1.8446742e19


def distances(df, lat: Lattice, names: list[str], masks: list, g, out: list[str]):
    """Columns ``out`` from ``g(*arrays of names, *distances)``, a distance for each of ``masks``, which are functions of the arrays.

    Planes first, then whole lines along z: no task holds a volume.
    """
    pix = lat.pix
    sq = [f"d{k}" for k in range(len(masks))]
    flat = by_planes(df, lat.shape, names, lambda *a: [*a, *(plane_distance(m(*a), pix) for m in masks)], [*names, *sq])

    def ends(*a):
        d = [np.sqrt(envelope(x, pix[2])) for x in a[len(names) :]]
        return g(*a[: len(names)], *(np.where(np.isinf(x), FAR, x) for x in d))

    return by_columns(flat, lat.shape, [*names, *sq], ends, out)


def _by_distance(lat, masks, g):
    df = lat.df.withColumn("v", F.col("v").cast("double"))
    return lat.with_df(distances(df, lat, ["v"], masks, lambda *a: [g(*a)], ["v"]))


@operator("edt")
def edt(lat):
    """Distance in mm of positive voxels to the nearest other one."""
    return _by_distance(lat, [lambda a: a > 0], lambda a, d: d)


@operator("sedt")
def sedt(lat):
    """Signed distance: negative outside."""
    return _by_distance(lat, [lambda a: a > 0, lambda a: ~(a > 0)], lambda a, d, e: d - e)


@operator("dilate")
def dilate(lat, iso, mm):
    """Keep values within ``mm`` of a voxel of at least ``iso``."""
    iso, mm = float(iso), float(mm)
    return _by_distance(lat, [lambda a: ~(a >= iso)], lambda a, d: np.where(d <= mm, a, 0.0))


@operator("erode")
def erode(lat, iso, mm):
    """Keep values at least ``mm`` inside the voxels of at least ``iso``."""
    iso, mm = float(iso), float(mm)
    return _by_distance(lat, [lambda a: a >= iso], lambda a, d: np.where(d >= mm, a, 0.0))


@operator("close")
def close(lat, iso, d1, d2):
    """Dilate by ``d1`` and erode by ``d2`` the voxels of at least ``iso``; what they cover becomes at least ``iso``."""
    iso, d1, d2 = float(iso), float(d1), float(d2)
    cover = lambda a, b: np.where(b > 0, np.maximum(iso, a), a)
    if not d2 > 0:
        return _by_distance(lat, [lambda a: ~(a >= iso)], lambda a, d: cover(a, ~(d >= d1)))
    df = lat.df.withColumn("v", F.col("v").cast("double"))
    wide = distances(df, lat, ["v"], [lambda a: ~(a >= iso)], lambda a, d: [a, 1.0 * ~(d >= d1)], ["v", "w"])
    return lat.with_df(distances(wide, lat, ["v", "w"], [lambda a, w: w > 0], lambda a, w, e: [cover(a, np.where(e < d2, 0.0, e))], ["v"]))
