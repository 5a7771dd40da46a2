"""Geometry: axis permutation, cropping to the head, resampling onto other grids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.lattice import Lattice
from gridloom.operators import operator


def _square(affine) -> np.ndarray:
    return np.vstack([np.array(affine), [0, 0, 0, 1]])


def ras_order(affine) -> tuple[list[int], list[bool]]:
    """For each output axis the input axis that points most along it, and whether it runs backwards."""
    m = np.array(affine)[:, :3]
    m = m / np.maximum(np.linalg.norm(m, axis=0), 1e-12)
    left, axes = {0, 1, 2}, []
    for row in range(3):
        k = max(sorted(left), key=lambda a: abs(m[row, a]))
        left.discard(k)
        axes.append(k)
    return axes, [bool(m[row, k] < 0) for row, k in enumerate(axes)]


@operator("ras")
def ras(lat):
    """Permute and flip the axes so that they point right, forward and up: a projection of the indices."""
    axes, flip = ras_order(lat.affine)
    dims = [lat.shape[k] for k in axes]
    old = [F.col(c) for c in "xyz"]
    new = {c: (F.lit(dims[i] - 1) - old[k] if flip[i] else old[k]) for i, (c, k) in enumerate(zip("xyz", axes, strict=True))}
    to_old = np.zeros((4, 4))
    to_old[3, 3] = 1
    for i, k in enumerate(axes):
        to_old[k, i] = -1 if flip[i] else 1
        to_old[k, 3] = dims[i] - 1 if flip[i] else 0
    affine = _square(lat.affine) @ to_old
    pix = (*(lat.pix[k] for k in axes), lat.pix[3])
    return lat.with_df(lat.df.withColumns(new), shape=(*dims, lat.shape[3]), pix=pix, affine=tuple(map(tuple, affine[:3].tolist())))


@operator("robustfov", "robustv")
def robustfov(lat, mm=170):
    """Keep ``mm`` along the head-foot axis from the top slice whose variance exceeds a hundredth of the largest."""
    m = np.array(lat.affine)[:, :3]
    m = m / np.maximum(np.linalg.norm(m, axis=0), 1e-12)
    si = int(np.argmax(np.abs(m[2])))
    lr = max((a for a in range(3) if a != si), key=lambda a: abs(m[0, a]))
    up = m[2, si] >= 0
    n, names = lat.shape[si], "xyz"
    lo, hi = math.floor(lat.shape[lr] * 0.3 + 0.5), math.floor(lat.shape[lr] * 0.7 + 0.5)
    lo, hi = (lo, hi) if hi > lo else (0, lat.shape[lr])
    rows = lat.df.where((F.col("t") == 0) & F.col(names[lr]).between(lo, hi - 1)).groupBy(names[si]).agg(F.var_pop("v")).collect()  # a row for each slice
    var = np.zeros(n)
    for k, v in rows:
        var[k] = v
    live = np.flatnonzero(var > 0.01 * var.max())
    keep = math.floor(float(mm) / lat.pix[si] + 0.5)
    if not len(live) or keep >= n:
        return lat
    keep, pad = max(1, keep), math.floor(2.0 / lat.pix[si] + 0.5)
    if up:
        end = min(n - 1, int(live[-1]) + pad)
        start = max(0, end - keep + 1)
    else:
        start = max(0, int(live[0]) - pad)
        end = min(n - 1, start + keep - 1)
    c = names[si]
    shape = list(lat.shape)
    shape[si] = end - start + 1
    aff = np.array(lat.affine)
    aff[:, 3] += aff[:, si] * start
    df = lat.df.where(F.col(c).between(start, end)).withColumn(c, F.col(c) - start)
    return lat.with_df(df, shape=tuple(shape), affine=tuple(map(tuple, aff.tolist())))


def grid_of(spark, shape):
    """The sites of a lattice, made on the executors."""
    nx, ny, nz, nt = shape
    i = F.col("id")
    cols = {"x": i % nx, "y": F.floor(i / nx) % ny, "z": F.floor(i / (nx * ny)) % nz, "t": F.floor(i / (nx * ny * nz))}
    return spark.range(nx * ny * nz * nt).select(*(v.cast("int").alias(k) for k, v in cols.items()))


def gathered(lat: Lattice, shape, affine, pix, linear: bool = True, outside: str = "min") -> Lattice:
    """Values at another grid's sites: each output site is joined with the 1 or 8 input voxels around it.

    Corners are an explode of fixed size and the join is on the voxel key, so any two grids of any size work
    without a task holding either. Sites outside get the input's minimum or 0.
    """
    spark = lat.df.sparkSession
    m = np.linalg.inv(_square(lat.affine)) @ _square(affine)
    site = grid_of(spark, (*shape[:3], 1)).drop("t")
    at = [sum(F.col(c) * float(m[r, k]) for k, c in enumerate("xyz")) + float(m[r, 3]) for r in range(3)]
    site = site.withColumns({f"f{c}": F.round(a, 9) for c, a in zip("xyz", at, strict=True)})
    for c, n in zip("xyz", lat.shape, strict=False):  # sites that see no voxel need no corners
        site = site.where((F.col(f"f{c}") > -1) & (F.col(f"f{c}") < n))
    if linear:
        corner = "inline(transform(sequence(0, 7), k -> struct(k % 2 as cx, (k div 2) % 2 as cy, k div 4 as cz)))"
        near = site.select("*", F.expr(corner)).withColumns({f"b{c}": F.floor(f"f{c}").cast("int") + F.col(f"c{c}").cast("int") for c in "xyz"})
        w = 1.0
        for c in "xyz":
            w = w * (1.0 - F.abs(F.col(f"f{c}") - F.col(f"b{c}")))
        near = near.withColumn("w", w).where("w > 0")
    else:
        near = site.withColumns({f"b{c}": F.floor(F.col(f"f{c}") + 0.5).cast("int") for c in "xyz"}).withColumn("w", F.lit(1.0))
    src = lat.df.select("t", *(F.col(c).alias(f"b{c}") for c in "xyz"), "v")
    low = lat.df.agg(F.min("v").alias("low")) if outside == "min" else spark.range(1).select(F.lit(0.0).alias("low"))
    inside = F.lit(True)
    for c, n in zip("xyz", lat.shape, strict=False):
        inside = inside & F.col(f"b{c}").between(0, n - 1)
    hit = near.where(inside).join(src, ["bx", "by", "bz"])
    summed = hit.groupBy("t", "z", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.sum("w").alias("w"))
    full = grid_of(spark, (*shape[:3], lat.shape[3]))
    out = full.join(summed, ["t", "z", "y", "x"], "left").crossJoin(F.broadcast(low))
    value = F.when(F.col("w") > 1 - 1e-6, F.col("v")).otherwise(F.col("low"))
    return lat.with_df(out.withColumn("v", value), shape=(*shape[:3], lat.shape[3]), affine=tuple(map(tuple, np.array(affine).tolist())), pix=(*pix[:3], lat.pix[3]))


@operator("reslice")
def reslice(lat, target):
    """Onto another image's grid, trilinear."""
    return gathered(lat, target.shape, target.affine, target.pix, True)


@operator("reslice_nn")
def reslice_nn(lat, target):
    """Onto another image's grid, nearest neighbour."""
    return gathered(lat, target.shape, target.affine, target.pix, False)


@operator("reslice_mask")
def reslice_mask(lat, mask):
    """Bring a mask onto this image's grid; where it isn't positive the image becomes its minimum."""
    row = lat.df.agg(F.min("v").alias("low"))
    m = gathered(mask, lat.shape, lat.affine, lat.pix, False, "zero")
    kept = lat.join(m, lambda v, w: F.when(w > 0, v))
    return kept.with_row(row, lambda v: F.coalesce(v, F.col("low")))


def brightness(lat: Lattice, high: float, bins: int = 1000) -> Lattice:
    """Scale to 0..255 with the brightest share of the non-zero voxels, ``1 - high``, cut off."""
    s = lat.df.agg(F.min("v"), F.max("v"), F.count("*"), F.sum(F.when(F.abs("v") >= 1e-15, 1).otherwise(0)), F.sum(F.when(F.col("v") < 0, 1).otherwise(0))).first()
    low, top, n, some, below = (float(x) for x in s)
    if low < 0 and 100 * below / n < 2:
        low = 0.0
    size = (top - low) / bins
    if size <= 0:
        return lat
    hist = np.zeros(bins)
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / size).cast("int")))
    for r in lat.df.groupBy(b.alias("b")).count().collect():  # at most 1000 rows
        hist[r[0]] = r[1]
    k = int(np.searchsorted(np.cumsum(hist)[1:], n - int((1 - high) * some)))
    top = low + min(k, bins - 1) * size
    scale = 255.0 / (top - low) if top != low else 1.0
    return lat.map(lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v - low) * scale)))


def _onto(lat, dims, steps, high, linear, axes):
    if lat.shape[3] != 1:
        raise ValueError("only for a single volume")
    lat = brightness(lat, high) if high > 0 else lat
    centre = _square(lat.affine) @ [*(n / 2 for n in lat.shape[:3]), 1]
    m = np.zeros((3, 4))
    m[:, :3] = np.array(axes, float) * steps
    m[:, 3] = centre[:3] - m[:, :3] @ (np.array(dims) / 2)
    return gathered(lat, (*dims, 1), m, (*steps, 1.0), linear, "zero")


@operator("conform")
def conform(lat):
    """256 coronal slices of 256 by 256 voxels of 1 mm, brightness 0 to 255, trilinear."""
    return _onto(lat, (256, 256, 256), (1.0, 1.0, 1.0), 0.98, True, [[-1, 0, 0], [0, 0, 1], [0, -1, 0]])


@operator("comply")
def comply(lat, nx, ny, nz, dx, dy, dz, high=0.98, linear=1):
    """As ``conform`` onto a given grid with axes right, forward and up."""
    return _onto(lat, (int(nx), int(ny), int(nz)), (float(dx), float(dy), float(dz)), float(high), bool(int(linear)), np.eye(3))
