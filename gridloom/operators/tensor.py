"""Diffusion tensors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.lattice import K, Lattice
from gridloom.operators import operator

#: Output volumes of a decomposition, in order.
PARTS = ("L1", "L2", "L3", "V1x", "V1y", "V1z", "V2x", "V2y", "V2z", "V3x", "V3y", "V3z", "MD", "MO", "FA")


def _swap(lat: Lattice, kind: str) -> Lattice:
    if lat.shape[3] != 6:
        raise ValueError("a tensor image has six volumes")
    t = F.when(F.col("t") == 2, 3).when(F.col("t") == 3, 2).otherwise(F.col("t"))
    return lat.with_df(lat.df.withColumn("t", t)).with_fields(intent=kind)


@operator("tensor_2lower")
def to_lower(lat):
    """From upper to lower triangular order of the six volumes."""
    return _swap(lat, "symmatrix")


@operator("tensor_2upper")
def to_upper(lat):
    """From lower to upper triangular order."""
    return _swap(lat, "vector")


def decompose(six: np.ndarray) -> np.ndarray:
    """Eigenvalues in falling order, eigenvectors, mean diffusivity, mode and anisotropy of upper-order tensors."""
    m = np.zeros((len(six), 3, 3))
    for k, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
        m[:, i, j] = m[:, j, i] = six[:, k]
    ok = np.isfinite(six).all(axis=1)
    w, v = np.linalg.eigh(np.where(ok[:, None, None], m, 0.0))
    w, v = w[:, ::-1], np.moveaxis(v[:, :, ::-1], 1, 2)
    w = np.where(np.abs(w) < 1e-4, 0.0, w)
    md = w.mean(axis=1)
    d = w - md[:, None]
    ss = (w * w).sum(axis=1)
    pair = (w[:, 0] - w[:, 1]) ** 2 + (w[:, 1] - w[:, 2]) ** 2 + (w[:, 2] - w[:, 0]) ** 2
    fa = np.where(ss > 0, np.sqrt(pair / np.where(ss > 0, 2 * ss, 1)), 0.0)
    norm = np.sqrt((d * d).sum(axis=1))
    mo = np.where(norm > 0, 3 * np.sqrt(6) * d.prod(axis=1) / np.where(norm > 0, norm, 1) ** 3, 0.0)
    bad = (w[:, 0] <= 0) | (w[:, 1] < 0) | (w[:, 2] < 0)
    md, fa = np.where(bad, 0.0, md), np.where(bad, 0.0, fa)
    return np.concatenate([w, v.reshape(-1, 9), md[:, None], np.clip(mo, -1, 1)[:, None], fa[:, None]], axis=1)


def _columns(lat: Lattice, n: int):
    """One row per voxel with its first ``n`` volumes as an array."""
    return lat.df.groupBy(*K).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("s")).where(F.size("s") == n)


def parts(lat: Lattice, lower: bool = False) -> Lattice:
    """A lattice whose volumes are ``PARTS``; eigenvectors are defined up to their sign."""
    if lat.shape[3] != 6:
        raise ValueError("a tensor image has six volumes")

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        six = np.stack([np.asarray(a, float) for a in s])
        return pd.Series(list(decompose(six[:, [0, 1, 3, 2, 4, 5]] if lower else six)))

    df = _columns(lat, 6).select(*K, F.posexplode(run("s")).alias("t", "v"))
    return lat.with_df(df, shape=(*lat.shape[:3], len(PARTS)))


def part(all_: Lattice, name: str) -> Lattice:
    """One of the volumes of ``parts``."""
    return all_.with_df(all_.df.where(F.col("t") == PARTS.index(name)).withColumn("t", F.lit(0)), shape=(*all_.shape[:3], 1))


@operator("tensor_decomp")
def tensor_decomp(lat):
    """The fractional anisotropy; ``parts`` has all outputs."""
    return part(parts(lat), "FA")


@operator("tensor_decomp_lower")
def tensor_decomp_lower(lat):
    return part(parts(lat, True), "FA")


def dtifit(lat: Lattice, bvals, bvecs, mask: Lattice | None = None, flip_x: bool | None = None) -> tuple[Lattice, Lattice]:
    """Fit tensors by log-linear least squares: the six volumes (upper order) and the signal without gradient.

    The x gradient is reversed for a positive determinant. The 7 by n pseudo-inverse goes to the tasks with
    the code; each batch is one matrix product.
    """
    b, g = np.asarray(bvals, float), np.asarray(bvecs, float).copy()
    g = g.T if g.shape[0] != 3 else g
    if (not lat.negative) if flip_x is None else flip_x:
        g[0] = -g[0]
    x, y, z = g
    design = np.stack([-b * x * x, -2 * b * x * y, -2 * b * x * z, -b * y * y, -2 * b * y * z, -b * z * z, np.ones_like(b)], axis=1)
    inverse = np.linalg.pinv(design)
    if not np.allclose(inverse @ design, np.eye(7), atol=1e-6):
        raise ValueError("the gradients don't determine a tensor")

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        logs = np.log(np.maximum(np.stack([np.asarray(a, float) for a in s]), 1.0))
        return pd.Series(list(logs @ inverse.T))

    fit = _columns(lat, lat.shape[3]).select(*K, run("s").alias("p"))
    if mask is not None:
        inside = mask.df.where("t = 0").select(*K, (F.col("v") > 0).alias("m"))
        fit = fit.join(inside, list(K)).select(*K, F.when(F.col("m"), F.col("p")).otherwise(F.array(*[F.lit(0.0)] * 7)).alias("p"), "m")
    else:
        fit = fit.withColumn("m", F.lit(True))
    tensor = fit.select(*K, F.posexplode(F.slice("p", 1, 6)).alias("t", "v"))
    s0 = fit.select(*K, F.lit(0).alias("t"), F.when(F.col("m"), F.exp(F.col("p")[6])).otherwise(0.0).alias("v"))
    return lat.with_df(tensor, shape=(*lat.shape[:3], 6)), lat.with_df(s0, shape=(*lat.shape[:3], 1))
