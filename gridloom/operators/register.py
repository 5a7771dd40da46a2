"""Affine registration, and what builds on it.

The cost of a candidate transform is a weighted agreement measure over sampled control points. Both images
are blurred and brought to the driver at a bounded size for the search, which is sequential by nature; the
final resampling of the full image is distributed. The optimiser is a bounded pattern search with shrinking
steps, started from a grid of shifts and rotations.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.lattice import Lattice
from gridloom.operators import operator
from gridloom.operators.geometry import _square, gathered

#: Voxels per axis that the search works on.
SEARCH_SIZE = 48


def parameters_matrix(p: np.ndarray) -> np.ndarray:
    """Shift, rotation in degrees, scale and shear (12 numbers) to a matrix: shear, then scale, then rotation, then shift."""
    rx, ry, rz = np.radians(p[3:6])
    cx, sx, cy, sy, cz, sz = math.cos(rx), math.sin(rx), math.cos(ry), math.sin(ry), math.cos(rz), math.sin(rz)
    r = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    shear = np.array([[1, 0, 0], [p[9], 1, 0], [p[10], p[11], 1]])
    m = np.eye(4)
    m[:3, :3] = r @ np.diag(p[6:9]) @ shear
    m[:3, 3] = p[:3]
    return m


#: Free parameters by kind of warp.
FREE = {"sho": 3, "shr": 6, "srs": 9, "aff": 12}
LOW = np.array([-0.321, -0.321, -0.321, -30, -30, -30, 0.711, 0.711, 0.711, -0.1111, -0.1111, -0.1111])
HIGH = np.array([0.321, 0.321, 0.321, 30, 30, 30, 1 / 0.711, 1 / 0.711, 1 / 0.711, 0.1111, 0.1111, 0.1111])


def sample(a: np.ndarray, ijk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trilinear values of ``a[z, y, x]`` at voxel coordinates, and which lie inside."""
    n = np.array(a.shape[::-1])[:, None]
    ok = ((ijk >= -0.499) & (ijk <= n - 0.501)).all(axis=0)
    c = np.clip(ijk, 0, n - 1.0)
    lo = np.minimum(np.floor(c).astype(int), np.maximum(n - 2, 0))
    f, out = c - lo, np.zeros(ijk.shape[1])
    for d in itertools.product((0, 1), repeat=3):
        w = np.prod([f[k] if d[k] else 1 - f[k] for k in range(3)], axis=0)
        at = np.minimum(lo + np.array(d)[:, None], n - 1)
        out += w * a[at[2], at[1], at[0]]
    return out, ok


def agreement(kind: str, u: np.ndarray, v: np.ndarray, blocks: np.ndarray) -> float:
    """A cost, less for better: least squares, Hellinger, or local correlation (signed or absolute)."""
    if len(u) < 50:
        return 2.0
    if kind in ("lpc", "lpa"):
        total = weight = 0.0
        for b in np.unique(blocks):
            x, y = u[blocks == b], v[blocks == b]
            if len(x) > 8 and x.std() > 0 and y.std() > 0:
                r = float(np.clip(np.corrcoef(x, y)[0, 1], -0.999, 0.999))
                z = math.atanh(r)
                total += z * abs(z) * len(x)
                weight += len(x)
        total /= max(weight, 1)
        return total if kind == "lpc" else 1 - abs(total)
    if kind == "hel":
        n = int(np.clip(round(len(u) ** (1 / 3)), 3, 255))
        h, _, _ = np.histogram2d(u, v, bins=n)
        h /= h.sum()
        return float(np.sqrt(h * np.outer(h.sum(axis=1), h.sum(axis=0))).sum())
    return 1 - abs(float(np.corrcoef(u, v)[0, 1])) if u.std() > 0 and v.std() > 0 else 1.0


def _small(lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """A block-averaged copy of bounded size, and its affine."""
    step = [max(1, math.ceil(n / SEARCH_SIZE)) for n in lat.shape[:3]]
    cell = [F.floor(F.col(c) / s).cast("int").alias(c) for c, s in zip("xyz", step, strict=True)]
    p = lat.df.where("t = 0").groupBy(*cell).agg(F.avg("v").alias("v")).toPandas()  # at most SEARCH_SIZE ** 3 rows
    a = np.zeros([math.ceil(n / s) for n, s in zip(lat.shape[:3], step, strict=True)][::-1])
    a[p.z, p.y, p.x] = p.v
    m = _square(lat.affine) @ np.array([[step[0], 0, 0, (step[0] - 1) / 2], [0, step[1], 0, (step[1] - 1) / 2], [0, 0, step[2], (step[2] - 1) / 2], [0, 0, 0, 1]])
    return a, m


def align(moving: Lattice, base: Lattice, cost: str = "hel", warp: str = "aff", cmass: bool = True) -> np.ndarray:
    """The 4 by 4 matrix from base world coordinates to moving world coordinates."""
    src, m_src = _small(moving)
    ref, m_ref = _small(base)
    pos = ref[ref > 0]
    mask = ref > (0.1 * np.percentile(pos, 98) if len(pos) else -np.inf)
    zyx = np.stack(np.nonzero(mask))
    stride = max(1, zyx.shape[1] // 12_000)
    zyx = zyx[:, ::stride]
    u = ref[tuple(zyx)]
    world = m_ref @ np.vstack([zyx[::-1], np.ones(zyx.shape[1])])
    centre = world[:3].mean(axis=1)
    blocks = (zyx // 6 * np.array([[10_000], [100], [1]])).sum(axis=0)
    back = np.linalg.inv(m_src)
    fov = np.array([abs(np.linalg.norm(m_ref[:3, k]) * ref.shape[2 - k]) for k in range(3)])
    shift = np.zeros(3)
    if cmass and np.abs(src).sum() > 0 and np.abs(ref).sum() > 0:
        mid = lambda a, m: (m @ np.r_[[(np.abs(a).sum(axis=tuple(j for j in range(3) if j != 2 - k)) * np.arange(a.shape[2 - k])).sum() / np.abs(a).sum() for k in range(3)], 1])[:3]
        shift = mid(src, m_src) - mid(ref, m_ref)
    low, high = LOW.copy(), HIGH.copy()
    low[:3], high[:3] = LOW[:3] * fov + shift, HIGH[:3] * fov + shift
    free = FREE[warp]

    def matrix(p):
        to, fro = np.eye(4), np.eye(4)
        to[:3, 3], fro[:3, 3] = centre, -centre
        return to @ parameters_matrix(p) @ fro

    def value(p):
        v, ok = sample(src, (back @ matrix(p) @ world)[:3])
        if ok.sum() < 0.3 * len(ok):
            return 2.0
        return agreement(cost, u[ok], v[ok], blocks[ok])

    start = np.r_[shift, 0, 0, 0, 1, 1, 1, 0, 0, 0]
    starts = [start]
    for d in itertools.product((-0.1, 0, 0.1), repeat=3):
        starts.append(start + np.r_[np.array(d) * fov, np.zeros(9)])
    if free > 3:
        starts += [start + np.r_[0, 0, 0, np.array(d) * 15, np.zeros(6)] for d in itertools.product((-1, 0, 1), repeat=3)]
    ranked = sorted(((value(np.clip(p, low, high)), i) for i, p in enumerate(starts)))[:3]
    best, at = 9.0, start
    for c, i in ranked:
        p, steps = np.clip(starts[i], low, high), (high - low) / 12
        for _ in range(60):
            moved = False
            for k in range(free):
                for s in (steps[k], -steps[k]):
                    q = p.copy()
                    q[k] = np.clip(q[k] + s, low[k], high[k])
                    cq = value(q)
                    if cq < c - 1e-9:
                        p, c, moved = q, cq, True
                        break
            if not moved:
                steps = steps / 2
                if (steps < (high - low) * 2e-4).all():
                    break
        if c < best:
            best, at = c, p
    return matrix(at)


def moved(moving: Lattice, base: Lattice, m: np.ndarray, final: str = "linear") -> Lattice:
    """The moving image on the base grid, through a matrix of ``align``."""
    affine = (m @ _square(base.affine))[:3]
    out = gathered(moving, base.shape, affine, base.pix, final != "nearest", "zero")
    return out.with_df(out.df, affine=base.affine)


@operator("allineate")
def allineate(lat, base, cost="hel", warp="aff", final="linear"):
    """Register to a base image with up to 12 degrees of freedom and resample onto its grid."""
    return moved(lat, base, align(lat, base, cost, warp), final)


@operator("deface")
def deface(lat, template, mask, cost="hel"):
    """Bring a template's mask onto the image; where it is below a half the image becomes its minimum."""
    if lat.shape[3] != 1:
        raise ValueError("only for a single volume")
    m = align(template, lat, cost)
    on = moved(mask.with_df(mask.df, affine=template.affine), lat, m)
    row = lat.df.agg(F.min("v").alias("low"))
    return lat.join(on, lambda v, w: F.when(w >= 0.5, v)).with_row(row, lambda v: F.coalesce(v, F.col("low")))


def _gone(message):
    def run(lat, *args):
        raise NotImplementedError(message)

    return run


for _name in ("spm_coreg", "spmcoreg", "spm_deface"):
    operator(_name)(_gone("this module is not part of the engine"))
operator("skullstrip")(_gone("use deface or allineate with a mask instead"))
