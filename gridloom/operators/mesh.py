"""Isosurfaces as vertex and triangle tables, with smoothing and simplification.

Cells are cut into six tetrahedra around a main diagonal, which needs no case table and has no ambiguous
case. A vertex is named by its lattice edge, so equal vertices of neighbouring cells and slabs meet by their
key alone, without a distance tolerance.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lattice import Lattice
from gridloom.plans.blocks import SLAB_VOXELS, _dense

TETRAHEDRA = [np.cumsum([(0, 0, 0), *(tuple(int(k == a) for k in range(3)) for a in p)], axis=0) for p in itertools.permutations(range(3))]


def cells(a: np.ndarray, iso: float, z0: int, nx: int, ny: int) -> tuple[np.ndarray, np.ndarray]:
    """Triangles between planes of ``a[z, y, x]``: keys and voxel coordinates of their corners, outward."""
    nz = a.shape[0] - 1
    if min(nz, a.shape[1] - 1, a.shape[2] - 1) < 1:
        return np.zeros((0, 3), np.int64), np.zeros((0, 3, 3))
    base = np.stack(np.indices((nz, a.shape[1] - 1, a.shape[2] - 1)), -1).reshape(-1, 3)[:, ::-1]
    inside = a >= iso
    lo = np.ones((nz, a.shape[1] - 1, a.shape[2] - 1), bool)
    hi = np.zeros_like(lo)
    for d in itertools.product((0, 1), repeat=3):
        s = inside[d[2] : d[2] + nz, d[1] : d[1] + lo.shape[1], d[0] : d[0] + lo.shape[2]]
        lo &= s
        hi |= s
    base = base[(hi & ~lo).ravel()]
    keys, points = [], []
    for tet in TETRAHEDRA:
        corner = base[:, None] + tet[None]  # cell, 4, xyz
        v = a[corner[..., 2], corner[..., 1], corner[..., 0]]
        code = ((v >= iso) * [1, 2, 4, 8]).sum(axis=1)
        for case in range(1, 15):
            at = np.flatnonzero(code == case)
            if not len(at):
                continue
            ins = [k for k in range(4) if case >> k & 1]
            out = [k for k in range(4) if not case >> k & 1]
            if len(ins) == 2:
                quad = [(ins[0], out[0]), (ins[0], out[1]), (ins[1], out[1]), (ins[1], out[0])]
                tris = [(quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])]
            else:
                one, three = (ins[0], out) if len(ins) == 1 else (out[0], ins)
                tris = [tuple((one, k) for k in three)]
            c, w = corner[at], v[at]
            for tri in tris:
                k3, p3 = [], []
                for i, j in tri:
                    i, j = min(i, j), max(i, j)  # corners of a tetrahedron rise along every axis
                    f = (iso - w[:, i]) / (w[:, j] - w[:, i])
                    p3.append(c[:, i] + f[:, None] * (c[:, j] - c[:, i]) + [0, 0, z0])
                    d = c[:, j] - c[:, i]
                    k3.append((c[:, i, 0] + nx * (c[:, i, 1] + ny * (c[:, i, 2] + z0).astype(np.int64))) * 8 + d @ [1, 2, 4])
                p, k = np.stack(p3, 1), np.stack(k3, 1)
                normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
                away = c[:, out].mean(axis=1) - c[:, ins].mean(axis=1)
                turn = (normal * away).sum(axis=1) < 0
                k[turn], p[turn] = k[turn][:, [0, 2, 1]], p[turn][:, [0, 2, 1]]
                keys.append(k)
                points.append(p)
    if not keys:
        return np.zeros((0, 3), np.int64), np.zeros((0, 3, 3))
    return np.concatenate(keys), np.concatenate(points)


def isosurface(lat: Lattice, iso: float, volume: int = 0) -> tuple[DataFrame, DataFrame]:
    """``vertices (vid, x, y, z)`` in world coordinates and ``triangles (a, b, c)``; triangles without area are dropped."""
    nx, ny, nz, _ = lat.shape
    depth = min(nz, max(8, SLAB_VOXELS // (nx * ny)))
    m = np.array(lat.affine)
    turn = lat.negative
    z = F.col("z")
    b = F.array_distinct(F.array(F.floor(z / depth), F.greatest(F.lit(0), F.floor((z - 1) / depth))))
    dealt = lat.df.where(F.col("t") == volume).withColumn("v", F.col("v").cast("double")).withColumn("b", F.explode(b))

    def run(key, p):
        z0 = int(key[0]) * depth
        n = min(nz, z0 + depth + 1) - z0
        k, q = cells(np.nan_to_num(_dense(p, nx, ny, z0, n)), iso, z0, nx, ny)
        ok = (k[:, 0] != k[:, 1]) & (k[:, 1] != k[:, 2]) & (k[:, 0] != k[:, 2])
        k, q = k[ok], q[ok] @ m[:, :3].T + m[:, 3]
        if turn:
            k, q = k[:, [0, 2, 1]], q[:, [0, 2, 1]]
        out = {"a": k[:, 0], "b": k[:, 1], "c": k[:, 2]}
        return pd.DataFrame(out | {f"{n_}{c}": q[:, i, j] for i, n_ in enumerate("abc") for j, c in enumerate("xyz")})

    schema = "a long, b long, c long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    tri = dealt.groupBy("b").applyInPandas(run, schema)
    corner = F.explode(F.array(*(F.struct(F.col(n).alias("vid"), *(F.col(f"{n}{c}").alias(c) for c in "xyz")) for n in "abc")))
    vertices = tri.select(corner.alias("p")).select("p.*").groupBy("vid").agg(*(F.first(c).alias(c) for c in "xyz"))
    return vertices, tri.select("a", "b", "c")


def arrays(vertices: DataFrame, triangles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A mesh on the driver, with vertices numbered from 0 in order of their keys."""
    v, t = vertices.orderBy("vid").toPandas(), triangles.toPandas()
    ids = v.vid.to_numpy()
    f = np.searchsorted(ids, t[["a", "b", "c"]].to_numpy())
    return v[["x", "y", "z"]].to_numpy(), f[np.lexsort(f.T[::-1])]


def smoothed(v: np.ndarray, f: np.ndarray, rounds: int, alpha: float = 0.1, beta: float = 0.5) -> np.ndarray:
    """Laplacian smoothing with the shrinkage pushed back; border vertices stay."""
    e = np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]])
    pairs, count = np.unique(np.sort(e, axis=1), axis=0, return_counts=True)
    lock = np.zeros(len(v), bool)
    lock[pairs[count == 1].ravel()] = True
    a, b = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
    n = np.maximum(np.bincount(a, minlength=len(v)), 1)[:, None]
    mean = lambda x: np.stack([np.bincount(a, x[b, k], len(v)) for k in range(3)], 1) / n
    o, p = v.copy(), v.copy()
    for _ in range(rounds):
        q = mean(p)
        d = q - (alpha * o + (1 - alpha) * p)
        p = np.where(lock[:, None], o, q - (beta * d + (1 - beta) * mean(d)))
    return p


def simplified(v: np.ndarray, f: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Collapse edges in order of their quadric error until ``ratio`` of the triangles is left; one mesh in one task."""
    v, target = v.copy(), max(4, int(len(f) * ratio))
    normal = np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])
    normal /= np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-20)
    plane = np.c_[normal, -(normal * v[f[:, 0]]).sum(axis=1)]
    q = np.zeros((len(v), 4, 4))
    for k in range(3):
        np.add.at(q, f[:, k], plane[:, :, None] * plane[:, None, :])
    tris = {i: tuple(t) for i, t in enumerate(f.tolist())}
    around: list[set] = [set() for _ in v]
    for i, t in tris.items():
        for k in t:
            around[k].add(i)
    stamp = np.zeros(len(v), int)

    def cost(a, b):
        m = q[a] + q[b]
        best = None
        for p in (v[a], v[b], (v[a] + v[b]) / 2):
            h = np.r_[p, 1]
            c = float(h @ m @ h)
            if best is None or c < best[0]:
                best = (c, p)
        return best

    heap = []
    for a, b in np.unique(np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=1), axis=0).tolist():
        heap.append((cost(a, b)[0], a, b, 0, 0))
    heapq.heapify(heap)
    while len(tris) > target and heap:
        _, a, b, sa, sb = heapq.heappop(heap)
        if stamp[a] != sa or stamp[b] != sb or not around[a] or not around[b]:
            continue
        shared = around[a] & around[b]
        if len(shared) > 2:
            continue
        p = cost(a, b)[1]
        flips = False
        for s in (around[a] ^ around[b]) - shared:
            old = v[list(tris[s])]
            new = np.array([p if k in (a, b) else v[k] for k in tris[s]])
            if np.cross(old[1] - old[0], old[2] - old[0]) @ np.cross(new[1] - new[0], new[2] - new[0]) <= 0:
                flips = True
                break
        if flips:
            continue
        v[a], q[a] = p, q[a] + q[b]
        for s in shared:
            for k in tris.pop(s):
                around[k].discard(s)
        for s in list(around[b]):
            tris[s] = tuple(a if k == b else k for k in tris[s])
            around[a].add(s)
        around[b].clear()
        stamp[a] += 1
        stamp[b] += 1
        for k in {k for s in around[a] for k in tris[s]} - {a}:
            x, y = min(a, k), max(a, k)
            heapq.heappush(heap, (cost(x, y)[0], x, y, stamp[x], stamp[y]))
    f = np.array(list(tris.values()), int).reshape(-1, 3)
    used, inverse = np.unique(f, return_inverse=True)
    return v[used], inverse.reshape(-1, 3)
