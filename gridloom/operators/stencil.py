"""Kernels and neighbourhood operators.

Kernels of up to ``SCATTER`` sites run as Spark aggregates: every voxel is sent to the sites that see it.
Larger ones would multiply the rows, so they run on numpy slabs, which move each voxel about once.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.lattice import Lattice
from gridloom.operators import operator
from gridloom.plans import blocks
from gridloom.plans.blocks import by_slab, kept

SCATTER = 27


def _box(nx: int, ny: int, nz: int) -> list[tuple]:
    span = lambda n: range(-(n // 2), -(n // 2) + n)
    return [(x, y, z, 1.0) for z in span(nz) for y in span(ny) for x in span(nx)]


def offsets(lat: Lattice) -> list[tuple]:
    """The kernel as sites ``(dx, dy, dz, weight)``."""
    kind, arg = lat.sites
    if kind == "box":
        return _box(*arg)
    if kind == "sites":
        return list(arg)
    d = lat.pix[:3]
    if kind == "mm":
        return _box(*(2 * math.floor(arg / s) + 1 for s in d))
    if kind == "sphere":
        r = [math.floor(arg / s) for s in d]
        return [o for o in _box(*(2 * n + 1 for n in r)) if math.sqrt(sum((o[i] * d[i]) ** 2 for i in range(3))) <= arg]
    n = [2 * math.floor(6 * arg / s) + 1 for s in d]  # gauss: a cube to six sigmas
    w = [(x, y, z, math.exp(-((x * d[0]) ** 2 + (y * d[1]) ** 2 + (z * d[2]) ** 2) / (2 * arg * arg))) for x, y, z, _ in _box(*n)]
    total = sum(o[3] for o in w)
    return [(x, y, z, k / total) for x, y, z, k in w]


@operator("kernel")
def kernel(lat, kind, *args):
    """Set the kernel of later neighbourhood operators."""
    if kind in ("3D", "2D"):
        return replace(lat, sites=("box", (3, 3, 3 if kind == "3D" else 1)))
    if kind == "boxv":
        return replace(lat, sites=("box", (int(args[0]),) * 3))
    if kind == "boxv3":
        return replace(lat, sites=("box", tuple(int(a) for a in args)))
    if kind in ("box", "sphere", "gauss"):
        return replace(lat, sites=("mm" if kind == "box" else kind, float(args[0])))
    if kind == "file":  # an image's non-zero voxels, around its centre
        image = args[0]
        nx, ny, nz, _ = image.shape
        rows = image.df.where("v <> 0").orderBy("z", "y", "x").collect()  # a kernel, small by nature
        total = sum(abs(r["v"]) for r in rows) or 1.0
        return replace(lat, sites=("sites", tuple((r["x"] - nx // 2, r["y"] - ny // 2, r["z"] - nz // 2, r["v"] / total) for r in rows)))
    raise ValueError(f"unknown kernel {kind!r}")


def scattered(lat: Lattice, sites: list[tuple], only=None):
    """Rows ``t, z, y, x, v, w, c``: for each site the values its kernel sees, the weight, and whether it is itself."""
    nx, ny, nz, _ = lat.shape
    rows = ", ".join(f"struct({-x} as ox, {-y} as oy, {-z} as oz, {w!r}D as w, false as c)" for x, y, z, w in [(int(a), int(b), int(c), float(d)) for a, b, c, d in sites])
    df = lat.df.select("t", "z", "y", "x", "v", F.expr(f"inline(array({rows}, struct(0 as ox, 0 as oy, 0 as oz, 0D as w, true as c)))"))
    df = df.select("t", (F.col("z") + F.col("oz")).alias("z"), (F.col("y") + F.col("oy")).alias("y"), (F.col("x") + F.col("ox")).alias("x"), "v", "w", "c")
    return df.where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1) & F.col("z").between(0, nz - 1) & (only if only is not None else F.lit(True)))


SITE = ("t", "z", "y", "x")


def _aggregates() -> dict:
    v, w, c = F.col("v"), F.col("w"), F.col("c")
    seen = F.when(~c, v)
    self_ = F.max(F.when(c, v))
    some = F.when(~c & (v != 0), v)
    finite = F.array_sort(F.collect_list(F.when(~c & ~F.isnan(v) & (F.abs(v) < math.inf), v)))
    return {
        "fmean": F.sum(F.when(~c, w * v)) / F.sum(F.when(~c, w)),
        "fmeanu": F.sum(F.when(~c, w * v)),
        "dilF": F.max(seen),
        "eroF": F.min(seen),
        "dilM": F.when(self_ != 0, self_).otherwise(F.coalesce(F.avg(some), F.lit(0.0))),
        "ero": F.when(F.max(N.flag(~c & (v == 0))) == 1, 0.0).otherwise(self_),
        "fmedian": F.element_at(finite, F.floor(F.size(finite) * 0.5).cast("int") + 1),
    }


def _shifts(a: np.ndarray, sites):
    """For each site the array as the kernel sees it there, with a mask of what lies inside the lattice."""
    nz, ny, nx = a.shape
    for dx, dy, dz, w in sites:
        out, ok = np.zeros_like(a), np.zeros(a.shape, bool)
        to = tuple(slice(max(0, -d), min(n, n - d)) for d, n in ((dz, nz), (dy, ny), (dx, nx)))
        frm = tuple(slice(max(0, d), min(n, n + d)) for d, n in ((dz, nz), (dy, ny), (dx, nx)))
        if all(s.start < s.stop for s in to):
            out[to], ok[to] = a[frm], True
        yield out, ok, w


def dense(name: str, a: np.ndarray, sites) -> np.ndarray:
    """The same aggregates in numpy."""
    if name in ("fmean", "fmeanu"):
        s, n = np.zeros_like(a), np.zeros_like(a)
        for b, ok, w in _shifts(a, sites):
            s += np.where(ok, w * b, 0)
            n += w * ok
        return s / n if name == "fmean" else s
    if name in ("dilF", "eroF"):
        best = np.full_like(a, -np.inf if name == "dilF" else np.inf)
        for b, ok, _ in _shifts(a, sites):
            best = np.where(ok, (np.maximum if name == "dilF" else np.minimum)(best, b), best)
        return best
    if name == "dilM":
        s, n = np.zeros_like(a), np.zeros_like(a)
        for b, ok, _ in _shifts(a, sites):
            use = ok & (b != 0)
            s += np.where(use, b, 0)
            n += use
        return np.where(a != 0, a, np.where(n > 0, s / np.maximum(n, 1), 0))
    if name == "ero":
        gone = np.zeros(a.shape, bool)
        for b, ok, _ in _shifts(a, sites):
            gone |= ok & (b == 0)
        return np.where(gone, 0.0, a)
    stack = np.stack([np.where(ok & np.isfinite(b), b, np.nan) for b, ok, _ in _shifts(a, sites)])
    stack.sort(axis=0)  # NaN last
    n = (~np.isnan(stack)).sum(axis=0)
    if name == "fmedian":
        return np.take_along_axis(stack, np.minimum((n * 0.5).astype(int), np.maximum(n - 1, 0))[None], axis=0)[0]
    best, most = np.zeros_like(a), np.zeros(a.shape, int)  # dilD
    run, last = np.zeros(a.shape, int), np.full(a.shape, np.nan)
    for b in stack:
        run = np.where(b == last, run + 1, 1)
        last = b
        use = ~np.isnan(b) & (b != 0) & (run >= most)
        best, most = np.where(use, b, best), np.where(use, run, most)
    return np.where(a != 0, a, best)


def neighbourhood(name: str, lat: Lattice) -> Lattice:
    sites = offsets(lat)
    if len(sites) > SCATTER:
        return by_slab(lat, max(abs(s[2]) for s in sites), lambda a, _: dense(name, a, sites))
    if name != "dilD":
        return lat.with_df(scattered(lat, sites).groupBy(*SITE).agg(_aggregates()[name].alias("v")))
    rows = scattered(lat, sites)
    counted = rows.groupBy(*SITE, "v", "c").count()
    good = ~F.col("c") & (F.col("v") != 0) & ~F.isnan("v") & (F.abs("v") < math.inf)
    own = F.max(F.when(F.col("c"), F.col("v")))
    best = F.max(F.when(good, F.struct("count", "v")))["v"]
    return lat.with_df(counted.groupBy(*SITE).agg(F.when(own != 0, own).otherwise(F.coalesce(best, F.lit(0.0))).alias("v")))


for _name in ("fmean", "fmeanu", "dilF", "eroF", "dilM", "dilD", "ero", "fmedian"):
    operator(_name)((lambda n: lambda lat: neighbourhood(n, lat))(_name))


@operator("dilall")
def dilall(lat, most=10_000):
    """Repeat ``dilM`` until no zero is left or none goes any more; an image of zeros stays as it is.

    In rounds of as many steps as the halo of a slab allows; steps after a slab's last zero change nothing there.
    """
    sites, (nx, ny, _, _), most = offsets(lat), lat.shape, int(most)
    reach = max(abs(s[2]) for s in sites)
    halo = max(reach, 8, min(64, blocks.SLAB_VOXELS // (4 * nx * ny))) if reach else 0

    def fill(steps):
        def run(a, _):
            for _ in range(steps):
                if not (a == 0).any() or not (a != 0).any():
                    break
                new = dense("dilM", a, sites)
                if not reach and np.array_equal(new, a, equal_nan=True):
                    break
                a = new
            return a

        return run

    done, before = 0, None
    while done < most:
        steps = min(most - done, halo // reach if reach else most)
        lat = by_slab(lat, halo, fill(steps))
        lat = lat.with_df(kept(lat.df))
        done += steps
        zero = F.col("v") == 0
        by = lat.df.groupBy("t").agg(F.sum(N.flag(zero)).alias("zeros"), F.sum(N.flag(~zero)).alias("others")).where("others > 0").agg(F.sum("zeros")).first()[0]
        if not by or by == before or not reach:
            break
        before = by
    return lat


@operator("edge")
def edge(lat):
    """Gradient magnitude by central differences, for interior voxels; others keep their value."""
    nx, ny, nz, _ = lat.shape
    along = {c: Window.partitionBy(*(k for k in SITE if k != c)).orderBy(c) for c in "xyz"}
    s = {c: 1.0 / d**2 for c, d in zip("xyz", lat.pix, strict=False)}
    use = "xyz" if nz > 1 else "xy"
    df = lat.df.withColumns({f"d{c}": F.lead("v").over(along[c]) - F.lag("v").over(along[c]) for c in use})
    g = sum(F.col(f"d{c}") * F.col(f"d{c}") * s[c] for c in use)
    scale = 1.0 / (2.0 * math.sqrt(sum(s.values())))
    inner = F.lit(True)
    for c in use:
        inner = inner & F.col(f"d{c}").isNotNull()
    return lat.with_df(df.withColumn("v", F.when(inner, F.sqrt(g) * scale).otherwise(F.col("v"))))


#: The Sobel weights by distance across the derivative's direction.
CROSS = {-1: 1, 0: 2, 1: 1}


def _sobel_sites() -> dict[str, list[tuple]]:
    return {
        "x": [(s, k, 0, s * w) for s in (-1, 1) for k, w in CROSS.items()],
        "y": [(k, s, 0, s * w) for s in (-1, 1) for k, w in CROSS.items()],
        "z": [(k, 0, s, s * w) for s in (-1, 1) for k, w in CROSS.items()],
    }


def _gradients(lat):
    sites = _sobel_sites()
    all_ = sorted({s[:3] for k in sites.values() for s in k})
    rows = scattered(lat, [(*s, 1.0 + i) for i, s in enumerate(all_)])
    g = {}
    for c, k in sites.items():
        weight = F.lit(0.0)
        for x, y, z, w in k:
            weight = F.when(F.col("w") == 1.0 + all_.index((x, y, z)), float(w)).otherwise(weight)
        g[c] = F.sum(F.when(~F.col("c"), weight * F.col("v")).otherwise(0.0))
    return rows.groupBy(*SITE).agg(*((g[c] * g[c]).alias(f"g{c}") for c in g)).withColumn("v", F.sqrt(F.col("gx") + F.col("gy") + F.col("gz")))


@operator("sobel")
def sobel(lat):
    """Gradient magnitude of three six-point kernels; neighbours outside count as zero."""
    return lat.with_df(_gradients(lat))


@operator("sobel_binary")
def sobel_binary(lat):
    """Thin edges: interior local maxima along the strongest direction, above a tenth of the volume's maximum."""
    nx, ny, nz, _ = lat.shape
    edges = _gradients(lat)
    tops = edges.groupBy("t").agg(F.max("v").alias("top"))  # a row for each volume, from partial maxima
    s = F.col("v") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)
    df = edges.join(tops, "t").withColumn("s", F.when(s < 0.1, 0.0).otherwise(s))
    for c in "xyz":
        w = Window.partitionBy(*(k for k in SITE if k != c)).orderBy(c)
        df = df.withColumn(f"m{c}", F.greatest(F.lag("s").over(w), F.lead("s").over(w)))
    gx, gy, gz, v, mx, my, mz = (F.col(c) for c in ("gx", "gy", "gz", "s", "mx", "my", "mz"))
    dir_ = F.when((gx > gy) & (gx > gz), 1).when(gy > gz, 2).otherwise(3)
    hit = ((dir_ == 1) & (v > mx) & ((my > 0) | (mz > 0))) | ((dir_ == 2) & (v > my) & ((mx > 0) | (mz > 0))) | ((v > mz) & ((mx > 0) | (my > 0)))
    inner = F.col("x").between(1, nx - 2) & F.col("y").between(1, ny - 2) & F.col("z").between(1, nz - 2)
    return lat.with_df(df.withColumn("v", N.flag(inner & (v != 0) & hit)))


@operator("edginess")
def edginess(lat):
    """Mean distance between a voxel's series and its six neighbours', for interior voxels, scaled to at most 1."""
    nx, ny, nz, _ = lat.shape
    df = lat.df
    for c in "xyz":
        w = Window.partitionBy(*(k for k in SITE if k != c)).orderBy(c)
        for name, f in (("l", F.lag), ("r", F.lead)):
            df = df.withColumn(name + c, (F.col("v") - f("v").over(w)))
    sums = df.groupBy("z", "y", "x").agg(*(F.sqrt(F.sum(F.col(d + c) * F.col(d + c))).alias(d + c) for c in "xyz" for d in "lr"))
    mean = sum(F.col(d + c) for c in "xyz" for d in "lr") / 6.0
    inner = F.col("x").between(1, nx - 2) & F.col("y").between(1, ny - 2) & F.col("z").between(1, nz - 2)
    raw = sums.select("z", "y", "x", F.when(inner, mean).otherwise(0.0).alias("v"), F.lit(0).alias("t"))
    out = lat.with_df(raw, shape=(nx, ny, nz, 1))
    return out.with_row(raw.agg(F.max("v").alias("mx")), lambda v: F.when(F.col("mx") > 0, v / F.when(F.col("mx") > 0, F.col("mx"))).otherwise(v))


def _halved(lat):
    nx, ny, nz, nt = lat.shape
    m = np.array(lat.affine)
    m[:, :3] *= 2
    return dict(shape=(math.ceil(nx / 2), math.ceil(ny / 2), math.ceil(nz / 2), nt), pix=(*(2 * d for d in lat.pix[:3]), lat.pix[3]), affine=tuple(map(tuple, m.tolist())))


@operator("subsamp2")
def subsamp2(lat):
    """Every second site, as a weighted mean of its 27 neighbours; the phase along x follows the handedness."""
    if max(lat.shape[:3]) == 1:
        return lat
    boost = 1 if not lat.negative and lat.shape[0] % 2 == 0 else 0
    sites = [(x, y, z, 8.0 / 2 ** (x * x + y * y + z * z)) for x, y, z, _ in _box(3, 3, 3)]
    even = ((F.col("x") - boost) % 2 == 0) & (F.col("y") % 2 == 0) & (F.col("z") % 2 == 0)
    rows = scattered(lat, sites, even).groupBy(*SITE).agg(_aggregates()["fmean"].alias("v"))
    half = lambda c, b=0: ((F.col(c) - b) / 2).cast("int")
    return lat.with_df(rows.withColumns({"x": half("x", boost), "y": half("y"), "z": half("z")}), **_halved(lat))


@operator("subsamp2offc")
def subsamp2offc(lat):
    """Means of 2 by 2 by 2 sites."""
    if max(lat.shape[:3]) == 1:
        return lat
    boost = 1 if not lat.negative and lat.shape[0] % 2 else 0
    half = lambda c, b=0: F.floor((F.col(c) + b) / 2).cast("int").alias(c)
    rows = lat.df.groupBy("t", half("z"), half("y"), half("x", boost)).agg(F.avg("v").alias("v"))
    return lat.with_df(rows, **_halved(lat))
