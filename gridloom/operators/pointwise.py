"""Unary, scalar and image-to-image operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.lattice import Lattice
from gridloom.operators import REGISTRY, operator


def _unary(name):
    return lambda lat: lat.map(N.UNARY[name])


for _name in N.UNARY:
    REGISTRY[_name] = _unary(_name)
for _name in N.NORMAL:
    REGISTRY[_name] = (lambda n: lambda lat: lat.map(lambda v: N.normal(n, v)))(_name)


def _operand(name):
    """A number or an image; identities are folded here, as Catalyst doesn't fold them for doubles."""

    def run(lat: Lattice, arg):
        if isinstance(arg, Lattice):
            if name not in N.BINARY:
                raise ValueError(f"{name} takes a number")
            swapped = lat.shape[3] < arg.shape[3]
            if name == "mas" and swapped:
                return lat.join(arg, lambda a, b: F.when(N.gt(b, 0), a).otherwise(0.0))
            return lat.join(arg, N.BINARY[name])
        if name not in N.SCALAR:
            raise ValueError(f"{name} takes an image")
        c = float(arg)
        return lat if (name, c) in N.IDENTITY else lat.map(lambda v: N.SCALAR[name](v, c))

    return run


for _name in {*N.SCALAR, *N.BINARY}:
    REGISTRY[_name] = _operand(_name)


@operator("h2c")
def h2c(lat):
    return lat.map(N.h2c)


@operator("c2h")
def c2h(lat):
    return lat.map(N.c2h)


@operator("rand")
def rand(lat, seed=0):
    """Add uniform noise from 0 to 1."""
    return lat.map(lambda v: v + F.rand(int(lat.fields().get("seed", seed))))


@operator("randn")
def randn(lat, seed=0):
    """Add standard normal noise."""
    return lat.map(lambda v: v + F.randn(int(lat.fields().get("seed", seed))))


@operator("seed")
def seed(lat, n):
    """Set the seed of later noise; a fraction is scaled to 31 bits."""
    n = float(n)
    return lat.with_fields(seed=int(n * (2**31 - 1)) if 0 < n < 1 else int(n))


@operator("grid")
def grid(lat, value, spacing):
    """Set planes at every ``spacing``-th index of each axis to a value; z only if there are several slices."""
    s = int(spacing)
    on = (F.col("x") % s == 0) | (F.col("y") % s == 0)
    if lat.shape[2] > 1:
        on = on | (F.col("z") % s == 0)
    return lat.map(lambda v: F.when(on, float(value)).otherwise(v))


@operator("roi")
def roi(lat, x0, xs, y0, ys, z0, zs, t0=0, ts=-1):
    """Zero outside a box; a negative size takes the whole axis."""
    inside = F.lit(True)
    for c, a, n in (("x", x0, xs), ("y", y0, ys), ("z", z0, zs), ("t", t0, ts)):
        if int(n) >= 0:
            inside = inside & F.col(c).between(int(a), int(a) + int(n) - 1)
    return lat.map(lambda v: F.when(inside, v).otherwise(0.0))


@operator("index")
def index(lat):
    """Number the non-zero voxels from 0 in raster order; x runs backwards unless the determinant is negative.

    Ranks are counted inside planes and shifted by the planes before: no global sort.
    """
    x = F.col("x") if lat.negative else F.lit(lat.shape[0] - 1) - F.col("x")
    some = N.flag(F.col("v") != 0)
    counts = lat.df.groupBy("t", "z").agg(F.sum(some).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("t", "z")) - F.col("n")).drop("n")
    rank = F.sum(some).over(Window.partitionBy("t", "z").orderBy("y", x).rowsBetween(Window.unboundedPreceding, 0))
    planes = lat.shape[2] * lat.shape[3]
    ranked = lat.df.withColumn("r", rank).join(F.broadcast(before) if planes <= 1_000_000 else before, ["t", "z"])
    return lat.with_df(ranked.withColumn("v", F.when(F.col("v") != 0, F.col("before") + F.col("r") - 1).otherwise(0.0)))


@operator("qform")
def qform(lat, code):
    return lat.with_fields(qform_code=int(code))


@operator("sform")
def sform(lat, code):
    return lat.with_fields(sform_code=int(code))


@operator("range")
def range_(lat):
    """Put the value range into the header; the values stay."""
    r = lat.df.where(~F.isnan("v")).agg(F.min("v"), F.max("v")).first()
    return lat.with_fields(cal_min=r[0], cal_max=r[1])


@operator("p")
def threads(lat, n):
    """Thread count: Spark's own setting holds."""
    return lat


ODT = {"char": (0, 255, True), "short": (-32768, 32767, True), "ushort": (0, 65535, True), "int": (-2147483648, 2147483647, True), "float": (None, None, False), "flt": (None, None, False), "double": (None, None, False)}


@operator("odt")
def odt(lat, kind):
    """Cast to an output type: rounded half away from zero and saturating for integers; NaN becomes 0."""
    lo, hi, whole = ODT[kind]
    if not whole:
        return lat.map(lambda v: v.cast("float" if kind != "double" else "double").cast("double"))
    return lat.map(lambda v: F.when(F.isnan(v), 0.0).otherwise(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), N.UNARY["round"](v)))))
