"""Pointwise column functions.

NaN compares false with everything, unlike Spark's ordering, in which NaN is the greatest value. All
functions map a column to a column, so that chains of them fuse into one stage of generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def gt(v: Column, c) -> Column:
    """``v > c``; false where either is NaN."""
    c = c if isinstance(c, Column) else F.lit(float(c))
    return ~F.isnan(v) & ~F.isnan(c) & (v > c)


def zero() -> Column:
    return F.lit(0.0)


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def divide(a: Column, b: Column) -> Column:
    """IEEE division, which Spark's ANSI mode raises on."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, math.inf).otherwise(-math.inf))


UNARY = {
    "exp": F.exp,
    "log": lambda v: F.when(v <= 0, 0.0).otherwise(F.log(v)),
    "floor": lambda v: F.when(F.isnan(v), v).otherwise(F.floor(v).cast("double")),
    "ceil": lambda v: F.when(F.isnan(v), v).otherwise(F.ceil(v).cast("double")),
    "trunc": lambda v: F.when(F.isnan(v), v).when(v < 0, F.ceil(v).cast("double")).otherwise(F.floor(v).cast("double")),
    "round": lambda v: F.when(F.isnan(v), v).otherwise(F.signum(v) * F.floor(F.abs(v) + 0.5).cast("double")),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sqr": lambda v: v * v,
    "sqrt": F.sqrt,
    "recip": lambda v: F.when(v == 0, v).otherwise(1 / F.when(v != 0, v)),
    "abs": F.abs,
    "bin": lambda v: flag(gt(v, 0)),
    "binv": lambda v: flag(~gt(v, 0)),
    "nan": lambda v: F.nanvl(v, zero()),
    "nanm": lambda v: flag(F.isnan(v)),
}


def truncated(v: Column) -> Column:
    return UNARY["trunc"](v)


def remainder(v: Column, c: float) -> Column:
    """The whole part of ``fmod(v, c)``."""
    if c == 0:
        raise ValueError("rem needs a divisor other than zero")
    return truncated(v % F.lit(float(c)))


def modulo(v: Column, c: float) -> Column:
    if c == 0:
        raise ValueError("mod needs a divisor other than zero")
    return v % F.lit(float(c))


SCALAR = {
    "add": lambda v, c: v + F.lit(float(c)),
    "sub": lambda v, c: v - F.lit(float(c)),
    "mul": lambda v, c: v * F.lit(float(c)),
    "div": lambda v, c: v * F.lit(1.0 / c if c else math.inf),
    "rem": remainder,
    "mod": modulo,
    "power": lambda v, c: F.pow(v, F.lit(float(c))),
    "max": lambda v, c: F.when(F.isnan(v), float(c)).otherwise(F.greatest(v, F.lit(float(c)))),
    "min": lambda v, c: F.when(F.isnan(v), float(c)).otherwise(F.least(v, F.lit(float(c)))),
    "thr": lambda v, c: F.when(v < float(c), 0.0).otherwise(v),
    "uthr": lambda v, c: F.when(gt(v, c), 0.0).otherwise(v),
}

#: Scalars that leave every value as it is.
IDENTITY = {("add", 0.0), ("sub", 0.0), ("mul", 1.0), ("div", 1.0)}

BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b)),
    "mod": lambda a, b: F.when(b == 0, 0.0).otherwise(a % F.when(b != 0, b)),
    "rem": lambda a, b: F.when(truncated(b) == 0, a).otherwise(truncated(a) % F.when(truncated(b) != 0, truncated(b))),
    "mas": lambda a, b: F.when(F.isnan(b) | (b > 0), a).otherwise(0.0),
    "max": lambda a, b: F.when(gt(a, b), a).otherwise(b),
    "min": lambda a, b: F.when(gt(a, b), b).otherwise(a),
}

#: Hounsfield and Cormack units: floor, start of the boosted range, its width, boost.
CT_MIN, CT_DARK, CT_MID, CT_BOOST = -1000.0, 900.0, 200.0, 10.0


def h2c(v: Column) -> Column:
    up = F.greatest(v, F.lit(CT_MIN)) - CT_MIN
    return up + F.least(F.greatest(up - CT_DARK, zero()), F.lit(CT_MID)) * (CT_BOOST - 1)


def c2h(v: Column) -> Column:
    boost = F.least(F.greatest(v - CT_DARK, zero()), F.lit(CT_MID * CT_BOOST))
    return v + CT_MIN - boost / CT_BOOST * (CT_BOOST - 1)


def upper_tail(z: float) -> float:
    """The standard normal's upper tail."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def tail_inverse(p: float) -> float:
    """``z`` with ``upper_tail(z) == p``: a rational start (Abramowitz and Stegun 26.2.23), then Newton; within 13."""
    if p <= 0 or p >= 1:
        return 13.0 if p <= 0 else -13.0
    q = min(p, 1 - p)
    if q < 1e-300:
        return 13.0 if p < 0.5 else -13.0
    t = math.sqrt(-2 * math.log(q))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    for _ in range(3):
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        if density:
            z += (upper_tail(z) - q) / density
    z = min(13.0, z)
    return z if p < 0.5 else -z


def _ztop(low: float, high: float | None):
    def f(z: float) -> float:
        if z < low:
            return 1.0
        return 0.0 if high is not None and z > high else upper_tail(z)

    return f


NORMAL = {
    "ztop": _ztop(-8.2923, 8.2923),
    "ztopc": _ztop(-8.29, None),
    "ptoz": lambda p: 0.0 if p <= 0 or p >= 1 else tail_inverse(p),
    "ptozc": lambda p: NAN if p < 0 or p > 1 else 13.0 if p == 0 else -13.0 if p == 1 else tail_inverse(p),
}


def normal(name: str, v: Column) -> Column:
    """Conversions between z and p values; Spark has no ``erfc``, so Arrow batches go through Python."""
    f = NORMAL[name]

    @F.pandas_udf("double")
    def run(s):
        return s.map(f).astype("float64")

    return run(v)
