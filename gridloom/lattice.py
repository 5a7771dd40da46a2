"""The lattice: an image as a dense relation ``(t, z, y, x, v)`` with its geometry.

A Lattice is immutable and lazy. Operators compose DataFrame expressions, so that a chain of pointwise
operators is one projection, a reduction one aggregate, and an operation with a second image an equi-join on
the voxel key. Rows are never dropped by operators that "zero" values: lattices stay dense.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Voxel counts up to which the three-dimensional side of a join is broadcast.
BROADCAST_VOXELS = 2_000_000
K = ("z", "y", "x")


@dataclass(frozen=True)
class Lattice:
    df: DataFrame
    shape: tuple[int, int, int, int]  # nx, ny, nz, nt
    pix: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)
    affine: tuple = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))
    dtype: str = "double"
    sites: tuple = ("box", (3, 3, 3))
    header: tuple = ()  # sorted pairs of further header fields

    @classmethod
    def of(cls, df: DataFrame, shape, **more) -> Lattice:
        """From a DataFrame with ``x, y, z, t`` and ``v``; indices are ints from 0."""
        dtype = more.get("dtype", "double")
        return cls(df.select(*(F.col(c).cast("int").alias(c) for c in ("t", "z", "y", "x")), F.col("v").cast(dtype).alias("v")), tuple(shape), **more)

    @classmethod
    def of_numpy(cls, spark, a: np.ndarray, **more) -> Lattice:
        """From an array indexed ``[t, z, y, x]`` or ``[z, y, x]``; for small images."""
        import pandas as pd

        a = a[None] if a.ndim == 3 else a
        t, z, y, x = (i.ravel().astype(np.int32) for i in np.indices(a.shape))
        return cls.of(spark.createDataFrame(pd.DataFrame({"t": t, "z": z, "y": y, "x": x, "v": a.ravel().astype(float)})), a.shape[::-1], **more)

    def to_numpy(self) -> np.ndarray:
        """As an array indexed ``[t, z, y, x]``, on the driver: for small images and sinks."""
        nx, ny, nz, nt = self.shape
        out = np.full((nt, nz, ny, nx), np.nan)
        p = self.df.toPandas()
        out[p.t, p.z, p.y, p.x] = p.v
        return out

    @property
    def negative(self) -> bool:
        """Whether the affine's determinant is below zero."""
        return bool(np.linalg.det(np.array(self.affine)[:, :3]) < 0)

    @property
    def voxels(self) -> int:
        return int(np.prod(self.shape[:3]))

    def fields(self) -> dict:
        return dict(self.header)

    def with_fields(self, **kv) -> Lattice:
        return replace(self, header=tuple(sorted({**dict(self.header), **kv}.items())))

    def with_df(self, df: DataFrame, **more) -> Lattice:
        return replace(self, df=df.select("t", "z", "y", "x", F.col("v").cast(self.dtype).alias("v")), **more)

    def map(self, f: Callable[[Column], Column]) -> Lattice:
        """A pointwise operator."""
        return self.with_df(self.df.withColumn("v", f(F.col("v"))))

    def linear_index(self) -> Column:
        """The linear index, x fastest."""
        nx, ny, nz, _ = (F.lit(n).cast("long") for n in self.shape)
        return F.col("x") + nx * (F.col("y") + ny * (F.col("z") + nz * F.col("t")))

    def join(self, other: Lattice, f: Callable[[Column, Column], Column]) -> Lattice:
        """Combine with a second image voxel by voxel; a three-dimensional side serves every volume."""
        if self.shape[:3] != other.shape[:3]:
            raise ValueError(f"images differ in size: {self.shape[:3]} and {other.shape[:3]}")
        if self.shape[3] != other.shape[3] and 1 not in (self.shape[3], other.shape[3]):
            raise ValueError("images of several volumes must have equally many")
        b = other.df.withColumnRenamed("v", "w")
        if self.shape[3] == other.shape[3]:
            return self.with_df(self.df.join(b, ["t", *K]).withColumn("v", f(F.col("v"), F.col("w"))))
        small = lambda df, lat: F.broadcast(df) if lat.voxels <= BROADCAST_VOXELS else df
        if other.shape[3] == 1:
            joined = self.df.join(small(b.drop("t"), other), list(K))
        else:
            joined = small(self.df.drop("t"), self).join(b, list(K))
        shape = (*self.shape[:3], max(self.shape[3], other.shape[3]))
        return self.with_df(joined.withColumn("v", f(F.col("v"), F.col("w"))), shape=shape)

    def with_row(self, row: DataFrame, f: Callable[[Column], Column]) -> Lattice:
        """A pointwise operator that also sees the columns of a one-row DataFrame."""
        return self.with_df(self.df.crossJoin(F.broadcast(row)).withColumn("v", f(F.col("v"))))

    def apply(self, name: str, *args) -> Lattice:
        """An operator by its name."""
        from gridloom.operators import REGISTRY

        if name not in REGISTRY:
            raise ValueError(f"unknown operator {name!r}")
        return REGISTRY[name](self, *args)

    def __getattr__(self, name: str):
        from gridloom.operators import REGISTRY

        key = name.rstrip("_")
        if key not in REGISTRY:
            raise AttributeError(name)
        return lambda *args: REGISTRY[key](self, *args)
