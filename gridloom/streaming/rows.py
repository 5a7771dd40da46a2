"""Lattice operators on unbounded voxel rows.

Pointwise operators are projections, which Spark runs on a stream as they are. Reductions over time become
windowed aggregates with a watermark, so that state is dropped once a window can't change any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lattice import Lattice


def pointwise(rows: DataFrame, shape, *steps: tuple) -> DataFrame:
    """``rows`` (batch or stream) through steps such as ``("mul", 2)`` or ``("exp",)``."""
    lat = Lattice.of(rows, shape)
    for name, *args in steps:
        lat = lat.apply(name, *args)
    return lat.df


def windowed_mean(rows: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The mean of each site in tumbling windows of event time."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), "z", "y", "x").agg(F.avg("v").alias("v"))
