"""What the training-data operators share: checkpoints, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``. A temporary one stands in where the session has none, as in
    tests, and only on a local master: executors elsewhere couldn't read it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _edges_state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Component root of every node in an edge list ``(a, b)`` of longs: ``(node, root)``.

    Alternates the large-star and small-star operations, each an aggregate and a join, until neither changes an
    edge; no neighbourhood is ever gathered in a task. The root is the smallest node. Nodes without an edge
    are absent; self-loops are dropped; an empty list gives an empty result.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _edges_state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .where("b <> m")
            .select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
            .union(low.select("a", "m"))
            .where("a <> b")
            .distinct()
        )
        edges = materialize(small)
        new = _edges_state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
