"""Lattices over plain tables, for data that doesn't come as images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.lattice import Lattice


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return df.select(F.col("vec_id").cast("int").alias("n"), F.posexplode("embedding").alias("i", "v")), df.count()


def emb4d(spark: SparkSession, sf_dir: str) -> Lattice:
    """4 by 4 by 4 sites, one volume for each vector."""
    df, n = _embeddings(spark, sf_dir)
    i = F.col("i")
    return Lattice.of(df.select((i % 4).alias("x"), (F.floor(i / 4) % 4).alias("y"), F.floor(i / 16).alias("z"), F.col("n").alias("t"), "v"), (4, 4, 4, n))


def emb3d(spark: SparkSession, sf_dir: str) -> Lattice:
    """8 by 8 sites, one plane for each vector."""
    df, n = _embeddings(spark, sf_dir)
    i = F.col("i")
    return Lattice.of(df.select((i % 8).alias("x"), F.floor(i / 8).alias("y"), F.col("n").alias("z"), F.lit(0).alias("t"), "v"), (8, 8, n, 1))


def event_series(spark: SparkSession, sf_dir: str) -> Lattice:
    """One site for each user, with all its events in order of time as the series; shorter series end early."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    users = ev.groupBy("user_id").count()
    n, length = users.agg(F.count("*"), F.max("count")).first()
    number = users.select("user_id", (F.row_number().over(Window.orderBy("user_id")) - 1).alias("x"))
    df = ev.withColumn("t", t).join(F.broadcast(number) if n < 1_000_000 else number, "user_id")
    return Lattice.of(df.select("x", F.lit(0).alias("y"), F.lit(0).alias("z"), "t", F.col("value").alias("v")), (n, 1, 1, length or 0))
