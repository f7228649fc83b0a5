"""Outputs of a run, and a cache that computes only what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def write_nodes(nodes: DataFrame, path: str, csv: bool = False) -> None:
    """The node table in order of global_id: Parquet in as many files as it has, or CSV parts with headers."""
    ordered = nodes.repartitionByRange("global_id").sortWithinPartitions("global_id")
    (ordered.write.mode("overwrite").option("header", True).csv if csv else ordered.write.mode("overwrite").parquet)(path)


def write_features(vectors: DataFrame, path: str, model: str | None = None) -> None:
    """`global_id`, `features`; keyed by id, so no order has to be kept. Beside it, in `<path>.meta`, one row: `model`, `n_rows`, `dim` (null unless all vectors have one length)."""
    out = vectors.select("global_id", F.col("features").cast("array<float>").alias("features"))
    out.write.mode("overwrite").parquet(path)
    size = F.size("features")
    meta = out.sparkSession.read.schema(out.schema).parquet(path).agg(F.lit(model).cast("string").alias("model"), F.count(F.lit(1)).alias("n_rows"), F.when(F.min(size) == F.max(size), F.max(size)).cast("int").alias("dim"))
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}.meta")


def load_features(spark: SparkSession, path: str, model: str | None = None, rows: int | None = None, dim: int | None = None) -> DataFrame:
    """The vectors written by `write_features`. ValueError if the table or its metadata is missing, or the metadata differ from what is asked for."""
    if not exists(spark, path) or not exists(spark, f"{path}.meta"):
        raise ValueError(f"{path} has no features or no metadata")
    meta = spark.read.parquet(f"{path}.meta").first()
    for what, want in (("model", model), ("n_rows", rows), ("dim", dim)):
        if want is not None and meta[what] != want:
            raise ValueError(f"{path}: {what} is {meta[what]}, not {want}")
    return spark.read.parquet(path)


def write_graph(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").partitionBy("fold").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").partitionBy("fold", "split").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def missing(requested: DataFrame, cached: DataFrame, key: str = "entity_id") -> DataFrame:
    """Requested keys (not null, each once) that the cache lacks."""
    return requested.select(key).where(f"{key} is not null").distinct().join(cached.select(key).distinct(), key, "left_anti")


def cached(requested: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "entity_id", force: bool = False) -> DataFrame:
    """Rows of the requested keys from the cache table at `path`; those it lacks are computed first and appended. `force` starts the cache anew."""
    spark = requested.sparkSession
    if force or not exists(spark, path):
        compute(requested.select(key).where(f"{key} is not null").distinct()).write.mode("overwrite").parquet(path)
    else:
        new = missing(requested, spark.read.parquet(path), key)
        if not new.isEmpty():
            compute(new).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(requested.select(key).distinct(), key, "left_semi")
