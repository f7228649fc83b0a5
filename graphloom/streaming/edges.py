"""Edges that arrive as a stream: turned and normalised row by row, repeats dropped within a watermark, new entities appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.edges import canonical, endpoints, normalized
from graphloom.schema import EDGES, KEYS
from graphloom.sources.sinks import exists, missing


def canonical_stream(raw: DataFrame, time: str = "loaded_at", delay: str = "1 hour") -> DataFrame:
    """Canonical edges of a stream with `event_time`; a key that comes again within the delay is dropped, so state stays bounded by the delay."""
    rows = canonical(normalized(raw.withColumn("ord", F.col(time)), "ord").withColumnRenamed("ord", "event_time"))
    rows = rows.where(" and ".join(f"{k} is not null" for k in KEYS)).withWatermark("event_time", delay)
    return rows.dropDuplicatesWithinWatermark(list(KEYS)).select("event_time", *EDGES.names)


def append_entities(path: str):
    """A foreachBatch function that appends the ids a batch brings and the table at `path` lacks."""

    def write(batch: DataFrame, _: int) -> None:
        ids = endpoints(batch)
        new = missing(ids, batch.sparkSession.read.parquet(path)) if exists(batch.sparkSession, path) else ids
        new.write.mode("append").parquet(path)

    return write
