"""Copies hidden by formatting, by progressive refinement of partitions.

Records fall into classes by ever costlier keys, and only classes with several members go on: first the lengths of the
stripped fields, then the histogram of their letters, then the full key. A record alone in its class has no copy and is dropped
from all further work. Classes are counted with map-side aggregation, so a class with a third of all rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import alnum_key, entity_key
from graphloom.storage import materialize


def edge_forms(edges: DataFrame) -> DataFrame:
    """interaction_id and the comparable ends (the smaller first) and relation of each edge; edges with a null part drop out.

    Other columns, whatever their names, are not read.
    """
    return (
        edges.select("interaction_id", entity_key(F.col("source_id")).alias("s"), entity_key(F.col("target_id")).alias("t"), alnum_key(F.col("relation_type")).alias("rel"))
        .where("s is not null and t is not null and rel is not null")
        .select("interaction_id", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "rel")
    )


def _length_class():
    n, m = F.length("a"), F.length("b")
    return F.struct(F.least(n, m).alias("x"), F.greatest(n, m).alias("y"), F.length("rel").alias("z"))


def _letters():
    """An order-free digest of the letter counts: the sum of the letters' hashes, modulo 2^40 so that no text overflows it."""
    return F.expr("aggregate(split(concat(a, b, rel), ''), 0L, (n, c) -> pmod(n + (xxhash64(c) >> 24), 1099511627776L))")


def _shared(df: DataFrame, key: str) -> DataFrame:
    several = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    return df.join(several, key, "left_semi")


def copy_groups(edges: DataFrame) -> DataFrame:
    """One row for each edge that has a copy: `interaction_id`, `keep_id` (the smallest id of its group), `copies`.

    Edges are copies if ends (in either order) and relation agree in letters and digits, in whatever case. Exact copies count.
    Null or blank ends or relations equal nothing. An empty table gives an empty result.
    """
    forms = materialize(edge_forms(edges).withColumn("k1", _length_class()))
    fine = _shared(forms, "k1").withColumn("k2", _letters())
    fine = materialize(_shared(fine.drop("k1"), "k2").drop("k2"))
    groups = fine.groupBy("a", "b", "rel").agg(F.min("interaction_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return fine.join(groups, ["a", "b", "rel"]).select("interaction_id", "keep_id", "copies")


def collapsed(edges: DataFrame) -> DataFrame:
    """One row for each distinct edge (`keep_id`, `n_copies` including itself); an edge with a null part stands for itself."""
    groups = copy_groups(edges)
    return edges.select("interaction_id").join(groups, "interaction_id", "left").select(
        F.coalesce("keep_id", "interaction_id").alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"), "interaction_id"
    ).where("keep_id = interaction_id").select("keep_id", "n_copies")


def found(edges: DataFrame) -> DataFrame:
    """`keep_id`, `copy_id` of every edge that is a copy of one with a smaller id."""
    return copy_groups(edges).where("interaction_id <> keep_id").select("keep_id", F.col("interaction_id").alias("copy_id"))
