"""Graphs for training: enabled edges, leak filters, normalised scores, local ids, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.operators.ranking import sorted_rank
from graphloom.storage import discard, materialize


def enabled(edges: DataFrame, flags: dict[str, bool], column: str = "relation_type") -> DataFrame:
    """Edges whose relation is switched on; relations without a flag are off."""
    on = [k for k, v in flags.items() if v]
    return edges.where(F.col(column).isin(*on) if on else F.lit(False))


def without_leaks(edges: DataFrame, cold: DataFrame | None, relations: tuple[str, ...], column: str = "edge_type") -> DataFrame:
    """Drops background edges (of a relation not in `relations`) that touch a cold entity (column id). None or an empty set drops nothing."""
    if cold is None:
        return edges
    marks = cold.select("id").where("id is not null").distinct()
    out = edges.join(marks.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(marks.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    background = ~F.coalesce(F.col(column).isin(*relations), F.lit(False))
    cold_end = F.coalesce("_s", F.lit(False)) | F.coalesce("_t", F.lit(False))
    return out.where(~(background & cold_end)).select(*edges.columns)


def minmax(edges: DataFrame, group: str = "edge_type", score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 within their group; a null score counts as 1 beforehand, and a group of one value has 1.

    The extremes are aggregated first, so a group with a third of all rows is no burden.
    """
    rows = edges.withColumn(score, F.coalesce(F.col(score), F.lit(1.0)))
    range_ = rows.groupBy(F.col(group).alias("_g")).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    out = rows.join(range_, rows[group].eqNullSafe(F.col("_g")))
    return out.withColumn(score, F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).select(*edges.columns)


def local_ids(nodes: DataFrame) -> DataFrame:
    """Adds `local_id`, dense from 0: molecules first, then all others, each by global_id. `nodes` has global_id and is_molecule."""
    return sorted_rank(nodes, (~F.coalesce("is_molecule", F.lit(False))).cast("int"), F.col("global_id"), name="local_id")


def to_local(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges in local ids; those with an end outside `ids` (global_id, local_id) drop out."""
    a = ids.select(F.col("global_id").alias("source"), F.col("local_id").alias("_s"))
    b = ids.select(F.col("global_id").alias("target"), F.col("local_id").alias("_t"))
    return edges.join(a, "source").join(b, "target").withColumn("source", F.col("_s")).withColumn("target", F.col("_t")).select(*edges.columns)


def to_global(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The reverse of to_local."""
    return to_local(edges, ids.select(F.col("local_id").alias("global_id"), F.col("global_id").alias("local_id")))


def fold_embeddings(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """`local_id` and features of a fold's nodes, joined by id, never by position."""
    return ids.select("global_id", "local_id").join(vectors.select("global_id", "features"), "global_id").select("local_id", "features")


def connected_components(edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """`node`, `component` (the smallest node of it). Null ends drop out.

    Rounds of contraction: every label points to the one with the least hash (another in each round) among itself and its neighbours, pointers are followed once, and links within a label
    fall away, so a round leaves less than half of the labels that still touch others, whatever the shape of the graph.
    """
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"{a} is not null and {b} is not null").distinct()
    links = materialize(pairs)
    labels = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    live, no = links.where("u <> v"), 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.min(F.struct(F.xxhash64(F.lit(no), "v").alias("h"), F.col("v").alias("to")))
        own = F.struct(F.xxhash64(F.lit(no), "u").alias("h"), F.col("u").alias("to"))
        point = both.groupBy("u").agg(least.alias("m")).select(F.col("u").alias("node"), F.least("m", own).getField("to").alias("to"))
        point = materialize(point)
        jump = materialize(point.join(point.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
        s = live.join(jump.select(F.col("node").alias("u"), F.col("to").alias("x")), "u").join(jump.select(F.col("node").alias("v"), F.col("to").alias("y")), "v")
        after = materialize(s.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct())
        labels = labels.join(jump.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        if no % 4 == 3:
            labels = materialize(labels)  # plans stay short
        discard(point)
        discard(live)
        live, no = after, no + 1
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")


def communities(edges: DataFrame, rounds: int = 5, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """`node`, `community` by label propagation: in each round every node takes the label most of its neighbours have, itself included; ties go to the smallest label.

    Repeated edges count once, loops and null ends not at all. Labels are counted before they are compared, so a hub costs a task no more than its distinct labels.
    """
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    links = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    nodes = links.select("u").distinct()
    links = links.unionByName(nodes.select("u", F.col("u").alias("v")))
    labels = nodes.select(F.col("u").alias("node"), F.col("u").alias("community"))
    for _ in range(rounds):
        votes = links.join(labels.select(F.col("node").alias("v"), "community"), "v").groupBy("u", "community").agg(F.count(F.lit(1)).alias("n"))
        labels = materialize(votes.groupBy(F.col("u").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).getField("community").alias("community")))
    return labels


def first_per_key(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key by a total order; nulls come last."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*(F.col(o).asc_nulls_last() for o in order)))).where("_r = 1").drop("_r")
