"""Groups of related records, and splits that keep them together, by breadth-first search from many seeds at once.

Adjacency lists are hash-partitioned. Every node that outranks all its neighbours (by degree, then hash) is a seed; all seeds
expand their frontiers concurrently, and an unlabelled node takes the smallest label that reaches it. Where two labels
meet, they become a link of a much smaller graph of labels, which union-find merges in one task if it has at most TASK_LINKS
links; a larger one is searched from its own seeds in turn. No links or components reach the driver, only counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions.ids import entity_key
from graphloom.storage import materialize

#: Links of a graph of labels that one task merges (some 50 MB of Python memory).
TASK_LINKS = 200_000
#: Components with more than 1/LARGE_SHARE of the rows (so fewer than LARGE_SHARE of them) are placed one by one.
LARGE_SHARE = 1000
#: Hash ranges over which the running count of rows is kept.
RANGES = 1024


def ends(edges: DataFrame) -> DataFrame:
    """`s`, `t`: the comparable ends of each edge; either may be null."""
    return edges.select("interaction_id", entity_key(F.col("source_id")).alias("s"), entity_key(F.col("target_id")).alias("t"))


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for u, v in zip(pdf["u"], pdf["v"]):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pd.DataFrame({"u": part, "label": [find(x) for x in part]})


def _search(both: DataFrame) -> DataFrame:
    """(u, label) of every node of the graph; `both` holds each link in both directions, without loops and repeats."""
    degrees = both.groupBy("u").agg(F.count(F.lit(1)).alias("d")).select("u", F.struct((-F.col("d")).alias("d"), F.xxhash64("u").alias("h"), F.col("u").alias("id")).alias("rank"))
    best = both.join(degrees.select(F.col("u").alias("v"), F.col("rank").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
    labels = materialize(degrees.join(best, "u").select("u", F.when(F.col("rank") < F.col("other"), F.col("u")).alias("label")))
    frontier, rest = labels.where("label is not null"), labels.where("label is null").select("u")
    done = [frontier]
    while True:
        reached = frontier.join(both, "u").groupBy("v").agg(F.min("label").alias("label")).withColumnRenamed("v", "u")
        step = materialize(rest.join(reached, "u", "left").select("u", "label"))
        left, new = step.where("label is null").select("u"), step.where("label is not null")
        done.append(new)
        if left.isEmpty():
            break
        frontier, rest = new, left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _merge(links: DataFrame) -> DataFrame:
    """(u, label): equal labels within, and only within, a component; `links` holds each link once, without loops."""
    both = materialize(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = materialize(_search(both))
    met = (
        links.join(labels, "u")
        .select("v", F.col("label").alias("lu"))
        .join(labels.select(F.col("u").alias("v"), F.col("label").alias("lv")), "v")
        .where("lu <> lv")
        .select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v"))
        .distinct()
    )
    smaller = materialize(met)
    n = smaller.count()
    if not n:
        return labels
    roots = smaller.coalesce(1).mapInPandas(_union_find, "u string, label string") if n <= TASK_LINKS else _merge(smaller)
    roots = roots.select(F.col("u").alias("label"), F.col("label").alias("root"))
    return labels.join(roots, "label", "left").select("u", F.coalesce("root", "label").alias("label"))


def entity_groups(edges: DataFrame) -> DataFrame:
    """`entity_id`, `group_id`: each id in its comparable form and the smallest id (as strings) of its group.

    An edge with one null or blank end ties nothing, but its other end is an entity; with two null ends it gives none.
    Loops and repeated edges change nothing. An empty table gives an empty result.
    """
    pairs = ends(edges).select("s", "t").distinct()
    links = materialize(pairs.where("s <> t").select(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).distinct())
    labels = materialize(_merge(links))
    groups = labels.groupBy("label").agg(F.min("u").alias("group_id"))
    tied = labels.join(groups, "label").select(F.col("u").alias("entity_id"), "group_id")
    every = pairs.select(F.explode(F.array("s", "t")).alias("entity_id")).where("entity_id is not null").distinct()
    return every.join(tied, "entity_id", "left").select("entity_id", F.coalesce("group_id", "entity_id").alias("group_id"))


def assign_splits(edges: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), seed: int = 7) -> DataFrame:
    """`interaction_id`, `group_id`, `split_name`: rows of one group never lie in two splits, the shares are kept as nearly as groups allow.

    Groups of more than 1/LARGE_SHARE of the rows are placed first, the largest first, each where most room is left; the
    others follow in hash order, filling the remaining room by their running count of rows.
    A row without any entity is a group of its own, named by its interaction_id.
    """
    keyed = ends(edges).select("interaction_id", F.coalesce("s", "t").alias("entity_id"))
    groups = entity_groups(edges)
    rows = materialize(keyed.join(groups, "entity_id", "left").select("interaction_id", F.coalesce("group_id", F.concat(F.lit("row "), F.col("interaction_id").cast("string"))).alias("group_id")))
    sizes = materialize(rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "group_id")), 1, 10), 16, 10).cast("bigint")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    names = [name for name, _ in shares]
    room = {name: share * total for name, share in shares}
    large = sizes.where(F.col("n") > F.lit(max(1, total // LARGE_SHARE))).orderBy(F.desc("n"), "group_id").collect()
    placed = []
    for g in large:
        best = max(names, key=lambda s: room[s])
        room[best] -= g["n"]
        placed.append((g["group_id"], best))
    spark = edges.sparkSession
    small = sizes if not placed else sizes.join(spark.createDataFrame(placed, "group_id string, placed string"), "group_id", "left_anti")
    small = small.withColumn("r", F.shiftright("h", 30).cast("int"))
    before, at = {}, 0
    for r in sorted(small.groupBy("r").agg(F.sum("n").alias("n")).collect(), key=lambda x: x["r"]):
        before[r["r"]], at = at, at + r["n"]
    left = [max(0.0, room[s]) for s in names]
    scale = at / sum(left) if sum(left) else 0
    cuts = [sum(left[: i + 1]) * scale for i in range(len(names))]
    offsets = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "r int, before long")
    run = F.sum("n").over(W.partitionBy("r").orderBy("h", "group_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n") / 2 + F.col("before")
    pick = F.lit(names[-1])
    for name, cut in list(zip(names, cuts))[-2::-1]:
        pick = F.when(F.col("at") < F.lit(cut), F.lit(name)).otherwise(pick)
    filled = small.join(F.broadcast(offsets), "r").withColumn("at", run).select("group_id", pick.alias("split_name"))
    chosen = filled if not placed else filled.unionByName(spark.createDataFrame(placed, "group_id string, split_name string"))
    return rows.join(chosen, "group_id").select("interaction_id", "group_id", "split_name")
