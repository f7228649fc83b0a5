"""Train and test splits: cold (entities are held out) and warm (edges are), with leak-free training graphs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.edges import difference, touching
from graphloom.operators.ranking import hash_order, hash_rank, sorted_rank
from graphloom.operators.sampling import edge_order
from graphloom.operators.selectors import EntitySelector, InteractionSelector, select_edges, select_entities
from graphloom.schema import EDGES
from graphloom.storage import materialize


def fold_of(rank: Column, n: int, k: int) -> Column:
    """The fold (from 1) of a rank among n: the first n mod k folds have one more."""
    q, r = divmod(n, k)
    big = (q + 1) * r
    fold = F.when(rank < big, F.floor(rank / max(q + 1, 1))).otherwise(r + F.floor((rank - big) / max(q, 1)))
    return (fold + 1).cast("int")


def cold_folds(entities: DataFrame, k: int, seed: int) -> DataFrame:
    """`entity_id`, `fold`: entities in hash order, divided into k folds of nearly equal size."""
    ids = entities.select("entity_id").distinct().withColumn("_h", hash_order(seed, "cold", F.col("entity_id")))
    return hash_rank(ids, "_h").select("entity_id", fold_of(F.col("rank"), ids.count(), k).alias("fold"))


def warm_folds(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """Edges with `fold`: each target's edges are dealt to the folds in turn, from a fold given by the target's hash. If a target has fewer than k edges, folds are plain.

    The fewest edges of a target decide for all, as in stratified k-fold.
    """
    rows = edges.withColumn("_h", edge_order(seed, "warm"))
    least = edges.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if least is not None and least >= k:
        start = F.conv(F.substring(hash_order(seed, "turn", F.col("target_id")), 1, 8), 16, 10).cast("bigint")
        return hash_rank(rows, "_h", ("target_id",), digits=2).withColumn("fold", ((F.col("rank") + start) % k + 1).cast("int")).drop("_h", "rank")
    return hash_rank(rows, "_h").withColumn("fold", fold_of(F.col("rank"), edges.count(), k)).drop("_h", "rank")


def held_out(df: DataFrame, fraction: float, seed: int, key: tuple[str, ...], purpose: str = "single") -> DataFrame:
    """Adds `is_test`: true for ceil(rows * fraction) rows by hash order."""
    rows = df.withColumn("_h", hash_order(seed, purpose, *(F.col(c) for c in key)))
    return hash_rank(rows, "_h").withColumn("is_test", F.col("rank") < math.ceil(df.count() * fraction)).drop("_h", "rank")


def warm_single(edges: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Adds `is_test`: true for ceil(rows * fraction) edges, the same share of each target's edges as nearly as whole edges allow (what is left over goes to the largest remainders).

    If a target has a single edge, or the test or training edges are fewer than the targets, the split is plain, as in `held_out`.
    """
    per = materialize(edges.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n")))
    total = per.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("targets"), F.min("_n").alias("least")).first()
    n = total["n"] or 0
    test = math.ceil(n * fraction)
    if not n or total["least"] < 2 or min(test, n - test) < total["targets"]:
        return held_out(edges, fraction, seed, ("source_id", "target_id", "relation_type"))
    share = F.col("_n") * F.lit(test)
    quotas = per.withColumn("_q", F.floor(share / n)).withColumn("_rest", share % n)
    left = test - quotas.agg(F.sum("_q")).first()[0]
    ranked = sorted_rank(quotas, -F.col("_rest"), hash_order(seed, "rest", F.col("target_id")), name="_place")
    quotas = ranked.select(F.col("target_id").alias("_t"), (F.col("_q") + (F.col("_place") < left).cast("int")).alias("_q"))
    rows = hash_rank(edges.withColumn("_h", edge_order(seed, "single")), "_h", ("target_id",), digits=2)
    return rows.join(quotas, F.col("target_id").eqNullSafe(F.col("_t"))).withColumn("is_test", F.col("rank") < F.col("_q")).select(*edges.columns, "is_test")


@dataclass(frozen=True)
class SplitConfig:
    """mode `cold` or `warm`; strictness of cold splits `strict` or `informed`; k_folds of 1 or less makes one split by test_fraction."""

    mode: str = "cold"
    strictness: str = "strict"
    k_folds: int = 5
    test_fraction: float = 0.2
    seed: int = 514
    primary_dataset: str = "bindingdb"
    pool_scope: EntitySelector | None = None
    evaluation_scope: InteractionSelector | None = None

    def with_defaults(self) -> SplitConfig:
        """Scopes that are not given: the pool is all molecules, evaluation is on molecule-protein edges of the primary dataset. Returns a new object."""
        src = (self.primary_dataset,)
        scope = InteractionSelector(EntitySelector(meta_types=("molecule",), from_sources=src), EntitySelector(meta_types=("protein",), from_sources=src))
        pool = self.pool_scope if self.pool_scope and self.pool_scope != EntitySelector() else EntitySelector(meta_types=("molecule",))
        return replace(self, pool_scope=pool, evaluation_scope=self.evaluation_scope or scope)


@dataclass
class Fold:
    number: int
    train_graph: DataFrame
    train_labels: DataFrame
    test: DataFrame
    cold_ids: DataFrame


def train_graph(labels: DataFrame, background: DataFrame, cold: DataFrame, mode: str, strictness: str) -> DataFrame:
    """Training labels and background edges; of a strict cold split without those that touch a cold entity; empty for an unknown strictness."""
    both = labels.unionByName(background)
    if mode == "warm" or strictness == "informed":
        return both
    return touching(both, cold, keep=False) if strictness == "strict" else both.limit(0)


def folds(edges: DataFrame, entities: DataFrame, config: SplitConfig) -> Iterator[Fold]:
    """The folds of a split. Edges within the evaluation scope are split, all others are background; an empty pool gives one fold without test edges."""
    c = config.with_defaults()
    edges = materialize(edges.select(*EDGES.names))
    evaluable = materialize(select_edges(edges, entities, c.evaluation_scope))
    background = materialize(difference(edges, evaluable))
    empty = entities.select("entity_id").limit(0)
    many = c.k_folds > 1
    if c.mode == "warm":
        dealt = materialize(warm_folds(evaluable, c.k_folds, c.seed) if many else warm_single(evaluable, c.test_fraction, c.seed).withColumn("fold", F.col("is_test").cast("int")).drop("is_test"))
        for i in range(1, max(1, c.k_folds) + 1):
            test = dealt.where(F.col("fold") == i).drop("fold")
            labels = dealt.where(F.col("fold") != i).drop("fold")
            yield Fold(i, train_graph(labels, background, empty, "warm", c.strictness), labels, test, empty)
        return
    ends = materialize(evaluable.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct())
    pool = select_entities(entities, c.pool_scope).join(ends, "entity_id", "left_semi").select("entity_id")
    dealt = materialize(cold_folds(pool, c.k_folds, c.seed) if many else held_out(pool.distinct(), c.test_fraction, c.seed, ("entity_id",), "cold").select("entity_id", F.col("is_test").cast("int").alias("fold")))
    for i in range(1, max(1, c.k_folds) + 1):
        cold = dealt.where(F.col("fold") == i).select("entity_id")
        test = touching(evaluable, cold)
        labels = touching(evaluable, cold, keep=False)
        yield Fold(i, train_graph(labels, background, cold, "cold", c.strictness), labels, test, cold)
