"""From raw edges to graphs and labels of every fold, as one chain of DataFrames cut only at tables that several steps read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators import entities as N
from graphloom.operators import filters as P
from graphloom.operators import graph as G
from graphloom.operators import labels as L
from graphloom.operators import sampling as S
from graphloom.operators import similarity as V
from graphloom.operators import splits as X
from graphloom.operators.selectors import select_entities
from graphloom.schema import MOLECULES, RELATIONS
from graphloom.sources import sinks
from graphloom.storage import materialize


@dataclass(frozen=True)
class Config:
    """What changes results. Flags name the relations and similarity edge types that become edges; a flag no edge can have is an error."""

    seed: int = 514
    rules: P.SourceRules = field(default_factory=P.SourceRules)
    strata: tuple[S.Stratum, ...] = ()
    fraction: float = 1.0
    split: X.SplitConfig = field(default_factory=X.SplitConfig)
    flags: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(RELATIONS, True))
    top_k: int = 10
    thresholds: dict[tuple[str, str], float] = field(default_factory=lambda: dict(V.THRESHOLDS))
    similarity: bool = True

    def check(self, relations: set[str]) -> None:
        made = {f"{a}_{b}_similarity" for a, b in self.thresholds} | relations | set(RELATIONS)
        if unknown := set(self.flags) - made:
            raise ValueError(f"flags that match no edge: {sorted(unknown)}")


@dataclass
class Prepared:
    """Nodes and the sampled edges between them."""

    entities: DataFrame
    ids: DataFrame
    edges: DataFrame


def prepare(raw: DataFrame, config: Config, structures: DataFrame | None = None, properties: DataFrame | None = None, whitelist: DataFrame | None = None) -> Prepared:
    """Merges raw edges, builds entities, keeps the valid ones (if properties and a whitelist are given), gives dense ids and samples edges between valid entities."""
    store = materialize(E.store(E.normalized(raw)))
    entities = N.manifest(store, structures)
    if properties is not None and whitelist is not None:
        entities = P.validated(entities, properties, config.rules, whitelist).where("valid").drop("valid", "reason")
    ids = materialize(N.logic_ids(entities))
    kept = materialize(E.pure(store, ids))
    config.check({r[0] for r in kept.select("relation_type").distinct().limit(10_000).collect()})
    sampled = S.stratified(kept, list(config.strata), config.seed) if config.strata else kept
    sampled = S.uniform(materialize(sampled), config.fraction, config.seed) if config.fraction < 1 else sampled
    return Prepared(ids.drop("global_id"), ids, materialize(sampled))


@dataclass
class FoldTables:
    number: int
    graph: DataFrame
    train_labels: DataFrame
    test_labels: DataFrame


def fold_graph(fold: X.Fold, data: Prepared, vectors: DataFrame | None, config: Config) -> DataFrame:
    """`source`, `target`, `edge_type`, `source_dataset`, `score` (scaled within its type) of a fold: enabled training edges and similarity edges among the fold's nodes, without leaks."""
    edges = E.with_logic_ids(G.enabled(fold.train_graph, config.flags), data.ids).withColumnRenamed("relation_type", "edge_type")
    if config.similarity and vectors is not None:
        nodes = materialize(edges.select(F.explode(F.array("source", "target")).alias("global_id")).distinct())
        types = data.ids.join(nodes, "global_id", "left_semi").select(F.col("global_id").alias("id"), F.col("entity_type").alias("type"), F.col("entity_type").isin(*MOLECULES).alias("molecule"))
        own = vectors.select("global_id", "features").join(types.select(F.col("id").alias("global_id"), "molecule"), "global_id")
        found = V.candidates(own, types, config.top_k, class_col="molecule", thresholds=config.thresholds or V.THRESHOLDS)
        edges = edges.unionByName(V.similarity_edges(found, config.thresholds, config.flags))
    cold = fold.cold_ids.join(data.ids.select("entity_id", "global_id"), "entity_id").select(F.col("global_id").alias("id"))
    return G.minmax(G.without_leaks(edges, cold, RELATIONS))


def folds(data: Prepared, vectors: DataFrame | None, config: Config) -> Iterator[FoldTables]:
    """Graph and labels of every fold."""
    split = config.split.with_defaults()
    scope = split.evaluation_scope
    pools = [select_entities(data.ids, s) if s else data.ids for s in (scope.source, scope.target)]
    for fold in X.folds(data.edges, data.entities, config.split):
        test = L.labelled(fold.test, *pools, data.edges, data.ids, config.seed, fold.number)
        yield FoldTables(fold.number, fold_graph(fold, data, vectors, config), L.train_labels(fold.train_labels, data.ids), test)


def run(raw: DataFrame, out: str, config: Config | None = None, structures: DataFrame | None = None, properties: DataFrame | None = None, whitelist: DataFrame | None = None, vectors: DataFrame | None = None) -> None:
    """Writes nodes, graphs by fold and labels by fold and split below `out`. `vectors` has entity_id and features. No edges left: only nodes are written."""
    config = config or Config()
    data = prepare(raw, config, structures, properties, whitelist)
    sinks.write_nodes(N.nodes(data.entities), f"{out}/nodes")
    keyed = None if vectors is None else materialize(vectors.join(data.ids.select("entity_id", "global_id"), "entity_id").select("global_id", "features"))
    if keyed is not None:
        sinks.write_features(keyed, f"{out}/node_features")
    if data.edges.isEmpty():
        return
    graphs = labels = None
    for f in folds(data, keyed, config):
        graph = f.graph.withColumn("fold", F.lit(f.number))
        both = f.train_labels.withColumn("label", F.lit(1)).withColumn("split", F.lit("train")).unionByName(f.test_labels.withColumn("split", F.lit("test"))).withColumn("fold", F.lit(f.number))
        graphs = graph if graphs is None else graphs.unionByName(graph)
        labels = both if labels is None else labels.unionByName(both)
    sinks.write_graph(graphs, f"{out}/graph")
    sinks.write_labels(labels, f"{out}/labels")
