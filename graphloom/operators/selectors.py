"""Declarative predicates on entities and edges, compiled to Catalyst expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import metatype


@dataclass(frozen=True)
class EntitySelector:
    """Entities of one of the types, one of the metatypes (`molecule`, `protein`) and at least one of the sources; an empty list sets no condition."""

    entity_types: tuple[str, ...] = ()
    meta_types: tuple[str, ...] = ()
    from_sources: tuple[str, ...] = ()

    def conditions(self, kind: Column, sources: Column) -> Column | None:
        parts = []
        if self.entity_types:
            parts.append(kind.isin(*self.entity_types))
        if self.meta_types:
            parts.append(metatype(kind).isin(*[m for m in self.meta_types if m in ("molecule", "protein")]) if set(self.meta_types) & {"molecule", "protein"} else F.lit(False))
        if self.from_sources:
            parts.append(F.arrays_overlap(sources, F.array(*map(F.lit, self.from_sources))))
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False)) if parts else None


@dataclass(frozen=True)
class InteractionSelector:
    """Edges of one of the relations whose ends satisfy the two selectors in either direction."""

    source: EntitySelector | None = None
    target: EntitySelector | None = None
    relation_types: tuple[str, ...] = ()


def select_entities(entities: DataFrame, selector: EntitySelector) -> DataFrame:
    """Entities that satisfy a selector; an empty selector takes all."""
    cond = selector.conditions(F.col("entity_type"), F.col("all_sources"))
    return entities if cond is None else entities.where(cond)


def select_edges(edges: DataFrame, entities: DataFrame, selector: InteractionSelector | None) -> DataFrame:
    """Edges that satisfy a selector. An end without metadata fails every non-empty entity selector. None takes all edges.

    The relation is tested first, so it reaches the scan; entity columns are joined only if a selector needs them.
    """
    if selector is None:
        return edges
    out = edges.where(F.col("relation_type").isin(*selector.relation_types)) if selector.relation_types else edges
    of = lambda s, p: None if s is None else s.conditions(F.col(f"_{p}_type"), F.col(f"_{p}_sources"))
    if all(of(s, "s") is None for s in (selector.source, selector.target)):
        return out
    meta = entities.select("entity_id", "entity_type", "all_sources")
    for p, c in (("s", "source_id"), ("t", "target_id")):
        out = out.join(meta.select(F.col("entity_id").alias(c), F.col("entity_type").alias(f"_{p}_type"), F.col("all_sources").alias(f"_{p}_sources")), c, "left")
    true = lambda c: F.lit(True) if c is None else c
    forward = true(of(selector.source, "s")) & true(of(selector.target, "t"))
    backward = true(of(selector.source, "t")) & true(of(selector.target, "s"))
    return out.where(forward | backward).select(*edges.columns)
