"""The entity table: types and sources of every id, resolved types, dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import id_number, positive_id
from graphloom.operators.edges import sources_of
from graphloom.operators.ranking import sorted_rank
from graphloom.operators.selectors import EntitySelector, select_entities
from graphloom.schema import KINDS, metatype, priority
from graphloom.storage import materialize


def collected(edges: DataFrame) -> DataFrame:
    """`entity_id`, `all_types`, `all_sources` (sorted) of every end of the edges; null ids drop out, null types are none."""
    ends = F.array(F.struct(F.col("source_id").alias("entity_id"), F.col("source_type").alias("t")), F.struct(F.col("target_id").alias("entity_id"), F.col("target_type").alias("t")))
    rows = edges.select(F.explode(ends).alias("e"), "source_dataset").select("e.entity_id", "e.t", F.explode(sources_of(F.col("source_dataset"))).alias("s"))
    return rows.where("entity_id is not null").groupBy("entity_id").agg(F.array_sort(F.collect_set("t")).alias("all_types"), F.array_sort(F.collect_set("s")).alias("all_sources"))


def resolved(types: Column) -> Column:
    """The type of the lowest priority number; ties (unknown types) go by name."""
    return F.array_min(F.transform(types, lambda t: F.struct(priority(t).alias("p"), t.alias("t")))).getField("t")


def manifest(edges: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """The entity manifest; structures (entity_id, structure) are filled in where given."""
    out = collected(edges).withColumn("entity_type", resolved(F.col("all_types")))
    out = out.withColumn("structure", F.lit(None).cast("string")) if structures is None else out.join(structures.select("entity_id", "structure").dropDuplicates(["entity_id"]), "entity_id", "left")
    return out.select("entity_id", "entity_type", "all_types", "all_sources", "structure")


def enrich(entities: DataFrame, structures: DataFrame) -> DataFrame:
    """Fills null structures from a side table (entity_id, structure)."""
    side = structures.select("entity_id", F.col("structure").alias("_s")).where("_s is not null").dropDuplicates(["entity_id"])
    return entities.join(side, "entity_id", "left").withColumn("structure", F.coalesce("structure", "_s")).drop("_s").select(*entities.columns)


def to_enrich(entities: DataFrame, kind: str) -> DataFrame:
    """`entity_id` of the entities whose structure is unknown: of kind `molecule` those of a molecule, drug or ligand type with a positive whole id (as text, each once), of kind `protein` those of type protein."""
    open_ = entities.where(F.col("structure").isNull() & F.col("entity_id").isNotNull())
    if kind == "protein":
        return open_.where("entity_type = 'protein'").select("entity_id").distinct()
    ids = open_.where(F.col("entity_type").rlike("molecule|drug|ligand")).select(positive_id(F.col("entity_id")).alias("i"))
    return ids.where("i is not null").select(F.col("i").cast("string").alias("entity_id")).distinct()


def ids_of(entities: DataFrame, selected: EntitySelector | Column) -> DataFrame:
    """`entity_id` of the entities that satisfy a selector or a condition."""
    rows = entities.where(F.coalesce(selected, F.lit(False))) if isinstance(selected, Column) else select_entities(entities, selected)
    return rows.select("entity_id").where("entity_id is not null").distinct()


def mixed_types(entities: DataFrame) -> DataFrame:
    """`entity_type`, `numbers`, `texts`: types whose ids are partly numbers, partly text; they have no natural order."""
    number = id_number(F.col("entity_id")).isNotNull()
    return entities.groupBy("entity_type").agg(F.count(F.when(number, 1)).alias("numbers"), F.count(F.when(~number, 1)).alias("texts")).where("numbers > 0 and texts > 0")


def logic_ids(entities: DataFrame, strict: bool = False) -> DataFrame:
    """Adds `global_id`, dense from 0: types by priority, then name; within a type ids by number, then as text.

    If strict, a type with numbers and texts among its ids raises ValueError.
    """
    if strict and (bad := mixed_types(entities).limit(5).collect()):
        raise ValueError(f"ids of mixed kinds in types {[r['entity_type'] for r in bad]}")
    return sorted_rank(entities, priority(F.col("entity_type")), F.col("entity_type"), id_number(F.col("entity_id")), F.col("entity_id"), name="global_id")


def nodes(entities: DataFrame) -> DataFrame:
    """The node table: `global_id`, `node_type`, `authoritative_id`, `sources` (sorted, joined with commas), `sequence_or_smiles` (empty if unknown)."""
    return logic_ids(entities).select(
        "global_id", F.col("entity_type").alias("node_type"), F.col("entity_id").alias("authoritative_id"),
        F.array_join(F.array_sort("all_sources"), ",").alias("sources"), F.coalesce("structure", F.lit("")).alias("sequence_or_smiles"),
    )


def type_counts(entities: DataFrame) -> DataFrame:
    """`entity_type`, `metatype`, `n`."""
    return entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).select("entity_type", metatype(F.col("entity_type")).alias("metatype"), "n")


def offsets(entities: DataFrame) -> dict[str, tuple[int, int]]:
    """First id and number of ids of every type, in order of priority; one row a type reaches the driver."""
    rows = {r["entity_type"]: r["n"] for r in type_counts(materialize(entities)).collect()}
    out, at = {}, 0
    for t in sorted(rows, key=lambda t: (KINDS[t].priority if t in KINDS else 999, t or "")):
        out[t] = (at, rows[t])
        at += rows[t]
    return out
