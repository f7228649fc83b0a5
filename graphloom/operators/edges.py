"""Algebra of edge tables: direction, merging of provenance, difference and filters by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import plain_id
from graphloom.schema import EDGES, KEYS, priority


def normalized(raw: DataFrame, order: str = "interaction_id") -> DataFrame:
    """Edges with plain ids, their order kept as `ord`; a null source is `unknown`. Missing columns become null, others are dropped."""
    have = set(raw.columns)
    cols = [F.col(order).alias("ord") if order in have else F.monotonically_increasing_id().alias("ord")]
    for field in EDGES:
        c = F.col(field.name).cast(field.dataType) if field.name in have else F.lit(None).cast(field.dataType)
        if field.name in ("source_id", "target_id"):
            c = plain_id(c)
        elif field.name == "source_dataset":
            c = F.coalesce(c, F.lit("unknown"))
        elif field.name == "label":
            c = F.coalesce(c, F.lit(1)) if field.name in have else F.lit(1)
        cols.append(c.alias(field.name))
    return raw.select(*cols)


def canonical(edges: DataFrame) -> DataFrame:
    """Turns each edge so that the end with the lower priority number comes first; ends of equal priority are ordered as text. Scores and sources stay."""
    ps, pt = priority(F.col("source_type")), priority(F.col("target_type"))
    swap = F.coalesce((ps > pt) | ((ps == pt) & (F.col("source_id") > F.col("target_id"))), F.lit(False))
    turned = {a: F.when(F.col("_swap"), F.col(b)).otherwise(F.col(a)) for x, y in (("source_id", "target_id"), ("source_type", "target_type")) for a, b in ((x, y), (y, x))}
    return edges.withColumn("_swap", swap).withColumns(turned).drop("_swap")


def sources_of(c: Column) -> Column:
    return F.split(c, r"\|")


def merged(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): of other columns the first value that is not null by `ord`, and the sorted union of all sources joined with `|`.

    Edges with a null key drop out. Joined sources are taken apart, so merging again changes nothing.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ord", c))).getField(c).alias(c)
    union = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(sources_of(F.col("source_dataset")))))), "|")
    rows = edges.where(" and ".join(f"{k} is not null" for k in KEYS))
    out = rows.groupBy(*KEYS).agg(F.min("ord").alias("ord"), *(first(c) for c in ("source_type", "target_type", "label", "raw_score")), union.alias("source_dataset"))
    return out.select("ord", *EDGES.names)


def store(*raws: DataFrame) -> DataFrame:
    """An edge store of one or several raw edge tables: brought together, turned, merged."""
    out = raws[0]
    for other in raws[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return merged(canonical(out))


def endpoints(edges: DataFrame) -> DataFrame:
    """`entity_id`: every end that is not null, once."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).where("entity_id is not null").distinct()


def pure(edges: DataFrame, valid: DataFrame) -> DataFrame:
    """Edges both of whose ends are in `valid` (column entity_id)."""
    ids = valid.select("entity_id").where("entity_id is not null").distinct()
    one = edges.join(ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi")
    return one.join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges of `left` whose key is not in `right`; repeated keys of `left` stay, other columns do not count, null equals null."""
    r = right.select(*(F.col(k).alias(f"_{k}") for k in KEYS)).distinct()
    return left.join(r, [left[k].eqNullSafe(r[f"_{k}"]) for k in KEYS], "left_anti")


def touching(edges: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Edges with (or, if not keep, without) an end in `ids` (column entity_id)."""
    mark = ids.select("entity_id").where("entity_id is not null").distinct()
    if keep:
        s, t = mark.select(F.col("entity_id").alias("source_id"), F.lit(True).alias("_s")), mark.select(F.col("entity_id").alias("target_id"), F.lit(True).alias("_t"))
        return edges.join(s, "source_id", "left").join(t, "target_id", "left").where("_s or _t").select(*edges.columns)
    one = edges.join(mark.withColumnRenamed("entity_id", "source_id"), "source_id", "left_anti")
    return one.join(mark.withColumnRenamed("entity_id", "target_id"), "target_id", "left_anti").select(*edges.columns)


def with_logic_ids(edges: DataFrame, ids: DataFrame, strict: bool = True) -> DataFrame:
    """`source`, `target`, `relation_type`, `source_dataset`, `score` with dense ids (columns entity_id, global_id of `ids`).

    A score that is null is 1. An end without an id raises an error when the row is computed, or, if not strict, drops the edge.
    """
    a = ids.select(F.col("entity_id").alias("source_id"), F.col("global_id").alias("source"))
    b = ids.select(F.col("entity_id").alias("target_id"), F.col("global_id").alias("target"))
    how = "left" if strict else "inner"
    out = edges.join(a, "source_id", how).join(b, "target_id", how)
    known = lambda c, i: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("no id for entity "), F.coalesce(F.col(i), F.lit("null")))).cast("bigint")).alias(c) if strict else F.col(c)
    return out.select(known("source", "source_id"), known("target", "target_id"), "relation_type", "source_dataset", F.coalesce("raw_score", F.lit(1.0)).alias("score"))


def with_known_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """`source`, `target`, `relation_type` of every edge, in dense ids (columns entity_id, global_id of `ids`); an end without an id is null."""
    a = ids.select(F.col("entity_id").alias("source_id"), F.col("global_id").alias("source"))
    b = ids.select(F.col("entity_id").alias("target_id"), F.col("global_id").alias("target"))
    return edges.join(a, "source_id", "left").join(b, "target_id", "left").select("source", "target", "relation_type")
