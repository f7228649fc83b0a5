"""Global ranks without a global partition, and orders that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.storage import materialize


def hash_order(seed: int, purpose: str, *key: Column) -> Column:
    """A pseudo-random order: md5 of seed, purpose and key. It repeats on any cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *(F.coalesce(k.cast("string"), F.lit("")) for k in key)))


def hash_rank(df: DataFrame, order: str, strata: tuple[str, ...] = (), ties: tuple[str, ...] = (), digits: int = 3, name: str = "rank") -> DataFrame:
    """Adds the rank (from 0) of each row within its strata by the hex text in column `order`.

    Rows are ranked within 16 ** digits prefixes of the order, and the counts of earlier prefixes are added, so a stratum with a third of all rows,
    or no stratum at all, is still ranked by many tasks.
    """
    df = df.withColumn("_p", F.substring(order, 1, digits))
    counts = df.groupBy(*strata, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*strata).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    keys = [*strata, "_p"]
    own = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order, *ties)) - 1)
    on = [own[k].eqNullSafe(before[k]) for k in strata] + [own["_p"] == before["_p"]]
    joined = own.join(before, on).drop(*(before[k] for k in keys))
    return joined.withColumn(name, (F.col("_r") + F.col("_before")).cast("bigint")).drop("_p", "_r", "_before")


def sorted_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds the rank (from 0) of each row by natural order: rows are partitioned by range, ranked there, and earlier ranges are counted."""
    order_names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *(o.alias(n) for o, n in zip(order, order_names)))
    by = [F.col(n).asc_nulls_last() for n in order_names]
    ranged = materialize(keyed.repartitionByRange(*by).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).drop("_n")  # a row a partition
    own = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_pid").orderBy(*by)) - 1)
    return own.join(F.broadcast(before), "_pid").withColumn(name, (F.col("_r") + F.col("_before")).cast("bigint")).drop("_pid", "_r", "_before", *order_names)
