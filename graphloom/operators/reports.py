"""Statistics of graphs, sources and validations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _all_of(column: str) -> Column:
    """The sum over all rows of a table of counts, which has few."""
    return F.sum(column).over(W.partitionBy())


def edge_type_counts(edges: DataFrame, types: list[str], fold: str = "fold", column: str = "relation_type") -> DataFrame:
    """A row a fold: a count for each of the given types (0 if there is none) and `total_edges` of all types."""
    counts = [F.count(F.when(F.col(column) == t, 1)).alias(f"n_{t}") for t in types]
    return edges.groupBy(fold).agg(*counts, F.count(F.lit(1)).alias("total_edges"))


def mean_std(counts: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """`statistic`, `mean`, `std` (of a sample) of columns over all rows, rounded."""
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*")
    return rows.groupBy("statistic").agg(F.round(F.avg("x"), digits).alias("mean"), F.round(F.stddev_samp("x"), digits).alias("std"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """`value`, `n`, nulls included."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def pattern_coverage(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """`pattern`, `matched`, `percent` of values that are not null."""
    rows = df.where(F.col(column).isNotNull())
    hits = rows.agg(F.count(F.lit(1)).alias("total"), *(F.count(F.when(F.col(column).rlike(p), 1)).alias(n) for n, p in patterns.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("matched")) for n in patterns)))
    return hits.select("total", each.alias("x")).select("x.pattern", "x.matched", F.round(F.when(F.col("total") > 0, 100.0 * F.col("x.matched") / F.col("total")).otherwise(0.0), 4).alias("percent"))


def status_report(df: DataFrame, status: Column) -> DataFrame:
    """`status`, `n`, `percent`."""
    counts = df.select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("status", "n", F.round(100.0 * F.col("n") / _all_of("n"), 4).alias("percent"))


def degrees(edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """`node`, `degree` in the undirected simple graph: repeated edges count once, loops and null ends not at all."""
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_distribution(edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """`degree`, `n`, `share`."""
    counts = degrees(edges, a, b).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("degree", "n", F.round(F.col("n") / _all_of("n"), 8).alias("share"))


def degree_summary(edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """`nodes`, `max_degree`, `min_degree`, `mean_degree`."""
    return degrees(edges, a, b).agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.round(F.avg("degree"), 6).alias("mean_degree"))


def split_effect(train: DataFrame, test: DataFrame, interaction: str, column: str = "relation_type") -> DataFrame:
    """`edge_type`, `train`, `whole`: training counts, and the same with the test positives added to the interaction type."""
    n_test = test.count()
    counts = train.groupBy(F.col(column).alias("edge_type")).agg(F.count(F.lit(1)).alias("train"))
    return counts.select("edge_type", "train", (F.col("train") + F.when(F.col("edge_type") == interaction, n_test).otherwise(0)).alias("whole"))


def group_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """The group, `n`, `mean`, `median` (6 decimals); null groups stay, null values do not count."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"))


def graph_health(edges: DataFrame, nodes: int, features: DataFrame) -> DataFrame:
    """`part`, `problems`: edges by type with an end that is null or lies outside 0..nodes-1, and vectors by node type that hold null, NaN or infinite numbers."""
    out_of = (F.col("source") < 0) | (F.col("target") < 0) | (F.col("source") >= nodes) | (F.col("target") >= nodes)
    a = edges.groupBy(F.concat(F.lit("edges "), F.coalesce("edge_type", F.lit("null"))).alias("part")).agg(F.count(F.when(F.coalesce(out_of, F.lit(True)), 1)).alias("problems"))
    bad = F.col("features").isNull() | F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    b = features.groupBy(F.concat(F.lit("features "), F.coalesce("node_type", F.lit("null"))).alias("part")).agg(F.count(F.when(bad, 1)).alias("problems"))
    return a.unionByName(b)


def pivot_mean(df: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """A row for each value of `row`: the whole part of the mean of `value` for each of the given values of `column` (null if there is none), as columns in the order given."""
    cells = [F.avg(F.when(F.col(column) == v, F.col(value))).cast("bigint").alias(str(v)) for v in values]
    return df.groupBy(row).agg(*cells)


def by_largest(pivot: DataFrame, row: str) -> DataFrame:
    """The same with the column of the largest entry first."""
    names = [c for c in pivot.columns if c != row]
    top = pivot.agg(*(F.max(c).alias(c) for c in names)).first()
    return pivot.select(row, *sorted(names, key=lambda c: (top[c] is None, -(top[c] or 0), c)))


def pattern_exceptions(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """`value`, `n`: values that are not null and do not match, and how often."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).rlike(pattern)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def first_mismatches(df: DataFrame, good: Column, order: str, n: int = 5) -> DataFrame:
    """The first n rows, by a column, for which a condition does not hold or is null."""
    return df.where(~F.coalesce(good, F.lit(False))).orderBy(order).limit(n)


def nested_coverage(proteins: DataFrame, accessions: DataFrame, entries: DataFrame, organism: str = "homo sapiens") -> DataFrame:
    """`measure`, `n`: entries; entries with a protein of the organism; such proteins, with and without accessions; and `source <name>` for the sources they state.

    `proteins` has entry_id, protein_no, organism, source; `accessions` entry_id, protein_no, accession; `entries` entry_id.
    """
    own = proteins.where(F.contains(F.lower("organism"), F.lit(organism)))
    named = accessions.where(F.trim("accession") != "").select("entry_id", "protein_no", F.lit(True).alias("has")).distinct()
    own = own.join(named, ["entry_id", "protein_no"], "left")
    of = lambda name, c: F.struct(F.lit(name).alias("measure"), c.alias("n"))
    totals = own.agg(F.count_distinct("entry_id").alias("e"), F.count(F.lit(1)).alias("p"), F.count("has").alias("h"))
    totals = totals.select(F.explode(F.array(of("entries with organism", F.col("e")), of("proteins", F.col("p")), of("proteins with accessions", F.col("h")), of("proteins without accessions", F.col("p") - F.col("h")))).alias("x")).select("x.*")
    sources = own.where("source is not null").groupBy(F.concat(F.lit("source "), "source").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    return entries.agg(F.count(F.lit(1)).alias("n")).select(F.lit("entries").alias("measure"), "n").unionByName(totals).unionByName(sources)


def consistency(manifest: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """`problem`, `n`: ids of the manifest that are repeated or null, ends of edges it lacks, entities without an edge, and vectors (column entity_id) of entities it lacks."""
    ids = manifest.select("entity_id").where("entity_id is not null").distinct()
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).where("entity_id is not null").distinct()
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    out = counted(manifest.groupBy("entity_id").count().where("count > 1 or entity_id is null"), "repeated or null ids")
    for df, name in ((ends.join(ids, "entity_id", "left_anti"), "ends without entity"), (ids.join(ends, "entity_id", "left_anti"), "entities without edge"), (vectors.select("entity_id").distinct().join(ids, "entity_id", "left_anti"), "vectors without entity")):
        out = out.unionByName(counted(df, name))
    return out


def modularity(edges: DataFrame, communities: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """`modularity` (9 decimals) of communities (node, community) in the undirected simple graph of the edges; null without edges."""
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    c = communities.select("node", "community")
    rows = pairs.join(c.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    ends = rows.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), (F.col("cu") == F.col("cv")).cast("int").alias("same")), F.struct(F.col("cv").alias("c"), F.lit(0).alias("same")))).alias("x")).select("x.*")
    per = ends.groupBy("c").agg(F.count(F.lit(1)).alias("degree"), F.sum("same").alias("inside"))
    total = per.agg((F.sum("degree") / 2).alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("degree").cast("double") * F.col("degree")).alias("squares"))
    return total.select(F.round(F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m")), 9).alias("modularity"))
