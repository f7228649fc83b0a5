"""Operators on small cases: stratified splits, samples, extractors, pivots, communities, scratch tables."""


import pytest
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.operators import features as Y
from graphloom.operators import graph as G
from graphloom.operators import reports as R
from graphloom.operators import sampling as S
from graphloom.operators import similarity as V
from graphloom.operators import splits as X
from graphloom.sources import sinks


def test_a_warm_single_split_keeps_each_targets_share(make_edges):
    sizes = {"P1": 10, "P2": 7, "P3": 23}
    df = make_edges([(f"D{i}", t) for t, n in sizes.items() for i in range(n)])
    got = X.warm_single(df, 0.3, 514).collect()
    assert len(got) == 40 and sum(r.is_test for r in got) == 12
    per = {t: sum(r.is_test for r in got if r.target_id == t) for t in sizes}
    assert all(abs(per[t] - 0.3 * n) < 1 for t, n in sizes.items())
    again = X.warm_single(df.repartition(3), 0.3, 514).collect()
    assert {(r.interaction_id, r.is_test) for r in got} == {(r.interaction_id, r.is_test) for r in again}
    assert set(df.columns) | {"is_test"} == set(got[0].asDict())


def test_a_warm_single_split_without_strata_is_plain(make_edges):
    got = X.warm_single(make_edges([(f"D{i}", "P1") for i in range(4)] + [("D1", "P2")]), 0.5, 514).collect()
    assert len(got) == 5 and sum(r.is_test for r in got) == 3
    assert X.warm_single(make_edges([]), 0.5, 514).count() == 0


@pytest.mark.parametrize("n, rows", [(5, 2), (7, 4), (4, 2)])
def test_a_sampled_fraction_rounds_half_to_even(make_edges, n, rows):
    df = make_edges([(f"D{i}", "P1") for i in range(n)])
    assert S.sample(df, fraction=0.5).count() == rows
    assert S.sample(df, 3, 0.9).count() == 3 and S.sample(df).count() == n and S.sample(df, fraction=1.5).count() == n
    with pytest.raises(ValueError):
        S.sample(df, n + 1)


def test_extractors_compute_only_what_the_cache_lacks(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(sorted(r.entity_id for r in df.collect()))
        return Y.hashed(4).compute(df)

    known = Y.Extractors()
    known.register("protein", Y.Extractor("m", compute))
    rows = spark.createDataFrame([("A", "MKVL"), ("B", "MK"), ("C", None), (None, "MK"), ("A", "MKVL")], "entity_id string, structure string")
    got = {r.entity_id: list(r.features) for r in known.extract(rows.where("entity_id = 'A'"), "protein", str(tmp_path)).collect()}
    assert sum(got["A"]) == 2
    got = {r.entity_id: list(r.features) for r in known.extract(rows, "protein", str(tmp_path)).collect()}
    assert set(got) == {"A", "B"} and got["B"] == [0, 0, 0, 0] and seen == [["A"], ["B"]]
    with pytest.raises(ValueError):
        known.extract(rows, "molecule")


def test_pivot_puts_the_largest_column_first(spark):
    df = spark.createDataFrame([("a", "x", 1.5), ("a", "y", 9.9), ("b", "x", -2.5), ("b", "y", None), (None, "x", 3.0)], "r string, c string, v double")
    out = R.by_largest(R.pivot_mean(df, "r", "c", "v", ["x", "y", "z"]), "r")
    assert out.columns == ["r", "y", "x", "z"]
    assert {(r.r, r.x, r.y, r.z) for r in out.collect()} == {("a", 1, 9, None), ("b", -2, None, None), (None, 3, None, None)}


def test_communities_and_modularity(make_edges):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    df = make_edges(clique("A") + clique("B") + [("A1", "B1"), ("A1", "A1"), (None, "A1")])
    got = {r.node: r.community for r in G.communities(df).collect()}
    assert {got[f"A{i}"] for i in range(4)} == {"A0"} and {got[f"B{i}"] for i in range(4)} == {"B0"}
    labels = G.communities(df)
    m, inside, degree = 13, 6, 13
    assert R.modularity(df, labels).first()[0] == pytest.approx(2 * (inside / m - (degree / (2 * m)) ** 2), abs=1e-9)
    assert G.communities(make_edges([])).count() == 0
    assert R.modularity(make_edges([]), labels).first()[0] is None


def test_components_of_a_long_chain_and_a_hub(make_edges):
    rows = [(f"C{i:04}", f"C{i + 1:04}") for i in range(400)] + [("HUB", f"H{i}") for i in range(50)] + [("X", "X"), (None, "Y")]
    got = {r.node: r.component for r in G.connected_components(make_edges(rows)).collect()}
    assert {got[f"C{i:04}"] for i in range(401)} == {"C0000"} and {got[f"H{i}"] for i in range(50)} == {"H0"}
    assert got["HUB"] == "H0" and got["X"] == "X" and "Y" not in got


def test_fingerprints(spark):
    df = spark.createDataFrame([("CCO", "CCO"), ("CCOC", "CCO"), ("C", "C"), (None, "C")], "a string, b string")
    got = [r[0] for r in df.select(V.tanimoto(V.fingerprint(F.col("a")), V.fingerprint(F.col("b")))).collect()]
    assert got[:3] == [1.0, 0.5, 0.0]


def test_clusters(spark):
    rows = [(i, [float(i % 2 * 10), 1.0]) for i in range(20)]
    got = {r.id: r.cluster for r in V.cluster_labels(spark.createDataFrame(rows, "global_id bigint, features array<float>"), 2).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == len({got[i] for i in range(1, 20, 2)}) == 1 and got[0] != got[1]
    assert V.cluster_labels(spark.createDataFrame([], "global_id bigint, features array<float>"), 2).count() == 0


def test_scratch_tables_are_deleted(spark):
    with storage.scratch(spark):
        kept = storage.materialize(spark.range(3).toDF("id"))
        path = kept._graphloom_table
        assert kept.count() == 3 and sinks.exists(spark, path)
    assert not sinks.exists(spark, path)
    other = storage.materialize(spark.range(3).toDF("id"))
    storage.discard(other)
    storage.discard(spark.range(3))
    assert not sinks.exists(spark, other._graphloom_table)


def test_spread_runs_no_job(spark):
    df = storage.materialize(spark.range(100).toDF("id")).join(spark.range(5).toDF("id"), "id")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = storage.spread(df, "id")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert out.count() == 5
