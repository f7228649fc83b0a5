"""Queries over small tables: what they must not leave out."""

import pytest

from graphloom.operators import edges as E
from graphloom.operators import reports as R
from graphloom.plans import core


@pytest.fixture
def tables(spark, make_edges, tmp_path):
    """Writes canonical_interaction (rows of make_edges) and further tables (rows, schema); gives the folder."""

    def write(edge_rows, **others):
        make_edges(edge_rows).write.parquet(f"{tmp_path}/canonical_interaction.parquet")
        for name, (rows, schema) in others.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


NODES = "global_id bigint, authoritative_id string, node_type string, features array<double>"


def test_local_ids_and_fold_edges_keep_odd_nodes(spark, tables):
    nodes = [(i, k, "molecule" if k < "P" else "protein", [1.0]) for i, k in enumerate(("D1", "P1", "D2", "P2", "D3"), 1)]
    d = tables([("D1", "P1"), ("D2", "P2"), ("D3", "P1"), ("D3", "P9")], node_features=(nodes, NODES))
    assert {r.global_id: r.local_id for r in core.local_ids(spark, d).collect()} == {1: 0, 3: 1, 5: 2, 2: 3, 4: 4}
    assert {(r.source, r.target) for r in core.fold_edges(spark, d).collect()} == {(0, 3), (1, 4), (2, 3)}  # P9 is no node


def test_warm_kfold_gives_every_edge_a_fold(spark, tables):
    d = tables([(f"D{i}", "P1") for i in range(12)] + [("D1", "P2"), ("D2", "P3")])
    got = core.warm_kfold(spark, d).collect()
    assert len({(r.source_id, r.target_id) for r in got}) == len(got) == 14
    assert sorted(sum(r.fold == k for r in got) for k in range(1, 6)) == [2, 3, 3, 3, 3]


def test_warm_kfold_deals_the_edges_of_each_target(spark, tables):
    d = tables([(f"D{i}", t) for t, n in (("P1", 10), ("P2", 6)) for i in range(n)])
    got = core.warm_kfold(spark, d).collect()
    assert len(got) == 16
    assert [sum(r.fold == k and r.target_id == "P1" for r in got) for k in range(1, 6)] == [2] * 5
    assert sorted(sum(r.fold == k and r.target_id == "P2" for r in got) for k in range(1, 6)) == [1, 1, 1, 1, 2]


def test_graph_health_reports_on_edges(spark, tables):
    d = tables([("D1", "P1"), ("D2", "P1"), ("D2", "P2", "inhibits")], node_features=([(1, "D1", "molecule", [float("nan")])], NODES))
    assert {r.part: r.problems for r in core.graph_health(spark, d).collect()} == {"edges interacts_with": 0, "edges inhibits": 0, "features molecule": 1}


def test_ends_without_a_node_are_problems(spark, make_edges):
    ids = spark.createDataFrame([("D1", 0), ("P1", 1)], "entity_id string, global_id bigint")
    edges = E.with_known_ids(make_edges([("D1", "P1"), ("D1", "P2"), ("D3", "P1")]), ids).withColumnRenamed("relation_type", "edge_type")
    none = spark.createDataFrame([], NODES)
    assert [tuple(r) for r in R.graph_health(edges, 2, none).collect()] == [("edges interacts_with", 2)]
