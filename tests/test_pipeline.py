import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import splits as X
from graphloom.plans import pipeline
from graphloom.operators.filters import Bounds, SourceRules


def test_from_raw_edges_to_folds(spark, make_edges, tmp_path):
    rows = [{"source_id": str(100 + i), "target_id": f"P{i % 4}", "raw_score": float(i + 1)} for i in range(24)]
    rows += [{"source_id": "P0", "target_id": "P1", "source_type": "protein", "relation_type": "physical_association", "source_dataset": "stringdb"}, {"source_id": "999", "target_id": "P9"}, {"source_id": None, "target_id": "P1"}]
    raw = make_edges(rows)
    ids = [str(100 + i) for i in range(24)] + ["999"]
    structures = spark.createDataFrame([(i, "CC") for i in ids] + [(f"P{i}", "MKV") for i in range(4)], "entity_id string, structure string")
    props = spark.createDataFrame([("CC", 30.0)], "structure string, MW double").selectExpr("*", "1.0D LogP", "1.0D HBD", "1.0D HBA", "1.0D QED", "1.0D SA_Score", "false is_pains")
    white = spark.createDataFrame([(f"P{i}",) for i in range(4)], "entity_id string")
    vectors = spark.createDataFrame([(i, [math.cos(j / 9), math.sin(j / 9)]) for j, i in enumerate(ids)], "entity_id string, features array<double>")
    config = pipeline.Config(rules=SourceRules(Bounds(mw_max=500)), split=X.SplitConfig(k_folds=3), flags={"interacts_with": True, "physical_association": True, "drug_drug_similarity": True}, top_k=3)
    out = str(tmp_path / "out")
    pipeline.run(raw, out, config, structures, props, white, vectors)
    nodes = spark.read.parquet(f"{out}/nodes")
    assert nodes.count() == 29 and nodes.agg(F.max("global_id")).first()[0] == 28  # P9 is not in the whitelist
    graph, labels = spark.read.parquet(f"{out}/graph"), spark.read.parquet(f"{out}/labels")
    assert {r[0] for r in graph.select("edge_type").distinct().collect()} == {"interacts_with", "physical_association", "drug_drug_similarity"}
    assert graph.where("score < 0 or score > 1").count() == 0
    per = {(r.fold, r.split, r.label): r.n for r in labels.groupBy("fold", "split", "label").agg(F.count("*").alias("n")).collect()}
    assert sum(n for (f, s, y), n in per.items() if s == "test" and y == 1) == 24
    assert all(per[f, "test", 1] == per.get((f, "test", 0), 0) for f in (1, 2, 3))
    test_pairs = labels.where("split = 'test' and label = 1").select("fold", "source", "target")
    assert graph.join(test_pairs, ["fold", "source", "target"]).count() == 0  # strict: no test edge is in its fold's graph
    with pytest.raises(ValueError):
        pipeline.Config(flags={"no_such_edge": True}).check(set())


def test_nothing_valid(spark, make_edges, tmp_path):
    raw = make_edges([("1", "P1")])
    props = spark.createDataFrame([], "structure string, MW double, LogP double, HBD double, HBA double, QED double, SA_Score double, is_pains boolean")
    pipeline.run(raw, str(tmp_path / "o"), properties=props, whitelist=spark.createDataFrame([], "entity_id string"))
    assert spark.read.parquet(str(tmp_path / "o/nodes")).count() == 0
