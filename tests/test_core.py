"""Contracts of the engine's own operators on small frames."""

import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from graphloom.functions import ids, text
from graphloom.operators import edges as E
from graphloom.operators import entities as N
from graphloom.operators import filters as P
from graphloom.operators import graph as G
from graphloom.operators import labels as L
from graphloom.operators import ranking, reports
from graphloom.operators import sampling as S
from graphloom.operators import selectors as Q
from graphloom.operators import similarity as V
from graphloom.operators import splits as X

EDGES = "ord bigint, source_id string, source_type string, target_id string, target_type string, relation_type string, label int, source_dataset string, raw_score double"


def edges(spark, rows):
    """(source, source type, target, target type, relation[, dataset[, score]])"""
    full = [(i, r[0], r[1], r[2], r[3], r[4], 1, r[5] if len(r) > 5 else "x", r[6] if len(r) > 6 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EDGES)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, key",
    [("63,744,051,462", "63744051462"), ("63742708689.0", "63742708689"), (" w374-b57 ", "W374B57"), ("(63742.0)", "63742"), ("W374.J50V", "W374J50V"), ("", None), (" \t", None), (None, None), ("​637 ", "637"), ("W374RVH.0", "W374RVH0")],
)
def test_entity_key(spark, value, key):
    assert one(spark, value, ids.entity_key) == key


@pytest.mark.parametrize("value, plain", [("123.0", "123"), (" 7 ", "7"), ("P01", "P01"), ("1.5", "1.5"), ("", None), (None, None), ("007", "007")])
def test_plain_id(spark, value, plain):
    assert one(spark, value, text.plain_id) == plain


def test_positive_id(spark):
    values = ["123", "456", "789.0", "abc", "-10", "0", None, " "]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert {r[0] for r in df.select(text.positive_id(F.col("x"))).collect()} == {123, 456, 789, None}


def test_kinetic_and_clean_names(spark):
    df = spark.createDataFrame([("ki_value", "0.5 {ATP (salt); weak}"), ("inhibitor", " ? "), ("inhibitor", "Caffeine"), ("turnover_number", "3 {x}"), ("ki_value", None)], "f string, v string")
    got = df.select(text.kinetic_name(F.col("f"), F.col("v")).alias("n"), text.kinetic_number(F.col("v")).alias("x")).collect()
    assert [(r.n, r.x) for r in got] == [("ATP (salt); weak", 0.5), (None, None), ("Caffeine", None), (None, 3.0), (None, None)]
    assert one(spark, "ATP (salt); weak", text.clean_name) == "atp"
    assert one(spark, None, text.clean_name) == ""


def test_sequences_and_fasta(spark):
    assert one(spark, " mkv\n", text.valid_sequence) is True
    assert one(spark, "MKB", text.valid_sequence) is False
    assert one(spark, "  ", text.valid_sequence) is True
    assert one(spark, "", text.valid_sequence) is False
    assert one(spark, None, text.valid_sequence) is False
    got = one(spark, ">sp|P12345|NAME x\nMK\nVL\n>Q1 y\nAA\n", text.fasta_records)
    assert [(r.accession, r.sequence) for r in got] == [("P12345", "MKVL"), ("Q1", "AA")]


def test_canonical_direction(spark):
    got = E.canonical(edges(spark, [("P02", "protein", "101", "drug", "a"), ("P03", "protein", "P01", "protein", "a"), ("102", "drug", "P01", "protein", "a"), (None, "drug", "P01", "protein", "a")]))
    assert rows(got, "source_id", "target_id") == sorted([("101", "P02"), ("P01", "P03"), ("102", "P01"), (None, "P01")], key=repr)


def test_merge_keeps_sources_and_first_values(spark):
    df = edges(spark, [("1", "drug", "P1", "protein", "a", "gtopdb", None), ("1", "drug", "P1", "protein", "a", "bindingdb", 10.0), ("P1", "protein", "1", "drug", "a", "bindingdb|gtopdb", 20.0), (None, "drug", "P1", "protein", "a")])
    store = E.store(df)
    assert rows(store, "source_id", "target_id", "source_dataset", "raw_score") == [("1", "P1", "bindingdb|gtopdb", 10.0)]
    assert rows(E.store(store, store), "source_dataset") == [("bindingdb|gtopdb",)]
    assert E.store(df.limit(0)).count() == 0


def test_pure_difference_touching(spark):
    df = edges(spark, [("1", "drug", "2", "drug", "a"), ("99", "drug", "1", "drug", "b"), ("1", "drug", "2", "drug", "a")])
    valid = spark.createDataFrame([("1",), ("2",), (None,), ("1",)], "entity_id string")
    assert E.pure(df, valid).count() == 2
    assert rows(E.difference(df, edges(spark, [("99", "drug", "1", "drug", "b", "other", 3.0)])), "source_id") == [("1",), ("1",)]
    assert E.touching(df, spark.createDataFrame([("99",)], "entity_id string")).count() == 1
    assert E.touching(df, spark.createDataFrame([("99",)], "entity_id string"), keep=False).count() == 2


def test_logic_edges(spark):
    ids_ = spark.createDataFrame([("1", 0), ("P1", 1)], "entity_id string, global_id bigint")
    df = edges(spark, [("1", "drug", "P1", "protein", "a", "x", 10.0), ("1", "drug", "P1", "protein", "b")])
    assert rows(E.with_logic_ids(df, ids_), "source", "target", "score") == [(0, 1, 1.0), (0, 1, 10.0)]
    bad = edges(spark, [("1", "drug", "P9", "protein", "a")])
    assert E.with_logic_ids(bad, ids_, strict=False).count() == 0
    with pytest.raises(Exception, match="no id for entity"):
        E.with_logic_ids(bad, ids_).collect()


def test_entities(spark):
    df = edges(spark, [("101", "drug", "P01", "protein", "a", "bindingdb"), ("101", "ligand", "P02", "protein", "a", "brenda"), ("102", "ligand", "P01", "mystery", "a", "brenda")])
    m = N.manifest(df)
    got = {r.entity_id: (r.entity_type, r.all_types, r.all_sources) for r in m.collect()}
    assert got["101"] == ("drug", ["drug", "ligand"], ["bindingdb", "brenda"])
    assert got["P01"][0] == "protein"
    ids_ = {r.entity_id: r.global_id for r in N.logic_ids(m).collect()}
    assert ids_["101"] == 0 and sorted(ids_.values()) == [0, 1, 2, 3]
    assert N.offsets(m) == {"drug": (0, 1), "ligand": (1, 1), "protein": (2, 2)}
    mixed = spark.createDataFrame([("P01", "protein"), ("102", "protein")], "entity_id string, entity_type string")
    with pytest.raises(ValueError):
        N.logic_ids(mixed, strict=True)
    filled = N.enrich(m, spark.createDataFrame([("101", "CC"), ("101", None)], "entity_id string, structure string"))
    assert filled.where("structure is not null").count() == 1


META = [("101", "drug", ["bindingdb"]), ("102", "drug", ["gtopdb"]), ("201", "ligand", ["brenda"]), ("P01", "protein", ["bindingdb", "stringdb"]), ("P02", "protein", ["brenda"])]


def test_selectors(spark):
    meta = spark.createDataFrame(META, "entity_id string, entity_type string, all_sources array<string>")
    df = edges(spark, [("101", "drug", "P01", "protein", "interacts_with"), ("102", "drug", "P02", "protein", "interacts_with"), ("201", "ligand", "P02", "protein", "inhibits"), ("P01", "protein", "P02", "protein", "ppi"), ("999", "unknown", "101", "drug", "unknown")])
    run = lambda **k: [r[0] + 1 for r in rows(Q.select_edges(df, meta, Q.InteractionSelector(**k)), "ord")]
    assert run() == [1, 2, 3, 4, 5]
    assert run(relation_types=("interacts_with", "inhibits")) == [1, 2, 3]
    assert run(source=Q.EntitySelector(entity_types=("drug",))) == [1, 2, 5]
    assert run(source=Q.EntitySelector(from_sources=("brenda",)), target=Q.EntitySelector(meta_types=("protein",))) == [3, 4]
    assert run(source=Q.EntitySelector(meta_types=("protein",))) == [1, 2, 3, 4]
    assert Q.select_edges(df, meta, None).count() == 5
    assert Q.select_entities(meta, Q.EntitySelector()).count() == 5
    assert Q.select_entities(meta, Q.EntitySelector(meta_types=("disease",))).count() == 0


def test_affinities_and_thresholds(spark):
    df = spark.createDataFrame([(">5", None, "1"), (None, "x", "<2.5"), (None, None, None), ("NaN", None, None)], "ki string, kd string, ic50 string")
    scored = P.affinities(df)
    assert rows(P.at_most(scored, 5), "raw_score") == [(2.5,), (5.0,)]
    e = edges(spark, [("1", "drug", "P", "protein", "inhibits", "x", 5.0), ("1", "drug", "P", "protein", "inhibits", "x", None), ("1", "drug", "P", "protein", "km_value", "x", 9.0), ("1", "drug", "P", "protein", "other")])
    assert [r[0] for r in rows(P.by_relation(e, {"inhibits": 5, "km_value": 8}), "ord")] == [0, 3]


def test_relaxed_bounds(spark):
    props = [("101", 16.0, ["other"]), ("102", 560.0, ["other"]), ("103", 1100.0, ["bindingdb"]), ("104", 560.0, ["bindingdb", "other"]), ("105", 1100.0, ["brenda"])]
    df = spark.createDataFrame(props, "id string, MW double, all_sources array<string>").selectExpr("*", "1.0D LogP", "1.0D HBD", "1.0D HBA", "1.0D QED", "1.0D SA_Score", "id = '101' is_pains")
    rules = P.SourceRules(P.Bounds(mw_max=500), {"bindingdb": P.Bounds(mw_max=1200), "brenda": None})
    assert [r[0] for r in rows(P.dynamic_filter(df, rules).where("passes"), "id")] == ["101", "103", "104", "105"]
    strict = P.SourceRules(P.Bounds(mw_max=500, check_pains=True), {})
    assert P.dynamic_filter(df, strict).where("passes").count() == 0
    assert P.dynamic_filter(df, P.SourceRules(None, {})).where("passes").count() == 5
    assert df.where(P.static_filter(P.Bounds(mw_max=500))).count() == 1
    assert df.where(P.static_filter(None)).count() == 5


def test_validation(spark):
    m = spark.createDataFrame(
        [("5", "drug", ["x"], "CC"), ("abc", "drug", ["x"], "CC"), ("6", "drug", ["x"], "bad"), ("7", "drug", None, "CCC"), ("P1", "protein", ["x"], "MKV"), ("P2", "protein", ["x"], "MKV"), ("P1", "protein", ["x"], "M1"), ("D", "disease", ["x"], None), (None, None, None, None)],
        "entity_id string, entity_type string, all_sources array<string>, structure string",
    )
    props = spark.createDataFrame([("CC", 10.0), ("CCC", 900.0), ("bad", None)], "structure string, MW double").selectExpr("*", "1.0D LogP", "1.0D HBD", "1.0D HBA", "1.0D QED", "1.0D SA_Score", "false is_pains")
    white = spark.createDataFrame([("P1",), (None,)], "entity_id string")
    got = [r.reason for r in P.validated(m, props, P.SourceRules(P.Bounds(mw_max=100)), white).orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(map(str, got)) == sorted(["None", "id", "structure", "properties", "None", "whitelist", "sequence", "type", "type"])


def test_quotas_and_stratified(spark):
    strata = [S.Stratum("ligand", "source_type = 'ligand'", 1.0), S.Stratum("drug", "source_type = 'drug'", ratio_to="ligand", ratio=0.4), S.Stratum("ppi", "source_type = 'protein'", ratio_to="drug", ratio=1 / 3)]
    assert S.quotas(strata, {"ligand": 5, "drug": 10, "ppi": 3}) == {"ligand": 5, "drug": 2, "ppi": 3}  # the anchor `drug` is a ratio itself: its whole count holds
    assert S.quotas(strata, {"drug": 10}) == {"ligand": 0, "drug": 0, "ppi": 0}
    with pytest.raises(ValueError):
        S.quotas([S.Stratum("a", "true", ratio_to="nowhere")], {})
    rows_ = [(f"d{i}", "drug", "P", "protein", "a") for i in range(10)] + [(f"l{i}", "ligand", "P", "protein", "a") for i in range(5)] + [(f"p{i}", "protein", "P", "protein", "a") for i in range(3)] + [("g", None, "P", "protein", "a")]
    df = edges(spark, rows_)
    first = S.stratified(df, strata, 1)
    assert {r[0]: r[1] for r in first.groupBy("source_type").count().collect()} == {"drug": 2, "ligand": 5, "protein": 3, None: 1}
    assert rows(first) == rows(S.stratified(df.repartition(7), strata, 1))
    assert S.uniform(df, 0.5, 3).count() == math.ceil(19 * 0.5)
    assert S.uniform(df.limit(0), 0.5, 3).count() == 0
    with pytest.raises(ValueError):
        S.exact(df, 20, 1)


def test_ranks_are_dense_with_a_hot_stratum(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("hot"))).withColumn("h", ranking.hash_order(1, "x", F.col("id")))
    got = ranking.hash_rank(df, "h", ("g",)).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in got) and len(got) == 2
    assert [r.rank for r in ranking.sorted_rank(spark.range(300).select((-F.col("id")).alias("x")), F.col("x")).orderBy("x").collect()] == list(range(300))


def _split_data(spark):
    df = edges(spark, [("d1", "drug", "p1", "protein", "interacts_with", "db1"), ("d2", "drug", "p1", "protein", "interacts_with", "db1"), ("d3", "drug", "p2", "protein", "interacts_with", "db2"), ("p1", "protein", "p2", "protein", "ppi", "stringdb"), ("d4", "drug", "p2", "protein", "interacts_with", "stringdb")])
    meta = spark.createDataFrame([("d1", "drug", ["db1"]), ("d2", "drug", ["db1"]), ("p1", "protein", ["db1"]), ("d3", "drug", ["db2"]), ("d4", "drug", ["db2"]), ("p2", "protein", ["db2"]), ("p3", "protein", ["db1", "db2"])], "entity_id string, entity_type string, all_sources array<string>")
    return df, meta


def test_warm_split(spark):
    df, meta = _split_data(spark)
    scope = Q.InteractionSelector()
    (fold,) = X.folds(df, meta, X.SplitConfig(mode="warm", k_folds=1, test_fraction=0.5, evaluation_scope=scope))
    assert (fold.train_labels.count(), fold.test.count(), fold.train_graph.count(), fold.cold_ids.count()) == (2, 3, 2, 0)


@pytest.mark.parametrize("strictness", ["strict", "informed", "other"])
def test_cold_folds_do_not_leak(spark, strictness):
    df, meta = _split_data(spark)
    seen = []
    for fold in X.folds(df, meta, X.SplitConfig(k_folds=2, strictness=strictness, primary_dataset="db1")):
        cold = {r[0] for r in fold.cold_ids.collect()}
        seen += cold
        graph = {(r[0], r[1]) for r in fold.train_graph.select("source_id", "target_id").collect()}
        assert all(cold & {r[0], r[1]} for r in fold.test.select("source_id", "target_id").collect())
        if strictness == "strict":
            assert not any(cold & {a, b} for a, b in graph)
        if strictness == "other":
            assert not graph
    assert sorted(seen) == ["d1", "d2"]


def test_cold_split_without_a_pool(spark):
    df, meta = _split_data(spark)
    got = list(X.folds(df, meta, X.SplitConfig(k_folds=1, primary_dataset="nowhere")))
    assert len(got) == 1 and got[0].test.count() == 0 and got[0].train_graph.count() == 5


def test_fold_sizes(spark):
    ids_ = spark.createDataFrame([(str(i),) for i in range(11)], "entity_id string")
    assert sorted(r["count"] for r in X.cold_folds(ids_, 4, 1).groupBy("fold").count().collect()) == [2, 3, 3, 3]
    e = edges(spark, [(str(i), "drug", t, "protein", "a") for t, n in (("hot", 20), ("cool", 6)) for i in range(n)])
    per = X.warm_folds(e, 5, 1).groupBy("target_id", "fold").count().collect()
    assert all(r["count"] == 4 for r in per if r["target_id"] == "hot") and all(r["count"] in (1, 2) for r in per if r["target_id"] == "cool")


def test_labels(spark):
    ids_ = spark.createDataFrame([("d1", 0), ("d2", 1), ("d3", 2), ("p1", 10), ("p2", 11), ("p3", 12)], "entity_id string, global_id bigint")
    pairs = spark.createDataFrame([("d1", "p1"), ("d2", "p2")], "source_id string, target_id string")
    assert rows(L.train_labels(pairs.where("source_id = 'd1'"), ids_)) == [(0, 10)]
    s, t = (ids_.where(F.col("entity_id").startswith(x)) for x in "dp")
    got = L.labelled(pairs.where("source_id = 'd2'"), s, t, pairs, ids_, 1)
    assert rows(got.where("label = 1"), "source", "target") == [(1, 11)]
    (neg,) = got.where("label = 0").collect()
    assert neg.source in (0, 1, 2) and neg.target in (10, 11, 12) and (neg.source, neg.target) not in ((0, 10), (1, 11))
    assert L.labelled(pairs.limit(0), s, t, pairs, ids_, 1).columns == ["source", "target", "label"]
    full = spark.createDataFrame([("d1", "p1")], "source_id string, target_id string")
    assert L.negatives(full, s.where("entity_id = 'd1'"), t.where("entity_id = 'p1'"), full, 1).count() == 0  # no pair is free
    assert L.negatives(full, s.limit(0), t, full, 1).count() == 0


def test_similarity_formula_and_order(spark):
    v = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate((0.0, 0.1, 0.2, 1.5))] + [(8, None), (9, [0.0, 0.0])], "global_id bigint, features array<double>")
    top = {(r.i, r.j): r.cos for r in V.top_k(v, 1).collect()}
    assert set(top) == {(0, 1), (1, 0), (2, 1), (3, 2)}
    assert V.top_k(v, 4).count() == 0  # no more vectors than k
    types = spark.createDataFrame([(i, "drug") for i in range(4)], "id bigint, type string")
    got = V.candidates(v, types, k=1)
    assert rows(got, "source", "target") == [(0, 1)]
    assert abs(got.first().similarity - (1 - 2 * (1 - math.cos(0.1)) ** 2)) < 1e-6
    assert rows(V.candidates(v, types, k=1, symmetric=True), "source", "target") == [(0, 1), (1, 2), (2, 3)]
    assert V.similarity_edges(got, flags={"drug_drug_similarity": False}).count() == 0
    assert V.similarity_edges(got).count() == 1


def test_neighbours_of_many_blocks_equal_brute_force_without_a_shuffle_of_copies(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(2)
    m = rng.standard_normal((150, 12)).astype(np.float32)
    m[100:140] = m[:40] + rng.standard_normal((40, 12)).astype(np.float32) * 0.3
    m[140:] = m[0]  # ties
    v = spark.createDataFrame([(i, "a" if i % 3 else "b", [float(z) for z in x]) for i, x in enumerate(m)], "global_id bigint, kind string, features array<float>")
    x = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for i in range(150):
        others = sorted((-round(float(x[i] @ x[j]), 10), j) for j in range(150) if j != i and (j % 3 == 0) == (i % 3 == 0))[:4]
        want |= {(i, j, round(-c, 6)) for c, j in others}
    got = V.top_k(v, 4, class_col="kind")
    assert {(r.i, r.j, round(r.cos, 6)) for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    near = V.top_k(v, 4, class_col="kind", least=0.8).collect()
    assert {(r.i, r.j, round(r.cos, 6)) for r in near} == {w for w in want if w[2] >= 0.8} and len(near) < len(want)


def test_only_pairs_with_two_vectors_meet_the_vectors_and_these_stay_floats(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])], "id string, features array<float>")
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("a", "x", 3), ("x", "b", 4), ("a", "c", 5)], "source string, target string, n int")
    out = V.pair_cosine(pairs, v, "id")
    assert rows(out.select("n", F.round("cos", 6).alias("cos"))) == [(1, 0.707107), (2, 0.707107)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "as array<double>) AS" not in plan[plan.index("Join") :]


def test_minmax_flags_and_leaks(spark):
    g = spark.createDataFrame([(0, 1, "a", 10.0), (0, 2, "a", 100.0), (1, 2, "b", 0.6), (2, 3, None, None)], "source bigint, target bigint, edge_type string, score double")
    assert rows(G.minmax(g), "edge_type", "score") == sorted([("a", 0.0), ("a", 1.0), ("b", 1.0), (None, 1.0)], key=repr)
    assert G.enabled(g, {"a": True, "b": False}, "edge_type").count() == 2
    cold = spark.createDataFrame([(2,)], "id bigint")
    assert rows(G.without_leaks(g, cold, ("a",)), "source", "target") == [(0, 1), (0, 2)]
    assert G.without_leaks(g, None, ("a",)).count() == 4


def test_local_ids(spark):
    nodes = spark.createDataFrame([(10, False), (1, True), (3, True), (12, None), (8, True), (9, True)], "global_id bigint, is_molecule boolean")
    ids_ = G.local_ids(nodes)
    assert rows(ids_, "global_id", "local_id") == sorted([(1, 0), (3, 1), (8, 2), (9, 3), (10, 4), (12, 5)], key=repr)
    e = spark.createDataFrame([(1, 10), (1, 99)], "source bigint, target bigint")
    local = G.to_local(e, ids_)
    assert rows(local) == [(0, 4)] and rows(G.to_global(local, ids_)) == [(1, 10)]


def test_components_and_degrees(spark):
    e = edges(spark, [(str(i), "drug", str(i + 1), "drug", "a") for i in range(40)] + [("x", "drug", "x", "drug", "a"), ("y", "drug", "z", "drug", "a"), ("z", "drug", "y", "drug", "a"), (None, "drug", "y", "drug", "a")])
    got = {r.node: r.component for r in G.connected_components(e).collect()}
    assert len(set(got.values())) == 3 and got["39"] == "0" and got["z"] == "y"
    assert {r.node: r.degree for r in reports.degrees(e).collect()}["y"] == 1
    assert G.connected_components(e.limit(0)).count() == 0


def test_reports(spark):
    e = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "a"), ("f2", None)], "fold string, relation_type string")
    counts = reports.edge_type_counts(e, ["a", "b"])
    assert rows(counts) == [("f1", 1, 1, 2), ("f2", 1, 0, 2)]
    assert rows(reports.mean_std(counts, ["n_b"]))[0] == ("n_b", 0.5, 0.71)
    assert rows(reports.value_counts(e, "relation_type")) == sorted([("a", 2), ("b", 1), (None, 1)], key=repr)
    assert rows(reports.status_report(e, F.col("fold"))) == [("f1", 2, 50.0), ("f2", 2, 50.0)]
    f = spark.createDataFrame([("m", [1.0]), ("m", [float("nan")]), ("p", None)], "node_type string, features array<double>")
    g = spark.createDataFrame([(0, 5, "a")], "source bigint, target bigint, edge_type string")
    assert rows(reports.graph_health(g, 3, f)) == [("edges a", 1), ("features m", 1), ("features p", 1)]
