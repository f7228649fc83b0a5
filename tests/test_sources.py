"""Readers and sinks on small files."""

import gzip
import json

from graphloom.sources import adapters as A
from graphloom.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bindings(spark, tmp_path):
    c = A.BINDINGS.names
    head = [c[k] for k in ("structure", "molecule", "organism", "ki", "ic50", "kd", "protein", "sequence")]
    data = [["CC#N", "101", "Homo sapiens", ">5", "", "", "P1", "MK"], ["C", "101.0", "Homo sapiens", "", "70000", "", "P1", "MK"], ["C", "102", "Mus musculus", "1", "", "", "P1", "MK"], ["C", "", "Homo sapiens", "1", "", "", "P1", "MK"], ["C", "103", "Homo sapiens", "", "7", "8", "P2", "MK"]]
    (tmp_path / "b.tsv").write_text("\n".join("\t".join(r) for r in [head, *data]) + "\n")
    got = A.bindings(spark, str(tmp_path / "b.tsv"))
    assert rows(got.select("source_id", "target_id", "raw_score", "source_dataset")) == [("101", "P1", 5.0, "bindingdb"), ("103", "P2", 8.0, "bindingdb")]


def test_pharmacology(spark, tmp_path):
    (tmp_path / "i.csv").write_text('# version 1\nEndogenous,Target UniProt ID,Ligand ID,Original Affinity Median nm\ntrue,P1|P2,7,5\nfalse,P3,8,20000\nfalse,P3,7,30\n,P4,9,1\n')
    (tmp_path / "l.csv").write_text('# version 1\nLigand ID,SMILES,PubChem CID\n7,CC#N,700\n8,C,800\n9,C,\n')
    got = A.pharmacology(spark, str(tmp_path / "i.csv"), str(tmp_path / "l.csv"))
    assert rows(got.select("source_id", "source_type", "target_id")) == [("700", "endogenous_ligand", "P1"), ("700", "exogenous_ligand", "P3")]


def test_enzymes(spark, tmp_path):
    entry = {"protein": {"1": {"organism": "Homo sapiens", "accessions": ["P1", "P2"], "source": "x"}, "2": {"organism": "Mus musculus", "accessions": ["P9"]}}, "inhibitor": [{"value": "Aspirin (pure); weak", "proteins": ["1", "2", "7"], "comment": ""}, {"value": "?", "proteins": ["1"]}], "ki_value": [{"value": "0.5 {caffeine}", "proteins": ["1"]}, {"value": "9 {caffeine}", "proteins": ["1"]}]}
    (tmp_path / "e.json").write_text(json.dumps({"data": {"1.1.1.1": entry, "2.7.1.1": {}}}))
    names = spark.createDataFrame([("aspirin", 201), ("caffeine", 202)], "name string, cid bigint")
    got = A.enzymes(spark, str(tmp_path / "e.json"), names, {"ki_value": 1.0})
    assert rows(got.select("source_id", "target_id", "relation_type", "raw_score")) == [("201", "P1", "inhibitor", None), ("201", "P2", "inhibitor", None), ("202", "P1", "ki_value", 0.5), ("202", "P2", "ki_value", 0.5)]


def test_links_and_whitelist(spark, tmp_path):
    with gzip.open(tmp_path / "l.gz", "wt") as f:
        f.write("protein1 protein2 combined_score\n9606.A 9606.B 700\n9606.A 9606.C 900\n")
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("#string_protein_id\talias\tsource\n9606.A\tP2\tEnsembl_UniProt_AC\n9606.A\tP1\tEnsembl_UniProt_AC\n9606.B\tP5\tUniProt_AC\n9606.C\tX\tother\n")
    got = A.links(spark, str(tmp_path / "l.gz"), str(tmp_path / "a.gz"))
    assert rows(got.select("source_id", "target_id", "raw_score")) == [("P2", "P5", 700.0)]  # the first alias by line
    with gzip.open(tmp_path / "t.gz", "wt") as f:
        f.write("protein1\tprotein2\tcombined_score\n9606.A\t9606.B\t700\n9606.A\t9606.B\t800\n")
    got = A.SOURCES.read(spark, {"stringdb": {"links": str(tmp_path / "t.gz"), "aliases": str(tmp_path / "a.gz")}})
    assert rows(got.select("source_id", "target_id", "raw_score")) == [("P2", "P5", 700.0)]
    (tmp_path / "w.tsv").write_text("Entry\tReviewed\tOrganism (ID)\nP05067\treviewed\t9606\nQ1\tunreviewed\t9606\nQ2\treviewed\t10090\n")
    assert rows(A.whitelist(spark, str(tmp_path / "w.tsv"))) == [("P05067",)]
    with gzip.open(tmp_path / "s.gz", "wt") as f:
        f.write("5\tATP\n3\tatp\nbroken\n7\t\n")
    assert rows(A.synonym_dictionary(spark, str(tmp_path / "s.gz"))) == [("atp", 5)]


def test_registry_and_cache(spark, tmp_path):
    assert A.SOURCES.read(spark, {}).count() == 0
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing.selectExpr("entity_id", "upper(entity_id) as structure")

    ask = lambda *x: spark.createDataFrame([(i,) for i in x], "entity_id string")
    path = str(tmp_path / "cache")
    assert rows(sinks.cached(ask("a", "b", None, "a"), path, compute)) == [("a", "A"), ("b", "B")]
    assert rows(sinks.cached(ask("b", "c"), path, compute)) == [("b", "B"), ("c", "C")]
    assert rows(sinks.cached(ask("c"), path, compute)) == [("c", "C")]
    assert calls == [2, 1]
    nodes = spark.createDataFrame([(1, "x"), (0, "y")], "global_id bigint, node_type string")
    sinks.write_nodes(nodes, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2


def test_stream(spark, tmp_path):
    from graphloom.streaming.edges import append_entities, canonical_stream

    src = tmp_path / "in"
    schema = "source_id string, source_type string, target_id string, target_type string, relation_type string, raw_score double, loaded_at timestamp"
    spark.createDataFrame([("P1", "protein", "1.0", "drug", "a", 1.0, None), ("1", "drug", "P1", "protein", "a", 2.0, None)], schema).selectExpr("* except(loaded_at)", "timestamp'2024-01-01' as loaded_at").write.parquet(str(src))
    q = canonical_stream(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("edges_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("edges_out").select("source_id", "target_id")) == [("1", "P1")]
    write = append_entities(str(tmp_path / "ids"))
    batch = spark.createDataFrame([("1", "P1")], "source_id string, target_id string")
    write(batch, 0)
    write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "ids")).count() == 2


def test_the_first_row_of_a_key_is_kept_and_a_null_score_comes_last(spark, tmp_path):
    c = A.BINDINGS.names
    head = [c[k] for k in ("structure", "molecule", "organism", "ki", "ic50", "kd", "protein", "sequence")]
    data = [["C", "1", "Homo sapiens", x, "", "", "P1", ""] for x in ("9", "5")]
    (tmp_path / "b.tsv").write_text("\n".join("\t".join(r) for r in [head, *data, ["too", "short"]]) + "\n\n")
    assert [r.raw_score for r in A.bindings(spark, str(tmp_path / "b.tsv")).collect()] == [9.0]
    assert [(r.lines, r.bad) for r in A.rejected(spark, str(tmp_path / "b.tsv")).collect()] == [(3, 1)]
    plain = spark.createDataFrame([("1", "P1", "a", None), ("1", "P1", "a", 3.0)], "source_id string, target_id string, relation_type string, raw_score double")
    assert [r.raw_score for r in A.finished(plain, "x").collect()] == [3.0]


def test_bounds_of_a_source(spark, tmp_path):
    from graphloom.operators.filters import Bounds

    c = A.BINDINGS.names
    head = [c[k] for k in ("structure", "molecule", "organism", "ki", "ic50", "kd", "protein", "sequence")]
    data = [[x, str(i), "Homo sapiens", "1", "", "", "P1", ""] for i, x in enumerate(("C", "CC", "CCC"))]
    (tmp_path / "b.tsv").write_text("\n".join("\t".join(r) for r in [head, *data]) + "\n")
    props = spark.createDataFrame([("C", 10.0, 1.0), ("CC", 500.0, 1.0)], "structure string, MW double, LogP double")
    for i, n in enumerate(("HBD", "HBA", "QED", "SA_Score")):
        props = props.selectExpr("*", f"1.0D as {n}")
    read = lambda **s: A.SOURCES.read(spark, {"bindingdb": {"path": str(tmp_path / "b.tsv"), **s}}, cache=str(tmp_path / "cache"))
    assert rows(read(properties=props, bounds=Bounds(mw_max=100)).select("source_id")) == [("0",)]
    assert read().count() == 3
    (tmp_path / "b.tsv").write_text("\t".join(head) + "\n")
    assert read().count() == 3  # from the cache
    assert A.SOURCES.cached(spark, "bindingdb", {"path": str(tmp_path / "b.tsv")}, str(tmp_path / "cache"), force=True).count() == 0


def test_entries_of_a_document_are_read_as_a_stream():
    import io

    entry = {"a": ["}{", 'q"', 1.5e3], "b": {"c": None}}
    doc = {"release": [1, {"data": 2}], "data": {f"1.{i}": entry for i in range(50)}, "end": "x"}
    for text in (json.dumps(doc), json.dumps(doc, indent=3)):
        got = list(A.top_entries(io.StringIO(text), step=7))
        assert [k for k, _ in got] == list(doc["data"]) and all(json.loads(v) == entry for _, v in got)
    assert list(A.top_entries(io.StringIO('{"data": {}}'))) == [] == list(A.top_entries(io.StringIO("{}")))


def test_features_with_metadata(spark, tmp_path):
    import pytest

    path = str(tmp_path / "f")
    sinks.write_features(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "global_id bigint, features array<double>"), path, "m1")
    assert sinks.load_features(spark, path, "m1", 2, 2).count() == 2
    for wrong in ({"model": "m2"}, {"rows": 3}, {"dim": 5}):
        with pytest.raises(ValueError):
            sinks.load_features(spark, path, **wrong)
    with pytest.raises(ValueError):
        sinks.load_features(spark, str(tmp_path / "none"))
