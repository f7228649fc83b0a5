"""Unit conversion and shredding of nested records."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import enzymes, shred, units

VALUES = [
    ("12.2", None, 12.2), ("83,600", None, 83600.0), ("25,000,000", None, 2.5e7), ("0,5", None, 0.5), ("~1.99E+05", None, 199000.0), ("0.166 mmol/L", "mM", 0.166), ("> 3.87", None, 3.87), ("0.000000238 millimolar", "mM", 2.38e-7),
    ("4.1 x 10^-7 M", "M", 4.1e-7), ("1.12x10^-5 M", "M", 1.12e-5), ("pKi 7.2", "-log M", 7.2), ("pIC50=5.44", "-log M", 5.44), ("0.3 ± 0.8 umol/L", "uM", 0.3), ("5 (nM)", "nM", 5.0), ("9 μM", "uM", 9.0), ("9um", "uM", 9.0),
    ("0.002 μmol L-1", "uM", 0.002), ("1.1 mol l-1", "M", 1.1), ("87 picomolar", "pM", 87.0), (">", None, None), ("NA", None, None), ("n.d.", None, None), ("", None, None), (None, None, None), ("pIC50", "-log M", None), ("x" * 10000, None, None),
]


def test_values(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VALUES)], "i int, x string")
    for r in df.select("i", units.value_unit(F.col("x")).alias("u"), units.value_number(F.col("x")).alias("n")).collect():
        text, unit, number = VALUES[r.i]
        assert (r.u == unit) and (r.n is None if number is None else math.isclose(r.n, number, rel_tol=1e-12)), text


NOTES = [
    ("values are micromolar (stock 10 mM in DMSO)", "uM", None), ("enzyme at 2 nM in the well", None, None), ("Ki column in -log10 M, rest as usual", "-log M", "ki"), ("IC50 is in µM", "uM", "ic50"), ("Kd only: nanomolar values", "nM", "kd"),
    ("Unit of record: M", "M", None), ("buffer 25 mM HEPES pH 7.4; Unit of record: mmol/L", "mM", None), ("all constants given as µmol per litre", "uM", None), ("values are negative decadic logarithms of the molar constant", "-log M", None),
    ("assay volume 9 uL, 3 replicates", None, None), ("n=4", None, None), ("molar, not scaled", "M", None), ("pX (-log10 M)", "-log M", None), ("incubation 9 min at 9 C", None, None), ("", None, None), (None, None, None),
]


def test_notes(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NOTES)], "i int, x string")
    for r in df.select("i", units.note_unit(F.col("x")).alias("u"), units.note_field(F.col("x")).alias("f")).collect():
        assert (r.u, r.f) == NOTES[r.i][1:], NOTES[r.i][0]


def test_which_unit_holds(spark):
    b = spark.createDataFrame(
        [(1, "D1", "Ki only: values are micromolar", "5", "5 nM", "5"), (2, "D1", None, "7", None, ">"), (3, None, None, "7", None, None), (4, "D9", "values are molar", "pKi 7", "1", None)],
        "entry_id bigint, depositor_id string, curator_note string, ki string, kd string, ic50 string",
    ).withColumn("who", F.lit("clash")).withColumn("unit_name", F.lit("clash"))
    d = spark.createDataFrame([("D1", "picomolar values"), (None, "molar"), ("D2", None)], "depositor_id string, practice_note string")
    e = spark.createDataFrame(
        [(1, 5.0, " BRENDA", None), (2, 5.0, "brenda", "score in uM"), (3, 700.0, "StringDB", None), (4, 5.0, None, None), (5, None, "brenda", None), (6, 6.0, "labfeed|other", None), (7, float("nan"), "brenda", None)],
        "interaction_id bigint, raw_score double, source_dataset string, score_note string",
    )
    n = spark.createDataFrame([("brenda", "as printed, that is mmol per litre"), ("stringdb", "Confidence. No concentration."), ("labfeed", "pX"), (None, "molar")], "source_dataset string, unit_note string")
    got = sorted(tuple(r)[1:] for r in units.found(b, d, e, n).collect())
    assert got == sorted([(1, "ki", "uM"), (1, "ic50", "pM"), (2, "ki", "pM"), (4, "ki", "-log M"), (4, "kd", "M"), (1, "raw_score", "mM"), (2, "raw_score", "uM"), (6, "raw_score", "-log M")])
    nm = {(r.record_id, r.field_name): r.converted for r in units.convert(units.quantities(b, d, e, n)).collect()}
    assert math.isclose(nm[1, "ki"], 5000) and math.isclose(nm[1, "ic50"], 0.005) and math.isclose(nm[4, "ki"], 100) and math.isclose(nm[1, "kd"], 5) and math.isclose(nm[6, "raw_score"], 1000)
    assert units.found(b.limit(0), d.limit(0), e.limit(0), n.limit(0)).count() == 0


def test_compositions_are_consistent():
    way = units.compositions()
    assert way["-log M", "nM"][:2] == (-1.0, 9.0) and way["pM", "M"][1] == -12
    with pytest.raises(ValueError, match="disagree"):
        units.compositions((*units.CONVERSIONS, units.Conversion("pM", "M", 1, -11)))


def test_conversion_of_zero_and_unknown(spark):
    df = spark.createDataFrame([(0.0, "mM"), (-1.0, "mM"), (1.0, "furlong"), (None, "mM"), (2.0, None)], "number double, unit_name string")
    assert sorted(((r.number, r.unit_name, r.converted) for r in units.convert(df).collect()), key=repr) == sorted([(0.0, "mM", 0.0), (-1.0, "mM", None), (1.0, "furlong", None), (None, "mM", None), (2.0, None, None)], key=repr)


def brenda(spark, texts):
    return spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t), "clash", "clash") for i, t in enumerate(texts)], "entry_id bigint, record_json string, ec string, record_id string")


def brute(texts):
    def many(v):
        return v if isinstance(v, list) else [] if v is None else [v]

    def names(p):
        return {x["id"] if isinstance(x, dict) else x for x in many(p.get("accessions"))} - {None, ""} if isinstance(p, dict) else set()

    out = set()
    for i, r in enumerate(texts):
        if not isinstance(r, dict):
            continue
        acc = {}
        for k, p in (r["protein"].items() if isinstance(r.get("protein"), dict) else ()):
            acc.setdefault(k, set()).update(names(p))
            for s in many(p.get("subunits")) if isinstance(p, dict) else ():
                acc.setdefault(s["key"], set()).update(names(s))
        for f, v in r.items():
            if f.split(":")[0] in ("inhibitor", "ki_value"):
                for n, item in enumerate(many(v)):
                    for ref in many(item.get("proteins")) if isinstance(item, dict) else ():
                        out |= {(i, f, n, str(ref), a) for a in acc.get(str(ref), ())}
    return out


ACCESSIONS = st.one_of(st.none(), st.sampled_from(["P1", "P2"]), st.lists(st.one_of(st.none(), st.sampled_from(["P1", "P2", "P3"]), st.fixed_dictionaries({"id": st.sampled_from(["P4", None]), "db": st.just("x")})), max_size=3))
PROTEIN = st.one_of(st.none(), st.just("text"), st.fixed_dictionaries({}, optional={"accessions": ACCESSIONS, "organism": st.sampled_from(["a", {"name": "b"}, None]), "subunits": st.lists(st.fixed_dictionaries({"key": st.sampled_from(["1a", "1b"]), "accessions": ACCESSIONS}), max_size=2)}))
REFS = st.one_of(st.none(), st.sampled_from(["1", 2, "1a"]), st.lists(st.sampled_from(["1", "2", 2, "1a", "9", None]), max_size=3))
ITEM = st.one_of(st.none(), st.just("text"), st.just(3), st.fixed_dictionaries({}, optional={"value": st.sampled_from(["v", None]), "proteins": REFS, "conditions": st.just({"assays": [{"temp_c": 1, "salts": [{}, {"salt": "K"}]}, {}]})}))
RECORD = st.fixed_dictionaries({}, optional={"ec": st.just("1.1"), "protein": st.one_of(st.none(), st.dictionaries(st.sampled_from(["1", "2"]), PROTEIN, max_size=2)), "inhibitor": st.one_of(st.none(), ITEM, st.lists(ITEM, max_size=4)), "ki_value:1": st.lists(ITEM, max_size=3)})


@settings(max_examples=8, deadline=None)
@given(st.lists(RECORD, min_size=1, max_size=25))
def test_links_equal_brute_force(spark, records):
    got = [tuple(r) for r in enzymes.found(brenda(spark, records)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(records)


def test_dirty_records_and_parent_links(spark):
    texts = [None, "", "{broken", "[1]", "3", '"x"', {}, {"inhibitor": [{"value": "a"}, None, {"conditions": {"ph": 7.0, "assays": [{"temp_c": 25, "salts": [{"salt": "KCl", "conc_mm": 1.5}, {"salt": "NaCl"}]}, {"salts": []}]}}]}, {"inhibitor": {"value": "y" * 100_000}}]
    store = enzymes.columns(brenda(spark, texts))
    salts = sorted((r.entry_id, r.field_no, r.item_no, r.assay_no, r.salt_no, r.field_name, r.salt, r.conc_mm) for r in enzymes.table_of(store, "salts").collect())
    assert salts == [(7, 0, 2, 0, 0, "inhibitor", "KCl", "1.5"), (7, 0, 2, 0, 1, "inhibitor", "NaCl", None)]
    assert [(r.item_no, r.assay_no, r.temp_c) for r in enzymes.table_of(store, "assays").orderBy("assay_no").collect()] == [(2, 0, "25"), (2, 1, None)]
    items = {(r.entry_id, r.item_no): r.value for r in enzymes.table_of(store, "items").collect()}
    assert items == {(7, 0): "a", (7, 1): None, (7, 2): None, (8, 0): "y" * 100_000}
    for name in shred.ENZYMES.tables:
        assert enzymes.table_of(enzymes.columns(brenda(spark, ["{}"]).limit(0)), name).count() == 0


def test_levels():
    work = shred.Shredder(shred.Group({"a": shred.Many(shred.Group({"b": shred.Many(shred.Leaf())}))}))
    for r in ({"a": [{"b": [1, 2]}, {}, {"b": 3}]}, {}, {"a": [{"b": [None]}]}):
        work.add(r)
    c = work.columns["a.b"]
    assert list(zip(c.rep, c.defn, c.value)) == [(0, 5, "1"), (2, 5, "2"), (1, 3, None), (1, 5, "3"), (0, 1, None), (0, 4, None)]


def test_records_that_give_no_rows_are_reported(spark):
    from graphloom.operators.shred import unreadable

    rows = [(1, '{"ec": "1"}'), (2, None), (3, "  "), (4, "{broken"), (5, "[1]"), (6, '"x"')]
    df = spark.createDataFrame(rows, "entry_id bigint, record_json string")
    assert sorted(map(tuple, unreadable(df, "entry_id", "record_json").collect())) == [(2, "missing"), (3, "missing"), (4, "malformed"), (5, "no object"), (6, "no object")]
