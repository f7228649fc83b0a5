"""Deeply nested JSON turned into flat tables that keep parent-child links, by columnar shredding.

Every leaf path becomes a column of (repetition level, definition level, value) triples: the repetition level tells which repeated
ancestor a value continues, the definition level how many of its optional or repeated ancestors are there. A table for any
repeated ancestor is then rebuilt from the level sequences of a few leaf columns alone, all records of a batch at once.
One record is never split, and no more is held at a time than a batch of records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import spread

#: Records shredded together.
BATCH = 512


@dataclass
class Leaf:
    """A text, number or boolean, kept as text; objects and lists in its place count as absent."""


@dataclass
class Group:
    """An object. A bare text or number in its place is taken as the field `scalar`, or, without one, as absent."""

    fields: dict[str, object]
    scalar: str | None = None


@dataclass
class Many:
    """A list; a single thing outside a list is a list of one, null or nothing a list of none."""

    child: object


@dataclass
class Entries:
    """An object with free keys (all, or those that match), as a list of groups with `key`; the value is the group itself, or its field `inner`.

    With `here`, the free keys are those of the enclosing object itself.
    """

    child: Group
    keys: str | None = None
    inner: str | None = None
    here: bool = False


@dataclass
class Column:
    path: str
    depth: int
    full: int
    rep: list[int] = field(default_factory=list)
    defn: list[int] = field(default_factory=list)
    value: list[str | None] = field(default_factory=list)


def text_of(value: object) -> str | None:
    """Numbers without a fraction are written as whole numbers."""
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return str(value)


class Shredder:
    """Writes records of one schema into columns."""

    def __init__(self, schema: Group):
        self.columns: dict[str, Column] = {}
        self.levels: dict[str, tuple[int, int]] = {}
        self._plan = self._compile(schema, "", 0, 0)

    def _compile(self, node, path: str, depth: int, d: int):
        if isinstance(node, Leaf):
            column = self.columns[path] = Column(path, depth, d + 1)
            return ("leaf", column)
        if isinstance(node, Group):
            inside = {name: self._compile(child, f"{path}.{name}" if path else name, depth, d + 1) for name, child in node.fields.items()}
            leaves = [c for plan in inside.values() for c in self._leaves(plan)]
            return ("group", inside, node.scalar, leaves)
        self.levels[path] = (depth + 1, d + 1)
        child = self._compile(node.child, path, depth + 1, d + 1)
        if isinstance(node, Many):
            return ("many", child, self._leaves(child))
        return ("entries", child, self._leaves(child), node.keys and re.compile(node.keys), node.inner, node.here)

    def _leaves(self, plan) -> list[Column]:
        return [plan[1]] if plan[0] == "leaf" else plan[3] if plan[0] == "group" else plan[2]

    def add(self, record: object) -> None:
        self._write(self._plan, record, 0, 0, 0)

    def _none(self, leaves: list[Column], rep: int, d: int) -> None:
        for c in leaves:
            c.rep.append(rep)
            c.defn.append(d)
            c.value.append(None)

    def _write(self, plan, value, rep: int, d: int, depth: int) -> None:
        kind = plan[0]
        if kind == "leaf":
            c, text = plan[1], text_of(value)
            c.rep.append(rep)
            c.defn.append(d if text is None else d + 1)
            c.value.append(text)
        elif kind == "group":
            if not isinstance(value, dict):
                if plan[2] is None or value is None or isinstance(value, list):
                    return self._none(plan[3], rep, d)
                value = {plan[2]: value}
            for name, child in plan[1].items():
                self._write(child, value if child[0] == "entries" and child[5] else value.get(name), rep, d + 1, depth)
        else:
            if kind == "many":
                items = value if isinstance(value, list) else [] if value is None else [value]
            elif isinstance(value, dict):
                keys, inner = plan[3], plan[4]
                items = [{"key": k} | ({inner: v} if inner else v if isinstance(v, dict) else {}) | {"key": k} for k, v in value.items() if keys is None or keys.fullmatch(k)]
            else:
                items = []
            if not items:
                return self._none(plan[2], rep, d)
            for i, item in enumerate(items):
                self._write(plan[1], item, rep if i == 0 else depth + 1, d + 1, depth + 1)


@dataclass(frozen=True)
class Table:
    """A table for one repeated ancestor: `numbers` names the place (from 0) of each enclosing element in its list, outermost first; `columns` gives each output column's leaf path."""

    ancestor: str
    numbers: tuple[str, ...]
    columns: dict[str, str]


@dataclass(frozen=True)
class NestedSource:
    schema: Group
    tables: dict[str, Table]


def _stored(path: str) -> str:
    """The name of a leaf path's column: dots would be read as nested fields."""
    return path.replace(".", "__")


def _shape(source: NestedSource) -> str:
    return ", ".join(f"{_stored(p)} struct<rep: array<int>, def: array<int>, value: array<string>>" for p in Shredder(source.schema).columns)


def shredded(records: DataFrame, source: NestedSource, id_col: str, json_col: str) -> DataFrame:
    """One row a record: its id and, of every leaf path, the level sequences and values.

    Null, blank or malformed JSON and records that are no object give sequences without values, so they yield no rows in any table.
    """
    id_type = dict(records.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                work = Shredder(source.schema)
                ends = {p: [0] for p in work.columns}
                for text in part.column(1).to_pylist():
                    try:
                        record = json.loads(text) if text else None
                    except (ValueError, RecursionError):
                        record = None
                    work.add(record)
                    for p, c in work.columns.items():
                        ends[p].append(len(c.rep))
                arrays = [part.column(0)]
                for p, c in work.columns.items():
                    offsets = pa.array(ends[p], pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((c.rep, pa.int32()), (c.defn, pa.int32()), (c.value, pa.string()))]
                    arrays.append(pa.StructArray.from_arrays(lists, ["rep", "def", "value"]))
                yield pa.RecordBatch.from_arrays(arrays, ["record_id", *map(_stored, work.columns)])

    return spread(records.select(id_col, json_col), id_col).mapInArrow(run, f"record_id {id_type}, {_shape(source)}")


def unreadable(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The id and `reason` of records that yield no rows in any table: `missing` (null or blank), `malformed`, or `no object`."""
    parsed = F.try_parse_json(json_col)
    missing = F.col(json_col).isNull() | (F.trim(json_col) == "")
    reason = F.when(missing, "missing").when(parsed.isNull(), "malformed").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object")
    return records.select(id_col, reason.alias("reason")).where("reason is not null")


def _places(rep: np.ndarray, level: int) -> np.ndarray:
    """The number of each position's element of a level within its parent."""
    run = np.cumsum(rep <= level) - 1
    return run - np.maximum.accumulate(np.where(rep <= level - 1, run, 0))


def rebuild(columns: DataFrame, source: NestedSource, name: str, id_name: str) -> DataFrame:
    """The rows of a table from the level sequences of the leaf columns it needs; no other column is read."""
    table = source.tables[name]
    shape = Shredder(source.schema)
    level, there = shape.levels[table.ancestor]
    own = next(p for p, c in shape.columns.items() if (p == table.ancestor or p.startswith(f"{table.ancestor}.")) and c.depth == level)
    paths = list(dict.fromkeys([own, *table.columns.values()]))
    depth = {p: shape.columns[p].depth for p in paths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = {p: batch.column(i + 1) for i, p in enumerate(paths)}
            rep = np.asarray(parts[own].field("rep").flatten())
            defn = np.asarray(parts[own].field("def").flatten())
            rows = np.flatnonzero(defn >= there)
            record = np.cumsum(rep == 0) - 1
            arrays = [batch.column(0).take(pa.array(record[rows]))]
            arrays += [pa.array(_places(rep, i + 1)[rows], pa.int64()) for i in range(level)]
            for p in table.columns.values():
                at = np.cumsum(rep <= depth[p]) - 1
                arrays.append(parts[p].field("value").flatten().take(pa.array(at[rows])))
            yield pa.RecordBatch.from_arrays(arrays, [id_name, *table.numbers, *table.columns])

    id_type = dict(columns.dtypes)["record_id"]
    out = ", ".join([f"{id_name} {id_type}", *(f"{n} bigint" for n in table.numbers), *(f"{c} string" for c in table.columns)])
    return columns.select("record_id", *map(_stored, paths)).mapInArrow(run, out)


_ORGANISM = Group({"name": Leaf(), "taxon": Leaf()}, scalar="name")
_ACCESSIONS = Many(Group({"id": Leaf(), "db": Leaf()}, scalar="id"))
_SALTS = Many(Group({"salt": Leaf(), "conc_mm": Leaf()}))
_ITEM = Group({"value": Leaf(), "proteins": Many(Leaf()), "comment": Leaf(), "conditions": Group({"ph": Leaf(), "assays": Many(Group({"temp_c": Leaf(), "salts": _SALTS}))})})
_SUBUNIT = Group({"key": Leaf(), "organism": _ORGANISM, "accessions": _ACCESSIONS, "source": Leaf()})
_PROTEIN = Group({"key": Leaf(), "organism": _ORGANISM, "accessions": _ACCESSIONS, "source": Leaf(), "subunits": Many(_SUBUNIT)})


_LIGANDS = Entries(Group({"key": Leaf(), "items": Many(_ITEM)}), keys=r"(?:inhibitor|ki_value|ic50_value|km_value|turnover_number)(?::\d+)?", inner="items", here=True)

#: Enzyme entries: proteins, their subunits and accessions, ligand items, and all that hangs on them.
ENZYMES = NestedSource(
    Group({"ec": Leaf(), "systematic_name": Leaf(), "protein": Entries(_PROTEIN), "ligand": _LIGANDS}),
    {
        "proteins": Table("protein", ("protein_no",), {"protein_key": "protein.key", "organism": "protein.organism.name", "taxon": "protein.organism.taxon", "source": "protein.source"}),
        "accessions": Table("protein.accessions", ("protein_no", "accession_no"), {"protein_key": "protein.key", "accession": "protein.accessions.id", "db": "protein.accessions.db"}),
        "subunits": Table("protein.subunits", ("protein_no", "subunit_no"), {"protein_key": "protein.key", "subunit_key": "protein.subunits.key", "organism": "protein.subunits.organism.name", "source": "protein.subunits.source"}),
        "subunit_accessions": Table("protein.subunits.accessions", ("protein_no", "subunit_no", "accession_no"), {"subunit_key": "protein.subunits.key", "accession": "protein.subunits.accessions.id", "db": "protein.subunits.accessions.db"}),
        "items": Table("ligand.items", ("field_no", "item_no"), {"field_name": "ligand.key", "value": "ligand.items.value", "comment": "ligand.items.comment", "ph": "ligand.items.conditions.ph"}),
        "item_proteins": Table("ligand.items.proteins", ("field_no", "item_no", "reference_no"), {"field_name": "ligand.key", "protein_key": "ligand.items.proteins"}),
        "assays": Table("ligand.items.conditions.assays", ("field_no", "item_no", "assay_no"), {"field_name": "ligand.key", "temp_c": "ligand.items.conditions.assays.temp_c"}),
        "salts": Table("ligand.items.conditions.assays.salts", ("field_no", "item_no", "assay_no", "salt_no"), {"field_name": "ligand.key", "salt": "ligand.items.conditions.assays.salts.salt", "conc_mm": "ligand.items.conditions.assays.salts.conc_mm"}),
    },
)
