"""Collection schemas: typed scalar fields, one vector field, the vector index states, options, and their JSON."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from pinion.errors import ALREADY_EXISTS, NOT_FOUND, StatusError, invalid

BOOL, INT64, FLOAT64, STRING = "Bool", "Int64", "Float64", "String"
SPARK_TYPES = {BOOL: T.BooleanType(), INT64: T.LongType(), FLOAT64: T.DoubleType(), STRING: T.StringType()}
REQUIRED, NULLABLE = "Required", "Nullable"
COSINE, INNER_PRODUCT, L2 = "Cosine", "InnerProduct", "L2"
METRICS = (COSINE, INNER_PRODUCT, L2)
FLAT, HNSW, IVF = "Flat", "Hnsw", "Ivf"
READ_WRITE, READ_ONLY = "ReadWrite", "ReadOnly"
COLLECTION_NAME, FIELD_NAME = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
I64 = (-(1 << 63), (1 << 63) - 1)


class _Missing:
    """Marks a field that a document does not have; None is an explicit null."""

    def __repr__(self) -> str:
        return "MISSING"

    def __bool__(self) -> bool:
        return False

    def __reduce__(self):
        return "MISSING"


MISSING = _Missing()


def type_of(value: Any) -> str | None:
    """The scalar type of a value: None for null; an error for what is no scalar."""
    if value is None:
        return None
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        if not I64[0] <= value <= I64[1]:
            raise invalid("integer is out of range")
        return INT64
    if isinstance(value, float):
        return FLOAT64
    if isinstance(value, str):
        return STRING
    raise invalid("field values must be scalar")


@dataclass(frozen=True)
class ScalarField:
    name: str
    type: str
    nullable: bool = False
    indexed: bool = False
    default: Any = MISSING

    def to_json(self) -> dict:
        out: dict[str, Any] = {"name": self.name, "type": self.type, "nullability": NULLABLE if self.nullable else REQUIRED, "index": "Indexed" if self.indexed else "None"}
        if self.default is not MISSING:
            out["default"] = self.default
        return out

    @classmethod
    def from_json(cls, d: dict) -> ScalarField:
        return cls(d["name"], d["type"], d.get("nullability", REQUIRED) == NULLABLE, d.get("index", "None") == "Indexed", d.get("default", MISSING))


@dataclass(frozen=True)
class HnswParams:
    max_neighbors: int = 16
    scaling_factor: int = 50
    ef_construction: int = 200
    prune_width: int = 16
    min_neighbor_count: int = 8
    ef_search: int = 64


@dataclass(frozen=True)
class IvfParams:
    n_list: int = 64
    n_probe: int = 8
    training_iterations: int = 8


def check_params(p: HnswParams | IvfParams) -> None:
    for name, value in vars(p).items():
        if not isinstance(value, int) or not 0 < value < 1 << 32:
            raise invalid(f"{name} must be a positive 32-bit integer")
    if isinstance(p, HnswParams):
        if p.scaling_factor < 2:
            raise invalid("scaling_factor must be at least 2")
        if p.min_neighbor_count > p.max_neighbors:
            raise invalid("min_neighbor_count must not exceed max_neighbors")


@dataclass(frozen=True)
class IndexState:
    """Which vector indexes a collection has: flat alone by default; with one of Hnsw and Ivf, flat may be kept beside it."""

    flat: bool = True
    hnsw: HnswParams | None = None
    ivf: IvfParams | None = None
    default: str = FLAT

    def enable(self, kind: str, params: Any = None) -> IndexState:
        other = {HNSW: self.ivf, IVF: self.hnsw}.get(kind)
        if other:
            raise invalid(f"{kind} cannot be combined with the enabled graph or inverted-file index")
        if kind == FLAT:
            return self if self.flat else replace(self, flat=True)
        params = params or (HnswParams() if kind == HNSW else IvfParams())
        check_params(params)
        return replace(self, default=kind, **{kind.lower(): params})

    def drop(self, kind: str) -> IndexState:
        approximate = HNSW if self.hnsw else IVF if self.ivf else None
        if kind == FLAT:
            if not approximate or not self.flat:
                raise invalid("the flat index is not enabled beside another index")
            return replace(self, flat=False, default=approximate)
        if kind != approximate:
            raise invalid(f"{kind} is not enabled")
        return IndexState()

    def to_json(self) -> dict:
        return {"flat": self.flat, "default": self.default, "hnsw": vars(self.hnsw) if self.hnsw else None, "ivf": vars(self.ivf) if self.ivf else None}

    @classmethod
    def from_json(cls, d: Any) -> IndexState:
        if d in (None, "DefaultFlat"):
            return cls()
        hnsw, ivf = d.get("hnsw"), d.get("ivf")
        default = d.get("default") or (HNSW if hnsw else IVF if ivf else FLAT)
        state = cls(bool(d.get("flat", True)), HnswParams(**hnsw) if hnsw else None, IvfParams(**ivf) if ivf else None, default)
        if state.hnsw and state.ivf:
            raise invalid("graph and inverted-file indexes are mutually exclusive")
        for p in (state.hnsw, state.ivf):
            if p:
                check_params(p)
        return state


@dataclass(frozen=True)
class VectorField:
    name: str
    dimension: int
    metric: str = COSINE
    indexes: IndexState = field(default_factory=IndexState)

    def to_json(self) -> dict:
        return {"name": self.name, "dimension": self.dimension, "metric": self.metric, "indexes": self.indexes.to_json()}


@dataclass(frozen=True)
class Schema:
    name: str
    primary_key: str
    fields: tuple[ScalarField, ...]
    vector: VectorField

    def field(self, name: str) -> ScalarField | None:
        return next((f for f in self.fields if f.name == name), None)

    def validate(self) -> None:
        if not COLLECTION_NAME.fullmatch(self.name):
            raise invalid("collection names are made of letters, digits, _ and -")
        if self.vector.dimension < 1:
            raise invalid("the vector dimension must be positive")
        if self.vector.metric not in METRICS:
            raise invalid(f"unknown metric {self.vector.metric}")
        names = [f.name for f in self.fields]
        for n in (*names, self.vector.name):
            if not FIELD_NAME.fullmatch(n):
                raise invalid(f"{n!r} is no field name")
        if len({*names, self.vector.name}) != len(names) + 1:
            raise invalid("field names must be unique")
        pk = self.field(self.primary_key)
        if pk is None or pk.type != STRING or pk.nullable:
            raise invalid("the primary key must be a required String field")
        for f in self.fields:
            check_field(f)

    def add(self, f: ScalarField) -> Schema:
        if self.field(f.name) or f.name == self.vector.name:
            raise StatusError(ALREADY_EXISTS, f"field {f.name} exists")
        if not f.nullable and f.default is MISSING:
            raise invalid("a required column needs a default")
        out = replace(self, fields=(*self.fields, f))
        out.validate()
        return out

    def rename(self, old: str, new: str) -> Schema:
        if old == self.primary_key:
            raise invalid("the primary key cannot be renamed")
        if not self.field(old):
            raise StatusError(NOT_FOUND, f"no column {old}")
        if new != old and (self.field(new) or new == self.vector.name):
            raise StatusError(ALREADY_EXISTS, f"field {new} exists")
        out = replace(self, fields=tuple(replace(f, name=new) if f.name == old else f for f in self.fields))
        out.validate()
        return out

    def without(self, name: str) -> Schema:
        if name == self.primary_key:
            raise invalid("the primary key cannot be dropped")
        if not self.field(name):
            raise StatusError(NOT_FOUND, f"no column {name}")
        return replace(self, fields=tuple(f for f in self.fields if f.name != name))

    def with_scalar_index(self, name: str, indexed: bool) -> Schema:
        f = self.field(name)
        if not f:
            raise StatusError(NOT_FOUND, f"no column {name}")
        changed = replace(f, indexed=indexed)
        check_field(changed)
        return replace(self, fields=tuple(changed if g.name == name else g for g in self.fields))

    def with_indexes(self, state: IndexState) -> Schema:
        return replace(self, vector=replace(self.vector, indexes=state))

    def struct(self) -> T.StructType:
        """Columns of a segment: internal id, id, declared fields, vector, names of missing fields, undeclared fields as JSON."""
        out = T.StructType([T.StructField("_doc_id", T.LongType(), False), T.StructField("id", T.StringType(), False)])
        for f in self.fields:
            out.add(f"f_{f.name}", SPARK_TYPES[f.type], True)
        out.add("vector", T.ArrayType(T.FloatType(), False), False)
        out.add("_missing", T.ArrayType(T.StringType(), False), False)
        return out.add("_extra", T.StringType(), True)

    def to_json(self) -> dict:
        return {"name": self.name, "primary_key": self.primary_key, "fields": [f.to_json() for f in self.fields], "vector": self.vector.to_json()}

    @classmethod
    def from_json(cls, d: dict) -> Schema:
        v = d["vector"]
        vector = VectorField(v["name"], v["dimension"], v.get("metric", COSINE), IndexState.from_json(v.get("indexes")))
        return cls(d["name"], d["primary_key"], tuple(ScalarField.from_json(f) for f in d["fields"]), vector)


def check_field(f: ScalarField) -> None:
    if f.type not in SPARK_TYPES:
        raise invalid(f"unknown type {f.type}")
    if f.indexed and f.nullable:
        raise invalid(f"indexed field {f.name} must be required")
    if f.default is not MISSING and (type_of(f.default) or f.type) != f.type or f.default is None and not f.nullable:
        raise invalid(f"default of {f.name} does not match its type")


@dataclass(frozen=True)
class Options:
    access_mode: str = READ_WRITE
    storage_access: str = "MmapPreferred"
    segment_max_docs: int = 1024

    def to_json(self) -> dict:
        return dict(vars(self))


@dataclass
class Doc:
    id: str
    fields: dict[str, Any]
    vector: list[float] = field(default_factory=list)
    score: float | None = None

    def to_json(self) -> dict:
        return {"id": self.id, "fields": {k: tagged(v) for k, v in sorted(self.fields.items())}, "vector": self.vector, "score": self.score}


def tagged(value: Any) -> Any:
    """Scalars as the command line prints them: {"Int64": 11}; null is "Null"."""
    kind = type_of(value)
    return "Null" if kind is None else {kind: value}


def check_vector(v: list[float], dimension: int | None = None) -> None:
    if not v:
        raise invalid("a vector must not be empty")
    if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and abs(x) < 3.4028236e38 for x in v):
        raise invalid("vector parts must be finite")
    if dimension is not None and len(v) != dimension:
        raise invalid(f"expected {dimension} dimensions, got {len(v)}")


def with_defaults(schema: Schema, doc: Doc) -> Doc:
    """Defaults fill absent fields only; explicit nulls stay."""
    filled = {f.name: f.default for f in schema.fields if f.default is not MISSING and f.name not in doc.fields}
    return Doc(doc.id, {**doc.fields, **filled}, doc.vector) if filled else doc


def check_doc(schema: Schema, doc: Doc) -> None:
    if not isinstance(doc.id, str) or not doc.id:
        raise invalid("document ids are non-empty strings")
    check_vector(doc.vector, schema.vector.dimension)
    for value in doc.fields.values():
        type_of(value)
    for f in schema.fields:
        value = doc.fields.get(f.name, MISSING)
        if value is MISSING or value is None:
            if not f.nullable:
                raise invalid(f"field {f.name} is required")
        elif type_of(value) != f.type:
            raise invalid(f"field {f.name} expects {f.type}")
    if doc.fields[schema.primary_key] != doc.id:
        raise invalid("the primary key must equal the document id")
