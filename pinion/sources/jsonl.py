"""JSON sources: documents by line, schema files, vector literals; small files on the driver, large ones by Spark."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinion.errors import StatusError, invalid
from pinion.schema import INT64, MISSING, SPARK_TYPES, Doc, Options, Schema, check_vector, type_of


def parse_doc(line: str) -> Doc:
    try:
        d = json.loads(line, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except ValueError as e:
        raise invalid(f"bad document line: {e}") from None
    if not isinstance(d, dict) or not {"id", "fields", "vector"} <= d.keys() or not isinstance(d["id"], str) or not isinstance(d["fields"], dict) or not isinstance(d["vector"], list):
        raise invalid("a document line needs id, fields and vector")
    for value in d["fields"].values():
        type_of(value)
    if d["vector"]:
        check_vector(d["vector"])
    return Doc(d["id"], d["fields"], [float(x) for x in d["vector"]])


def read_docs(path: str) -> list[Doc]:
    """All documents of a file; blank lines are skipped, and any bad line fails the whole file."""
    with open(path, encoding="utf-8") as f:
        return [parse_doc(line) for line in f if line.strip()]


def scan_docs(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """The same for large inputs, as a DataFrame of Schema.struct() without internal ids: (id, f_*, vector, _missing, _extra).

    One bad value fails the read. Absent nullable fields are named in _missing, absent fields with a default get it; undeclared
    fields are kept as JSON in _extra and must be scalar. _order numbers the lines, so that the last of several with one id is
    known. What concerns a whole row (required fields, the primary key) is checked by Collection.append_frame().
    """
    raw = spark.read.text(path).where(F.trim("value") != "").withColumn("_order", F.monotonically_increasing_id())
    raw = raw.select(F.parse_json(F.when(F.trim("value") != "", F.col("value"))).alias("v"), "_order")  # whatever is pushed below the filter
    get = lambda p, t: F.variant_get("v", p, t)
    cols, missing = [], []
    for f in schema.fields:
        kind, p = SPARK_TYPES[f.type].simpleString(), f"$.fields.{f.name}"
        there = F.array_contains(F.map_keys(get("$.fields", "map<string,variant>")), f.name)
        tag = F.schema_of_variant(get(p, "variant"))
        right = tag.isin("BIGINT", "VOID") if f.type == INT64 else tag.isin(kind.upper(), "VOID") if f.type != "Float64" else (tag.startswith("DECIMAL") | tag.isin("DOUBLE", "VOID", "FLOAT"))
        value = F.when(right | ~there, get(p, kind)).otherwise(F.raise_error(f"field {f.name} expects {f.type}").cast(kind))
        cols.append((value if f.default is MISSING else F.when(there, value).otherwise(F.lit(f.default).cast(kind))).alias(f"f_{f.name}"))
        if f.nullable and f.default is MISSING:
            missing.append(F.when(~there, F.lit(f.name)))
    vector = get("$.vector", "array<float>")
    right_size = F.when(F.size(vector) == schema.vector.dimension, vector).otherwise(F.raise_error("wrong vector dimension").cast("array<float>"))
    names = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
    known = [f.name for f in schema.fields]
    extra = F.map_filter(get("$.fields", "map<string,variant>"), lambda k, _: ~k.isin(known))
    scalar = ~F.exists(F.map_values(extra), lambda v: F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY"))
    extra = F.when(F.size(extra) > 0, F.when(scalar, F.to_json(extra)).otherwise(F.raise_error("field values must be scalar").cast("string")))
    is_id = F.schema_of_variant(get("$.id", "variant")) == "STRING"
    named = F.when(is_id | F.isnull("v"), get("$.id", "string")).otherwise(F.raise_error("document ids are strings").cast("string"))
    return raw.select(named.alias("id"), *cols, right_size.alias("vector"), names.alias("_missing"), extra.alias("_extra"), "_order")


def read_schema_file(path: str) -> tuple[Schema, Options]:
    with open(path, encoding="utf-8") as f:
        try:
            d: Any = json.load(f)
            return Schema.from_json(d["schema"]), Options(**d["options"])
        except StatusError:
            raise
        except (ValueError, KeyError, TypeError) as e:
            raise invalid(f"bad schema file: {e!r}") from None


def parse_vector(text: str) -> list[float]:
    """Comma-separated numbers."""
    try:
        v = [float(x.strip()) for x in text.split(",")]
    except ValueError:
        raise invalid("a vector is a list of numbers with commas") from None
    if not all(map(math.isfinite, v)):
        raise invalid("vector parts must be finite")
    check_vector(v)
    return v
