"""Command line over the collection API: one subcommand per operation, JSON on stdout, exit code 1 on failure."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from pinion.collection import Collection, Database
from pinion.errors import StatusError, WriteResult, invalid
from pinion.plans.planner import HnswSearch, IvfSearch, VectorQuery
from pinion.schema import BOOL, COSINE, FLOAT64, HNSW, INT64, INNER_PRODUCT, IVF, L2, MISSING, NULLABLE, REQUIRED, STRING, HnswParams, IvfParams, Options, ScalarField, Schema, VectorField
from pinion.sources.jsonl import parse_vector, read_docs, read_schema_file

METRIC_NAMES = {"cosine": COSINE, "inner-product": INNER_PRODUCT, "l2": L2}
KINDS = {"flat": "Flat", "scalar": "Scalar", "hnsw": HNSW, "ivf": IVF}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pinion")
    top.add_argument("--root", default=".")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        return p

    add("init")
    p = add("create", "name")
    p.add_argument("dimension", type=int)
    p.add_argument("--metric", choices=METRIC_NAMES, default="cosine")
    p.add_argument("--segment-max-docs", type=int, default=1024)
    p.add_argument("--storage-access", default="MmapPreferred")
    add("create-from-schema", "path")
    for name in ("insert-jsonl", "upsert-jsonl", "update-jsonl"):
        add(name, "name", "path")
    add("delete-ids", "name").add_argument("ids", nargs="+")
    add("delete-filter", "name").add_argument("--filter", required=True)
    query = add("query").add_subparsers(dest="source", required=True)
    for source in ("vector", "by-id"):
        p = query.add_parser(source)
        p.add_argument("name")
        p.add_argument("--value", required=True)
        p.add_argument("--top-k", type=int, default=10)
        p.add_argument("--filter")
        p.add_argument("--vector-projection", choices=["include", "exclude"], default="exclude")
        p.add_argument("--fields")
        kinds = p.add_subparsers(dest="search")
        kinds.add_parser("hnsw").add_argument("--ef-search", type=int, required=True)
        kinds.add_parser("ivf").add_argument("--nprobe", type=int, required=True)
    add("fetch", "name", "id")
    for name in ("create-index", "drop-index"):
        kinds = add(name, "name", "field").add_subparsers(dest="kind", required=True)
        for kind in KINDS:
            p = kinds.add_parser(kind)
            if name == "create-index":
                for f in vars(HnswParams() if kind == "hnsw" else IvfParams() if kind == "ivf" else Options()) if kind in ("hnsw", "ivf") else ():
                    p.add_argument("--" + f.replace("_", "-"), type=int)
    p = add("add-column", "name", "column")
    p.add_argument("--type", choices=["bool", "int64", "float64", "string"], required=True)
    p.add_argument("--nullability", choices=["required", "nullable"], default="required")
    p.add_argument("--index", action="store_true")
    p.add_argument("--default")
    add("rename-column", "name", "column", "to")
    add("drop-column", "name", "column")
    for name in ("flush", "optimize", "schema", "options", "stats"):
        add(name, "name")
    return top


def default_schema(name: str, dimension: int, metric: str) -> Schema:
    fields = (ScalarField("pk", STRING), ScalarField("rank", INT64), ScalarField("category", STRING), ScalarField("score", FLOAT64))
    return Schema(name, "pk", fields, VectorField("embedding", dimension, metric))


class Failed(Exception):
    """Some rows of a batch failed; their results have been printed."""


def show(out: Any) -> None:
    print(json.dumps(out, indent=2))


def results(rows: list[WriteResult]) -> None:
    show([r.to_json() for r in rows])
    if not all(r.ok for r in rows):
        raise Failed("some rows failed")


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    db = Database(spark, a.root)
    if a.command == "init":
        return show({"root": a.root})
    if a.command == "create":
        with db.create_collection(default_schema(a.name, a.dimension, METRIC_NAMES[a.metric]), Options(storage_access=a.storage_access, segment_max_docs=a.segment_max_docs)) as c:
            return show(c.schema.to_json())
    if a.command == "create-from-schema":
        schema, options = read_schema_file(a.path)
        with db.create_collection(schema, options) as c:
            return show(c.schema.to_json())
    with db.open_collection(a.name) as c:
        on_collection(c, a)


def on_collection(c: Collection, a: argparse.Namespace) -> None:
    match a.command:
        case "insert-jsonl" | "upsert-jsonl" | "update-jsonl":
            results(getattr(c, a.command.split("-")[0])(read_docs(a.path)))
        case "delete-ids":
            results(c.delete(a.ids))
        case "delete-filter":
            c.delete_by_filter(a.filter)
            show({"status": "Ok"})
        case "query":
            search = HnswSearch(a.ef_search) if a.search == "hnsw" else IvfSearch(a.nprobe) if a.search == "ivf" else None
            vector, by_id = (parse_vector(a.value), None) if a.source == "vector" else (None, a.value)
            fields = a.fields.split(",") if a.fields is not None else None
            q = VectorQuery(c.schema.vector.name, a.top_k, vector, by_id, a.filter, fields, a.vector_projection == "include", search)
            show([d.to_json() for d in c.query(q)])
        case "fetch":
            show({i: d.to_json() for i, d in c.fetch([a.id]).items()})
        case "create-index":
            given = {k: v for k, v in vars(a).items() if k in vars(HnswParams()) | vars(IvfParams()) and v is not None}
            params = HnswParams(**given) if a.kind == "hnsw" else IvfParams(**given) if a.kind == "ivf" else None
            c.create_index(a.field, KINDS[a.kind], params)
            show(c.schema.to_json())
        case "drop-index":
            c.drop_index(a.field, KINDS[a.kind])
            show(c.schema.to_json())
        case "add-column":
            kind = {"bool": BOOL, "int64": INT64, "float64": FLOAT64, "string": STRING}[a.type]
            try:
                default = MISSING if a.default is None else json.loads(a.default)
            except ValueError:
                raise invalid("the default is no JSON value") from None
            c.add_column(ScalarField(a.column, kind, (REQUIRED, NULLABLE)[a.nullability == "nullable"] == NULLABLE, a.index, default))
            show(c.schema.to_json())
        case "rename-column":
            c.rename_column(a.column, a.to)
            show(c.schema.to_json())
        case "drop-column":
            c.drop_column(a.column)
            show(c.schema.to_json())
        case "flush" | "optimize":
            getattr(c, a.command)()
            show({"status": "Ok"})
        case "schema":
            show(c.schema.to_json())
        case "options":
            show(c.options.to_json())
        case "stats":
            show(c.stats())


def main() -> int:
    spark = SparkSession.builder.appName("pinion").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        run(spark, sys.argv[1:])
        return 0
    except (StatusError, Failed, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
