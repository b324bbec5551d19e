"""Databases and collections: versioned Parquet segments under a JSON manifest, an operation log between checkpoints,
tombstones as an anti join, and queries as DataFrames.

Layout: manifest.N.json names the data version and all counters; data/v=N/segment_id=S holds the live rows; oplog/SEQ.json
is one file per write batch; tombs/SEQ holds the internal ids that one delete by filter took. A new version is written in full,
indexes included, before its manifest appears, and state in memory changes after that, so a crash or a failure loses nothing.
Batches through the API are small and resolved on the driver; append_frame() and delete_by_filter() never leave Spark.
"""

from __future__ import annotations

import fcntl
import json
import os
import re
import threading
from contextlib import suppress
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinion.errors import ALREADY_EXISTS, FAILED_PRECONDITION, INTERNAL, NOT_FOUND, PERMISSION_DENIED, StatusError, WriteResult, invalid
from pinion.functions.metrics import literal, score, scores
from pinion.operators import hnsw, ivf
from pinion.operators.flat import exact_top_k
from pinion.plans.filters import check, compile_filter, conjunction, parse
from pinion.plans.planner import QueryPlan, SegmentCounts, VectorQuery, ann_candidates, plan, widened_ef, widened_probe
from pinion.schema import COLLECTION_NAME, COSINE, FLAT, FLOAT64, HNSW, IVF, MISSING, READ_ONLY, SPARK_TYPES, STRING, Doc, Options, ScalarField, Schema, check_doc, check_field, with_defaults
from pinion.sources.files import Files

_open: set[str] = set()
_guard = threading.Lock()


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        Files(spark, self.root).make()

    def create_collection(self, schema: Schema, options: Options | None = None) -> Collection:
        options = options or Options()
        if options.access_mode == READ_ONLY:
            raise invalid("a collection cannot be created read-only")
        if options.segment_max_docs < 1:
            raise invalid("segment_max_docs must be positive")
        schema.validate()
        files = Files(self.spark, f"{self.root}/{schema.name}")
        if files.exists():
            raise StatusError(ALREADY_EXISTS, f"collection {schema.name} exists")
        files.make()
        c = Collection(self.spark, files)
        c.schema, c.options = schema, options
        c._checkpoint()
        return c

    def open_collection(self, name: str) -> Collection:
        if not COLLECTION_NAME.fullmatch(name):
            raise invalid("collection names are made of letters, digits, _ and -")
        files = Files(self.spark, f"{self.root}/{name}")
        if not any(_version(n) is not None for n in files.names()):
            raise StatusError(NOT_FOUND, f"no collection {name}")
        c = Collection(self.spark, files)
        try:
            c._load()
        except BaseException:
            c.close()
            raise
        return c


def _locked(root: str) -> int | None:
    """An exclusive lock on a local collection, held by its descriptor. Other stores have none: there one process is to write."""
    path = root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:")
    if "://" in path:
        return None
    os.makedirs(path, exist_ok=True)
    lock = os.open(f"{path}/LOCK", os.O_CREAT | os.O_RDWR, 0o644)
    try:
        fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
    except OSError:
        os.close(lock)
        raise StatusError(FAILED_PRECONDITION, "another process has opened the collection") from None
    return lock


def _version(name: str) -> int | None:
    m = re.fullmatch(r"manifest\.(\d+)\.json", name)
    return int(m[1]) if m else None


class Collection:
    """One process at a time holds a collection; close() lets it go."""

    def __init__(self, spark: SparkSession, files: Files):
        with _guard:
            if files.root in _open:
                raise StatusError(FAILED_PRECONDITION, "the collection is open already")
            self.lock = _locked(files.root)
            _open.add(files.root)
        self.spark, self.files, self.closed = spark, files, False
        self.version, self.sequence, self.next_id, self.segments = -1, 0, 1, []
        self.delta: dict[int, tuple[int, Doc]] = {}  # internal id -> (segment, document), since the last checkpoint
        self.gone: set[int] = set()  # internal ids of checkpointed rows that were replaced or deleted one by one since
        self.tombs: list[str] = []  # tables of internal ids of checkpointed rows that were deleted by filters since
        self.by_id: dict[str, int | None] = {}  # public ids touched since the checkpoint; None: deleted
        self.writing = 0  # live rows of the writing segment
        self.next_segment = 1
        self.schema: Schema
        self.options: Options

    def close(self) -> None:
        with _guard:
            if not self.closed:
                _open.discard(self.files.root)
                self.closed = True
                if self.lock is not None:
                    os.close(self.lock)

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    # --- state -------------------------------------------------------------------------------------------------------

    def _base(self, segments: list[int] | None = None) -> DataFrame:
        """Checkpointed rows, of all segments or of some: then the folders of others are not read."""
        struct = self.schema.struct().add("segment_id", "long")
        if not self.segments or segments == []:
            return self.spark.createDataFrame([], struct)
        rows = self.spark.read.schema(struct).parquet(f"{self.files.root}/data/v={self.version}")
        return rows if segments is None or len(segments) == len(self.segments) else rows.where(F.col("segment_id").isin(segments))

    def _may_hold(self, prefilter: tuple[Any, ...]) -> list[int]:
        """Segments whose least and largest values of indexed fields do not rule out the tests of a prefilter."""

        def may(s: dict) -> bool:
            for leaf in prefilter:
                if s["doc_count"] and leaf.field in s.get("ranges", {}):
                    low, high = s["ranges"][leaf.field]
                    fits = {"=": lambda v: low <= v <= high, "<": lambda v: low < v, "<=": lambda v: low <= v, ">": lambda v: high > v, ">=": lambda v: high >= v}[leaf.op]
                    if low is None or not fits(leaf.value):
                        return False
            return True

        return [s["segment_id"] for s in self.segments if s["doc_count"] and may(s)]

    def _delta_frame(self) -> DataFrame:
        names = [f.name for f in self.schema.fields]
        rows = []
        for k, (segment, d) in sorted(self.delta.items()):
            extra = {n: v for n, v in d.fields.items() if n not in names}
            missing = [n for n in names if n not in d.fields]
            rows.append((k, d.id, *(d.fields.get(n) for n in names), [float(np.float32(x)) for x in d.vector], missing, json.dumps(extra) if extra else None, segment))
        return self.spark.createDataFrame(rows, self.schema.struct().add("segment_id", "long"))

    def _live_base(self, segments: list[int] | None = None) -> DataFrame:
        """Checkpointed rows without tombstones."""
        base = self._base(segments)
        if self.gone:
            dead = self.spark.createDataFrame([(k,) for k in sorted(self.gone)], "_doc_id long")
            base = base.join(dead, "_doc_id", "left_anti").select(base.columns)
        if self.tombs:
            dead = self.spark.read.schema("_doc_id long").parquet(*(f"{self.files.root}/{t}" for t in self.tombs))
            base = base.join(dead, "_doc_id", "left_anti").select(base.columns)
        return base

    def live(self, segments: list[int] | None = None) -> DataFrame:
        """All live rows with their segment: checkpointed rows (of some segments) without tombstones, and what was written since."""
        base = self._live_base(segments)
        return base.unionByName(self._delta_frame()) if self.delta else base

    def _find(self, ids: list[str]) -> dict[str, tuple[int, Doc]]:
        """Live documents among ids: those written since the checkpoint at once, others by one scan."""
        out, asked = {}, []
        for i in dict.fromkeys(ids):
            k = self.by_id.get(i)
            if k in self.delta:
                out[i] = (k, self.delta[k][1])
            elif i not in self.by_id:
                asked.append(i)
        if asked and self.segments:
            rows = self._live_base()
            few = len(asked) <= 100
            rows = rows.where(F.col("id").isin(asked)) if few else rows.join(self.spark.createDataFrame([(i,) for i in asked], "id string"), "id", "left_semi")
            out |= {r["id"]: (r["_doc_id"], self._doc(r)) for r in rows.collect()}
        return out

    def _doc(self, row: Any) -> Doc:
        missing = set(row["_missing"] or ())
        fields = {f.name: row[f"f_{f.name}"] for f in self.schema.fields if f.name not in missing}
        return Doc(row["id"], fields | (json.loads(row["_extra"]) if row["_extra"] else {}), list(row["vector"]))

    def _load(self) -> None:
        version = max(v for n in self.files.names() if (v := _version(n)) is not None)
        try:
            m = json.loads(self.files.read(f"manifest.{version}.json"))
            self.schema, self.options = Schema.from_json(m["schema"]), Options(**m["options"])
            self.version, self.sequence, self.next_id = version, m["sequence"], m["next_id"]
            self.segments, self.next_segment = m["segments"], m["next_segment"]
        except (ValueError, KeyError, TypeError) as e:
            raise StatusError(INTERNAL, f"manifest {version} is corrupt: {e!r}") from None
        self.schema.validate()
        self._check_indexes()
        pending = [n for n in self.files.names("oplog") if int(n.split(".")[0]) >= self.sequence]
        if pending and self.options.access_mode == READ_ONLY:
            raise StatusError(FAILED_PRECONDITION, "a read-only collection has pending operations")
        for name in pending:
            try:
                log = json.loads(self.files.read(f"oplog/{name}"))
                ops = [(o["op"], Doc(o["id"], o.get("fields", {}), o.get("vector", []))) for o in log["ops"]]
                tombs = log.get("tombs")
            except (ValueError, KeyError, TypeError) as e:
                raise StatusError(INTERNAL, f"operation log {name} is corrupt: {e!r}") from None
            known = self._find([d.id for _, d in ops])
            for op, d in ops:  # what the checkpoint holds already is skipped
                if op == "insert" and d.id in known or op in ("update", "delete") and d.id not in known:
                    continue
                self._apply(op, d, known)
            if tombs:
                self.tombs.append(tombs)
            self.sequence = int(name.split(".")[0]) + 1

    def _checkpoint(self, rows: DataFrame | None = None, schema: Schema | None = None, next_id: int | None = None, next_segment: int | None = None) -> None:
        """Seals the writing segment, writes all live rows and their indexes as a new version, then its manifest; older
        versions go last. schema, next_id and next_segment are those of the new version; until it is there, nothing changes."""
        grown = rows is not None and next_id is not None
        rows, schema = self.live() if rows is None else rows, schema or self.schema
        version = self.version + 1
        if next_segment is None:
            next_segment = self.next_segment
            if self.writing:
                rows = rows.withColumn("segment_id", F.when(F.col("segment_id") == 0, next_segment).otherwise(F.col("segment_id")))
                next_segment += 1
        next_id, segments = self.next_id if next_id is None else next_id, []
        if self.segments or self.delta or grown:
            at = f"{self.files.root}/data/v={version}"
            writer = rows.repartition("segment_id").sortWithinPartitions("segment_id", "_doc_id").write.partitionBy("segment_id").mode("overwrite")
            indexed = [f for f in schema.fields if f.indexed]
            for f in indexed:  # equality on an indexed string skips row groups by their Bloom filters
                if f.type == STRING:
                    writer = writer.option(f"parquet.bloom.filter.enabled#f_{f.name}", "true")
            writer.parquet(at)
            written = self.spark.read.schema(rows.schema).parquet(at)
            segments = [segment_entry(r, indexed) for r in segment_meta(written, indexed).collect()]
            if segments:
                self._build_indexes(written, schema, version)
        manifest = {"schema": schema.to_json(), "options": self.options.to_json(), "sequence": self.sequence, "next_id": next_id, "next_segment": next_segment, "segments": segments}
        self.files.write(f"manifest.{version}.json", json.dumps(manifest))  # the commit
        self.version, self.schema, self.segments, self.next_id, self.next_segment = version, schema, segments, next_id, next_segment
        self.delta, self.gone, self.tombs, self.by_id, self.writing = {}, set(), [], {}, 0
        self._collect_garbage()

    def _collect_garbage(self) -> None:
        """What only older versions need; what cannot be deleted now goes after a later checkpoint."""
        with suppress(Exception):
            for folder in ("oplog", "tombs"):  # all of it is in the version
                for name in self.files.names(folder):
                    self.files.delete(f"{folder}/{name}")
            for name in self.files.names():
                if (v := _version(name)) is not None and v < self.version:
                    self.files.delete(name)
            for folder in ("data", "index"):
                for name in self.files.names(folder):
                    if name != f"v={self.version}":
                        self.files.delete(f"{folder}/{name}")

    def _build_indexes(self, rows: DataFrame, schema: Schema, version: int) -> None:
        """Side tables of the vector indexes, per segment, for the rows of a version."""
        state, at = schema.vector.indexes, f"{self.files.root}/index/v={version}"
        if state.ivf:
            ivf.build_lists(rows, schema.vector.metric, state.ivf).write.mode("overwrite").parquet(f"{at}/ivf")
        if state.hnsw:
            hnsw.build_edges(rows, schema.vector.metric, state.hnsw).write.mode("overwrite").parquet(f"{at}/hnsw")

    def _check_indexes(self) -> None:
        """The side tables of a version must be there and cover exactly its rows."""
        state, at = self.schema.vector.indexes, f"index/v={self.version}"
        if not self.segments:
            return
        for kind, params in (("ivf", state.ivf), ("hnsw", state.hnsw)):
            if params and not self.files.exists(f"{at}/{kind}"):
                raise StatusError(INTERNAL, f"the {kind} index of version {self.version} is missing")
        if state.ivf:
            lists = self.spark.read.parquet(f"{self.files.root}/{at}/ivf")
            good = (F.size("centroid") == self.schema.vector.dimension) & ~F.exists("centroid", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.col("residual") >= 0)
            whole = (F.count_if(good) == F.count("centroid")) & (F.count("centroid") == F.count_distinct("list"))
            lists = lists.groupBy("segment_id").agg(F.count("*").alias("n"), F.count_distinct("_doc_id").alias("ids"), F.min("_doc_id").alias("low"), F.max("_doc_id").alias("high"), F.max("list").alias("last"), whole.alias("good"))
            have = {r["segment_id"]: r for r in lists.collect()}
            for s in self.segments:
                r = have.get(s["segment_id"])
                if r is None or not r["n"] == r["ids"] == s["doc_count"] or (r["low"], r["high"]) != (s["min_id"], s["max_id"]) or r["last"] >= min(r["n"], state.ivf.n_list) or not r["good"]:
                    raise StatusError(INTERNAL, f"the ivf index of segment {s['segment_id']} does not fit its rows")
        if state.hnsw:
            edges = self.spark.read.parquet(f"{self.files.root}/{at}/hnsw")
            near = edges.groupBy("segment_id", "level", "a").agg(F.count("*").alias("n"), F.count_distinct("b").alias("different"), F.bool_or(F.col("a") == F.col("b")).alias("loop"))
            limit = state.hnsw.max_neighbors * F.when(F.col("level") == 0, 2).otherwise(1)
            bad = near.where((F.col("n") > limit) | (F.col("n") > F.col("different")) | F.col("loop")).select("segment_id")
            ends = edges.select("segment_id", F.explode(F.array("a", "b")).alias("_doc_id")).distinct()
            bad = bad.union(ends.join(self._base().select("segment_id", "_doc_id"), ["segment_id", "_doc_id"], "left_anti").select("segment_id")).head()
            if bad:
                raise StatusError(INTERNAL, f"the hnsw index of segment {bad['segment_id']} is no graph of its rows")

    # --- reads -------------------------------------------------------------------------------------------------------

    def stats(self) -> dict[str, int]:
        sealed = {s for s, _ in self.delta.values()} - {0}
        return {"doc_count": self.live().count(), "segment_count": len({s["segment_id"] for s in self.segments} | sealed) + 1}

    def fetch(self, ids: list[str]) -> dict[str, Doc]:
        """Live documents by id, with a score of 0; unknown ids are left out."""
        return {i: replace(d, score=0.0) for i, (_, d) in self._find(ids).items()}

    def fetch_frame(self, ids: DataFrame) -> DataFrame:
        """Rows of many ids (column id), by a semi join."""
        return self.live().join(ids.select("id"), "id", "left_semi").withColumn("_score", F.lit(0.0).cast("float"))

    def fetch_internal(self, ids: list[int]) -> DataFrame:
        """Live rows by internal id. Only segments whose range of ids holds one of them are read."""
        wanted = [s["segment_id"] for s in self.segments if any(s["min_id"] <= i <= s["max_id"] for i in ids)]
        return self.live(wanted).where(F.col("_doc_id").isin(list(ids)))

    def _resolved(self, q: VectorQuery) -> list[float]:
        if q.vector is not None:
            return [float(np.float32(x)) for x in q.vector]
        if q.by_id is None:
            raise invalid("a query needs a vector or a document id")
        found = self._find([q.by_id])
        if q.by_id not in found:
            raise StatusError(NOT_FOUND, f"no document {q.by_id}")
        return found[q.by_id][1].vector

    def query_frame(self, q: VectorQuery) -> DataFrame:
        """The hits as a DataFrame: all columns and _score, best first."""
        p = plan(q, self.schema)
        vector = self._resolved(q)
        rows = self.live(self._may_hold(p.prefilter) if p.prefilter else None)
        if p.tree is not None:
            rows = rows.where(compile_filter(p.tree, self.schema))
        if p.recall.kind != FLAT and self.segments:
            rows = rows.join(self._candidates(p, vector), "_doc_id", "left_semi")
        return exact_top_k(rows, self.schema.vector.metric, vector, q.top_k)

    def query(self, q: VectorQuery) -> list[Doc]:
        keep = None if q.fields is None else set(q.fields)
        out = []
        for r in self.query_frame(q).collect():
            d = self._doc(r)
            fields = d.fields if keep is None else {k: v for k, v in d.fields.items() if k in keep}
            out.append(Doc(d.id, fields, d.vector if q.include_vector else [], r["_score"]))
        return out

    def _candidates(self, p: QueryPlan, vector: list[float]) -> DataFrame:
        """Internal ids that the graph or the lists of each segment offer; rows written since the checkpoint all are offered."""
        pre = conjunction(list(p.prefilter))
        allowed = compile_filter(pre, self.schema) if pre is not None else F.lit(True)
        live = self._live_base().select("_doc_id", F.lit(True).alias("_live"), F.coalesce(allowed, F.lit(False)).alias("_allowed"))
        found = self._of_lists(p, vector, live) if p.recall.kind == IVF else self._of_graphs(p, vector, live)
        return found.union(self._delta_frame().select("_doc_id")) if self.delta else found

    def _of_lists(self, p: QueryPlan, vector: list[float], live: DataFrame) -> DataFrame:
        """The rows of the lists that are probed. Centroids and counts decide which: vectors are read of probed rows only."""
        metric, k, breadth, budget, q = self.schema.vector.metric, p.query.top_k, p.recall.params, p.recall.budget, np.array(vector, np.float64)
        table = self.spark.read.parquet(f"{self.files.root}/index/v={self.version}/ivf")
        rows, clean = table.select("segment_id", "list", "_doc_id"), not (self.gone or self.tombs or p.prefilter)
        if clean:
            counts = rows.withColumns({"_live": F.lit(True), "_allowed": F.lit(True)})
        else:
            counts = rows.join(live, "_doc_id", "left")
        counts = counts.groupBy("segment_id", "list").agg(F.count("*").alias("n"), F.count_if("_live").alias("live"), F.count_if("_allowed").alias("allowed"))

        def rank(pdf):
            c = SegmentCounts(int(pdf["n"].sum()), int(pdf["n"].sum()), int(pdf["live"].sum()), int(pdf["allowed"].sum()))
            pdf = pdf[pdf["live"] > 0].sort_values("list").reset_index(drop=True)
            if not len(pdf):
                return pdf[["segment_id", "list"]].assign(probed=False, bound=0.0)
            wanted = ann_candidates(k, c, budget)
            probe = widened_probe(breadth, len(pdf), k, wanted, c, budget, c.indexed > c.visible)
            centroids = np.stack(pdf["centroid"].to_list())
            first = np.lexsort((pdf["list"], -scores(metric, centroids, q)))[:probe]
            probed = pdf.index.isin(first) | (metric != COSINE and wanted > k)  # all rows are wanted, and bounds rule none out
            return pdf[["segment_id", "list"]].assign(probed=probed, bound=[ivf.bound(metric, x, r, q) for x, r in zip(centroids, pdf["residual"], strict=True)])

        lists = table.where("centroid IS NOT NULL").select("segment_id", "list", "centroid", "residual").join(counts, ["segment_id", "list"])
        lists = lists.groupBy("segment_id").applyInPandas(rank, "segment_id long, list int, probed boolean, bound double")
        of = lambda some: rows.join(some.select("segment_id", "list"), ["segment_id", "list"], "left_semi").select("_doc_id")
        probed = of(lists.where("probed"))
        if metric == COSINE:
            return probed
        # lists go on as long as a bound allows a row among the k best of those probed
        best = self._live_base().join(probed, "_doc_id", "left_semi").select(score(metric, F.col("vector"), literal(vector)).alias("s"))
        best = best.orderBy(F.desc("s")).limit(k).agg(F.min("s").alias("least"), F.count("*").alias("n")).head()
        if best["n"] < k:
            return of(lists)
        return of(lists.where(F.col("probed") | (F.col("bound") >= best["least"] - 1e-6 * (1 + abs(best["least"])))))

    def _of_graphs(self, p: QueryPlan, vector: list[float], live: DataFrame) -> DataFrame:
        """What a search of each segment's graph finds."""
        metric, k, breadth, budget, q = self.schema.vector.metric, p.query.top_k, p.recall.params, p.recall.budget, np.array(vector)
        rows = self._base().select("segment_id", "_doc_id", "vector").join(live, "_doc_id", "left")
        edges = self.spark.read.parquet(f"{self.files.root}/index/v={self.version}/hnsw")
        params = self.schema.vector.indexes.hnsw

        def search_graph(left, right):
            left = left.sort_values("_doc_id")
            ids, up = left["_doc_id"].to_numpy(), left["_live"].eq(True).to_numpy()
            if not up.any():
                return left[["_doc_id"]].iloc[:0]
            c = SegmentCounts(len(left), len(left), int(up.sum()), int((up & left["_allowed"].eq(True).to_numpy()).sum()))
            g = hnsw.Graph(metric, np.stack(left["vector"].to_list()), ids, params)
            at = {int(d): i for i, d in enumerate(ids)}
            for level, a, b in zip(right["level"], right["a"], right["b"], strict=True):
                g.edges[level].setdefault(at[a], []).append(at[b])
            g.check()
            wanted = ann_candidates(k, c, budget)
            hits = [i for i, _ in g.search(q, wanted, widened_ef(breadth, wanted), up)]  # deleted rows only lead on
            return left[left["_doc_id"].isin(hits)][["_doc_id"]]

        return rows.groupBy("segment_id").cogroup(edges.groupBy("segment_id")).applyInPandas(search_graph, "_doc_id long")

    # --- writes ------------------------------------------------------------------------------------------------------

    def insert(self, docs: list[Doc]) -> list[WriteResult]:
        return self._write("insert", docs)

    def upsert(self, docs: list[Doc]) -> list[WriteResult]:
        return self._write("upsert", docs)

    def update(self, docs: list[Doc]) -> list[WriteResult]:
        """Field by field; an empty vector keeps the old one."""
        return self._write("update", docs)

    def delete(self, ids: list[str]) -> list[WriteResult]:
        return self._write("delete", [Doc(i, {}, []) for i in ids])

    def delete_by_filter(self, text: str) -> None:
        self._writable()
        tree = parse(text)
        check(tree, self.schema)
        wanted = compile_filter(tree, self.schema)
        ids = [r["id"] for r in self._delta_frame().where(wanted).select("id").collect()] if self.delta else []  # rows held here anyway
        tombs = None
        if self.segments:
            tombs = f"tombs/{self.sequence:012d}"
            self._live_base().where(wanted).select("_doc_id").write.mode("overwrite").parquet(f"{self.files.root}/{tombs}")
        self.files.make("oplog")
        self.files.write(f"oplog/{self.sequence:012d}.json", json.dumps({"ops": [{"op": "delete", "id": i} for i in ids], "tombs": tombs}))
        self.sequence += 1
        known = self._find(ids)
        for i in ids:
            self._apply("delete", Doc(i, {}, []), known)
        self.tombs += [tombs] if tombs else []

    def _writable(self) -> None:
        if self.options.access_mode == READ_ONLY:
            raise StatusError(PERMISSION_DENIED, "the collection is read-only")

    def _apply(self, op: str, d: Doc, known: dict[str, tuple[int, Doc]]) -> None:
        old = known.get(d.id)
        if op == "insert" and old:
            raise StatusError(ALREADY_EXISTS, f"document {d.id} exists")
        if op in ("update", "delete") and not old:
            raise StatusError(NOT_FOUND, f"no document {d.id}")
        new = None
        if op == "update":
            new = Doc(d.id, {**old[1].fields, **d.fields}, d.vector or old[1].vector)
        elif op != "delete":
            new = with_defaults(self.schema, d)
        if new:
            check_doc(self.schema, new)
        if old:
            if old[0] in self.delta:
                self.writing -= self.delta.pop(old[0])[0] == 0
            else:
                self.gone.add(old[0])
        known.pop(d.id, None)
        self.by_id[d.id] = None
        if new:
            k, self.next_id = self.next_id, self.next_id + 1
            self.delta[k], self.by_id[d.id], known[d.id] = (0, new), k, (k, new)
            self.writing += 1
            if self.writing >= self.options.segment_max_docs:  # the writing segment is full: it gets a number
                self.delta = {i: (self.next_segment if s == 0 else s, x) for i, (s, x) in self.delta.items()}
                self.next_segment, self.writing = self.next_segment + 1, 0

    def _write(self, op: str, docs: list[Doc]) -> list[WriteResult]:
        """One result per row in order; rows see earlier ones; what succeeded is logged as one file, or nothing is changed."""
        if self.options.access_mode == READ_ONLY:
            return [WriteResult(d.id, PERMISSION_DENIED, "the collection is read-only") for d in docs]
        known = self._find([d.id for d in docs])
        before = (dict(self.delta), set(self.gone), dict(self.by_id), self.writing, self.next_id, self.next_segment)
        results, ops = [], []
        for d in docs:
            try:
                self._apply(op, d, known)
            except StatusError as e:
                results.append(WriteResult(d.id, e.code, e.message))
            else:
                results.append(WriteResult(d.id))
                ops.append({"op": op, "id": d.id} if op == "delete" else {"op": op, "id": d.id, "fields": d.fields, "vector": d.vector})
        if ops:
            try:
                self.files.make("oplog")
                self.files.write(f"oplog/{self.sequence:012d}.json", json.dumps({"ops": ops}))
                self.sequence += 1
            except Exception as e:
                self.delta, self.gone, self.by_id, self.writing, self.next_id, self.next_segment = before
                results = [WriteResult(r.id, INTERNAL, f"not logged: {e}") if r.ok else r for r in results]
        return results

    def append_frame(self, rows: DataFrame) -> None:
        """Bulk upsert of rows shaped as sources.jsonl.scan_docs gives them: one new version, nothing through the driver.

        Every row is checked as a single write is, and one bad row fails the whole batch. Of rows with one id the last counts:
        by _order, if there is such a column, else as Spark reads them. Internal ids are numbered in hashed order.
        """
        self._writable()
        rows = rows if "_order" in rows.columns else rows.withColumn("_order", F.monotonically_increasing_id())
        names = [n for n in self.schema.struct().fieldNames() if n != "_doc_id"]
        rows = checked_rows(rows.select(*names, "_order"), self.schema)
        rows = rows.groupBy("id").agg(F.max_by(F.struct(*[n for n in names if n != "id"]), "_order").alias("row")).select("id", "row.*")
        live = self.live().join(rows.select("id"), "id", "left_anti")
        fresh = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(4096)))
        before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over at most 4,096 counts
        sizes = fresh.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")
        total = sizes.agg(F.sum("n")).head()[0] or 0
        number = F.row_number().over(W.partitionBy("part").orderBy("id")) - 1
        fresh = fresh.withColumn("own", number).join(F.broadcast(sizes.drop("n")), "part").withColumn("_doc_id", F.col("own") + F.col("base") + self.next_id)
        width, first = self.options.segment_max_docs, self.next_segment + (self.writing > 0)
        fresh = fresh.withColumn("segment_id", F.floor((F.col("own") + F.col("base")) / width) + first).drop("part", "own", "base")
        if self.writing:
            live = live.withColumn("segment_id", F.when(F.col("segment_id") == 0, self.next_segment).otherwise(F.col("segment_id")))
        self._checkpoint(live.unionByName(fresh.select(live.columns)), next_id=self.next_id + total, next_segment=first + -(-total // width))

    # --- schema and maintenance --------------------------------------------------------------------------------------

    def flush(self) -> None:
        self._writable()
        self._checkpoint()

    def optimize(self) -> None:
        """All live rows in order of their internal ids, re-cut into full segments; ids stay."""
        self._writable()
        self._checkpoint(recut(self.live(), self.options.segment_max_docs))
        self.next_segment = max((s["segment_id"] for s in self.segments), default=0) + 1

    def create_index(self, name: str, kind: str, params: Any = None) -> None:
        self._writable()
        if name == self.schema.vector.name:
            if kind not in (FLAT, HNSW, IVF):
                raise invalid("a scalar index needs a scalar field")
            schema = self.schema.with_indexes(self.schema.vector.indexes.enable(kind, params))
        else:
            if self.schema.field(name) and kind in (FLAT, HNSW, IVF):
                raise invalid("vector indexes need the vector field")
            schema = self.schema.with_scalar_index(name, True)
        self._checkpoint(schema=schema)

    def drop_index(self, name: str, kind: str) -> None:
        self._writable()
        if name == self.schema.vector.name:
            if kind not in (FLAT, HNSW, IVF):
                raise invalid("a scalar index needs a scalar field")
            schema = self.schema.with_indexes(self.schema.vector.indexes.drop(kind))
        else:
            schema = self.schema.with_scalar_index(name, False)
        self._checkpoint(schema=schema)

    def _migrate(self, schema: Schema, rows: DataFrame) -> None:
        self._checkpoint(rows.select(schema.struct().add("segment_id", "long").fieldNames()), schema)

    def add_column(self, f: ScalarField) -> None:
        """Existing rows get the default, or an explicit null."""
        self._writable()
        check_field(f)
        schema = self.schema.add(f)
        value = None if f.default is MISSING else f.default
        rows = self.live().withColumn(f"f_{f.name}", F.lit(value).cast(SPARK_TYPES[f.type]))
        self._migrate(schema, rows)

    def rename_column(self, old: str, new: str) -> None:
        self._writable()
        schema = self.schema.rename(old, new)
        rows = self.live().withColumnRenamed(f"f_{old}", f"f_{new}")
        rows = rows.withColumn("_missing", F.transform("_missing", lambda n: F.when(n == old, F.lit(new)).otherwise(n)))
        self._migrate(schema, rows)

    def drop_column(self, name: str) -> None:
        self._writable()
        schema = self.schema.without(name)
        rows = self.live().drop(f"f_{name}").withColumn("_missing", F.array_remove("_missing", name))
        self._migrate(schema, rows)


def checked_rows(rows: DataFrame, schema: Schema) -> DataFrame:
    """rows, with the checks of single writes as expressions: the first row that fails one fails the read."""
    vector, pk = F.col("vector"), F.col(f"f_{schema.primary_key}")
    tests = [
        (F.col("id").isNull() | (F.col("id") == ""), "document ids are non-empty strings"),
        (vector.isNull() | (F.size("vector") != schema.vector.dimension), f"vectors have {schema.vector.dimension} dimensions"),
        (F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "vector parts must be finite"),
        *((F.col(f"f_{f.name}").isNull(), f"field {f.name} is required") for f in schema.fields if not f.nullable),
        (pk != F.col("id"), "the primary key must equal the document id"),
    ]
    bad = F.lit(None).cast("string")
    for failed, message in reversed(tests):
        bad = F.when(failed, F.lit(message)).otherwise(bad)
    return rows.withColumn("id", F.when(bad.isNull(), F.col("id")).otherwise(F.raise_error(bad).cast("string")))


def segment_meta(rows: DataFrame, indexed: list[ScalarField] = ()) -> DataFrame:
    """Per segment the least and largest internal id and the number of rows, and the ranges of indexed fields."""
    ranges = []
    for f in indexed:
        value = F.col(f"f_{f.name}")
        value = F.when(~F.isnan(value), value) if f.type == FLOAT64 else value  # NaN fails every test of a prefilter
        ranges += [F.min(value).alias(f"low_{f.name}"), F.max(value).alias(f"high_{f.name}")]
    return rows.groupBy("segment_id").agg(F.min("_doc_id").alias("min_id"), F.max("_doc_id").alias("max_id"), F.count("*").alias("doc_count"), *ranges).orderBy("segment_id")


def segment_entry(row: Any, indexed: list[ScalarField]) -> dict:
    """A segment's entry in the manifest."""
    entry = {k: row[k] for k in ("segment_id", "min_id", "max_id", "doc_count")}
    return entry | ({"ranges": {f.name: [row[f"low_{f.name}"], row[f"high_{f.name}"]] for f in indexed}} if indexed else {})


def recut(rows: DataFrame, width: int, id_col: str = "_doc_id") -> DataFrame:
    """segment_id = floor(position / width) + 1, with positions in order of ids.

    Positions come from counts of id ranges and a row number within each range, never from one global window.
    """
    span = F.floor(F.col(id_col) / (1 << 14))
    rows = rows.withColumn("__span", span)
    before = W.orderBy("__span").rowsBetween(W.unboundedPreceding, -1)  # over one row for each 16,384 ids
    counts = rows.groupBy("__span").agg(F.count("*").alias("n")).select("__span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(W.partitionBy("__span").orderBy(id_col)) - 1
    rows = rows.withColumn("__own", own).join(counts, "__span")
    return rows.withColumn("segment_id", (F.floor((F.col("__own") + F.col("__base")) / width) + 1).cast("long")).drop("__own", "__base", "__span")
