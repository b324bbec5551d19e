"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinion.collection import Collection, Database, recut, segment_meta
from pinion.functions.metrics import cosine, dot, l2_norm, score, squared_l2
from pinion.operators.flat import exact_top_k, merge_top_k, top_k_per
from pinion.operators.hnsw import Graph
from pinion.operators.ivf import assign, build_lists, centroid_means
from pinion.plans.filters import check, compile_filter, parse
from pinion.plans.planner import HnswSearch, IvfSearch, SegmentCounts, VectorQuery, widened_probe
from pinion.schema import BOOL, COSINE, HNSW, INNER_PRODUCT, INT64, IVF, L2, STRING, Doc, HnswParams, IvfParams, Options, ScalarField, Schema, VectorField
from pinion.sources.files import Files

QUERY_ID, K = 7, 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DOCS = Schema(
    "emb_docs",
    "pk",
    (ScalarField("pk", STRING), ScalarField("lang", STRING), ScalarField("source", STRING, indexed=True), ScalarField("n_chars", INT64), ScalarField("label", INT64), ScalarField("quality", INT64, nullable=True)),
    VectorField("embedding", 64, COSINE),
)


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def filtered(rows: DataFrame, text: str) -> DataFrame:
    """rows with the columns of DOCS, by a filter of the collection language."""
    tree = parse(text)
    check(tree, DOCS)
    return rows.where(compile_filter(tree, DOCS, column=F.col))


def asked(spark: SparkSession, d: str, vec_id: int = QUERY_ID) -> DataFrame:
    """The query vector: one row."""
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("qv"))


def with_query(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return rows.crossJoin(F.broadcast(asked(spark, d)))


def nearest(rows: DataFrame, spark: SparkSession, d: str, metric: str, k: int = K, id_col: str = "vec_id") -> DataFrame:
    return exact_top_k(with_query(rows, spark, d), metric, F.col("qv"), k, "embedding", id_col, "score").select(id_col, "score")


def emb_docs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return e.join(docs, e["vec_id"] == docs["doc_id"]).drop("doc_id")


Q = "(SELECT embedding::double[] FROM embeddings WHERE vec_id = 7)"
DUCK = {
    COSINE: f"(CASE WHEN list_dot_product(embedding::double[], embedding::double[]) = 0 THEN 0 ELSE list_cosine_similarity(embedding::double[], {Q}) END)::float",
    INNER_PRODUCT: f"list_dot_product(embedding::double[], {Q})::float",
    L2: f"(-list_distance(embedding::double[], {Q}) + 0.0)::float",
}
DOCS_SQL = "(SELECT e.vec_id, e.embedding, e.label::bigint AS label, lang, source, n_chars FROM embeddings e JOIN documents ON vec_id = doc_id)"


def knn_sql(source: str, metric: str, where: str = "true", k: int = K) -> str:
    return f"SELECT vec_id, {DUCK[metric]} AS score FROM {source} WHERE {where} ORDER BY score DESC, vec_id LIMIT {k}"


for _name, _metric in (("knn_cosine", COSINE), ("knn_ip", INNER_PRODUCT), ("knn_l2", L2)):
    query(_name, knn_sql("embeddings", _metric))(lambda s, d, m=_metric: nearest(table(s, d, "embeddings"), s, d, m))


@query("knn_by_id", knn_sql("embeddings", COSINE, k=5))
def knn_by_id(spark: SparkSession, d: str) -> DataFrame:
    """By a stored vector's id; the source itself is a hit."""
    return nearest(table(spark, d, "embeddings"), spark, d, COSINE, 5)


FILTERS = {
    "knn_filtered_and": ("lang = 'en' AND n_chars >= 500", "lang = 'en' AND n_chars >= 500"),
    "knn_filtered_or": ("lang = 'fr' OR label = 3", "lang = 'fr' OR label = 3"),
    "knn_filtered_ne": ("lang != 'en'", "lang IS DISTINCT FROM 'en'"),
    "knn_filtered_range": ("n_chars > 200 AND n_chars < 4000 AND label <= 5", "n_chars > 200 AND n_chars < 4000 AND label <= 5"),
    "knn_filtered_like_exact": ("source LIKE 'src1'", "source = 'src1'"),
    "knn_filtered_like_prefix_suffix": ("source LIKE 'src1%1'", "starts_with(source, 'src1') AND ends_with(source, '1')"),
    "knn_filtered_contains": ("source CONTAINS 'c1'", "contains(source, 'c1')"),
    "knn_filtered_grouping": ("(lang = 'de' OR lang = 'es') AND n_chars >= 100", "(lang = 'de' OR lang = 'es') AND n_chars >= 100"),
}
for _name, (_filter, _where) in FILTERS.items():
    query(_name, knn_sql(DOCS_SQL, COSINE, _where))(lambda s, d, f=_filter: nearest(filtered(emb_docs(s, d), f), s, d, COSINE))


def labelled_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the quality of their label, if any: an explicit null where there is none."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(labels, "doc_id", "left").withColumn("_missing", F.array().cast("array<string>"))


LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("filter_ne_null", f"SELECT doc_id, lang FROM {LABELLED} WHERE quality IS DISTINCT FROM 1")
def filter_ne_null(spark: SparkSession, d: str) -> DataFrame:
    return filtered(labelled_docs(spark, d), "quality != 1").select("doc_id", "lang")


@query("filter_is_null", f"SELECT doc_id, lang FROM {LABELLED} WHERE quality IS NULL")
def filter_is_null(spark: SparkSession, d: str) -> DataFrame:
    return filtered(labelled_docs(spark, d), "quality IS NULL").select("doc_id", "lang")


@query("filter_pushdown", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000 AND starts_with(source, 'src1')")
def filter_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """Tests on required fields reach the Parquet scan, and only their columns are read."""
    return filtered(table(spark, d, "documents"), "lang = 'en' AND n_chars > 1000 AND source LIKE 'src1%'").select("doc_id", "source", "n_chars")


@query("live_after_delete", knn_sql("(SELECT e.* FROM embeddings e ANTI JOIN labels l ON e.vec_id = l.doc_id)", COSINE))
def live_after_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"))
    return nearest(table(spark, d, "embeddings").join(gone, "vec_id", "left_anti"), spark, d, COSINE)


@query("fetch_ids", "SELECT vec_id, label, 0.0::float AS score FROM embeddings WHERE vec_id IN (3, 1, 4, 15, 92, 999999)")
def fetch_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = [3, 1, 4, 1, 15, 92, 999999]  # repeated ids count once, unknown ones are left out
    return table(spark, d, "embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", "label", F.lit(0.0).cast("float").alias("score"))


def latest(rows: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The last version of every key, as an aggregate: a frequent key is combined map-side."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(version, *columns), version).alias("v"))
    return last.select(key, f"v.{version}", *(f"v.{c}" for c in columns))


@query("latest_version", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """Upserts by user, in order of event_id."""
    return latest(table(spark, d, "events"), "user_id", "event_id", ["event_type", "value"])


@query("update_merge", "SELECT d.doc_id, coalesce(l.quality::bigint, d.n_chars) AS n_chars, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def update_merge(spark: SparkSession, d: str) -> DataFrame:
    """A partial update: labels overwrite n_chars where they have a value."""
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("new"))
    return table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(new, "doc_id", "left").select("doc_id", F.coalesce("new", "n_chars").alias("n_chars"), "lang")


@query("delete_by_filter", f"SELECT doc_id, source FROM {LABELLED} WHERE NOT coalesce(quality = 1 OR lang = 'de', false)")
def delete_by_filter(spark: SparkSession, d: str) -> DataFrame:
    tree = parse("quality = 1 OR lang = 'de'")
    check(tree, DOCS)
    return labelled_docs(spark, d).where(~compile_filter(tree, DOCS, column=F.col)).select("doc_id", "source")


WIDTH = 128
SEGMENTS_SQL = f"(SELECT *, (floor((row_number() OVER (ORDER BY vec_id) - 1) / {WIDTH}) + 1)::bigint AS segment_id FROM embeddings)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    return recut(table(spark, d, "embeddings"), WIDTH, "vec_id")


@query("stats", f"SELECT count(*) AS doc_count, count(DISTINCT segment_id) + 1 AS segment_count FROM {SEGMENTS_SQL}")
def stats(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d)
    return rows.groupBy("segment_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("doc_count"), (F.count("*") + 1).alias("segment_count"))


@query("segment_meta", f"SELECT segment_id, min(vec_id) AS min_id, max(vec_id) AS max_id, count(*) AS doc_count FROM {SEGMENTS_SQL} GROUP BY segment_id")
def segment_meta_query(spark: SparkSession, d: str) -> DataFrame:
    return segment_meta(segments(spark, d).withColumnRenamed("vec_id", "_doc_id"))


@query("optimize_layout", f"SELECT vec_id, segment_id FROM (SELECT *, (floor((row_number() OVER (ORDER BY vec_id) - 1) / {WIDTH}) + 1)::bigint AS segment_id FROM (SELECT e.* FROM embeddings e ANTI JOIN labels l ON e.vec_id = l.doc_id))")
def optimize_layout(spark: SparkSession, d: str) -> DataFrame:
    """Compaction: live rows only, re-cut."""
    gone = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"))
    return recut(table(spark, d, "embeddings").join(gone, "vec_id", "left_anti"), WIDTH, "vec_id").select("vec_id", "segment_id")


@query("segment_topk", f"SELECT segment_id, vec_id, {DUCK[L2]} AS score FROM {SEGMENTS_SQL} QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, vec_id) <= 3")
def segment_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = with_query(segments(spark, d), spark, d).withColumn("score", score(L2, F.col("embedding"), F.col("qv")))
    return top_k_per(rows.select("segment_id", "vec_id", "score"), "segment_id", 3, [F.desc("score"), "vec_id"])


@query("segment_topk_merge", knn_sql("embeddings", L2))
def segment_topk_merge(spark: SparkSession, d: str) -> DataFrame:
    """The k best of every segment with ties, merged by public id: equal to the global answer."""
    rows = with_query(segments(spark, d), spark, d).withColumn("score", score(L2, F.col("embedding"), F.col("qv")))
    hits = top_k_per(rows.select("segment_id", "vec_id", "score"), "segment_id", K, [F.desc("score")], keep_ties=True)
    return merge_top_k(hits, K, "score", "vec_id").select("vec_id", "score")


@query("segment_counts", f"SELECT segment_id, count(*) AS stored, count(*) FILTER (doc_id IS NULL) AS visible, count(*) FILTER (doc_id IS NULL AND label <= 4) AS allowed FROM {SEGMENTS_SQL} s LEFT JOIN labels l ON s.vec_id = l.doc_id GROUP BY segment_id")
def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    """What budget widening looks at: rows stored, visible and allowed by the prefilter, per segment."""
    rows = segments(spark, d).join(table(spark, d, "labels").select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left")
    up = F.col("doc_id").isNull()
    return rows.groupBy("segment_id").agg(F.count("*").alias("stored"), F.count_if(up).alias("visible"), F.count_if(up & (F.col("label") <= 4)).alias("allowed"))


@query("prefilter_postings", "SELECT source, doc_id // 4096 AS block, count(*) AS n, list(doc_id ORDER BY doc_id) AS ids FROM documents WHERE n_chars < 200 GROUP BY source, block")
def prefilter_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings in blocks of 4,096 ids, so that a frequent value is no single row."""
    rows = table(spark, d, "documents").where("n_chars < 200").withColumn("block", F.floor(F.col("doc_id") / 4096))
    return rows.groupBy("source", "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids"))


@query("prefilter_intersection", "SELECT doc_id FROM documents WHERE source = 'src3' INTERSECT SELECT doc_id FROM documents WHERE n_chars >= 1000")
def prefilter_intersection(spark: SparkSession, d: str) -> DataFrame:
    """The AND of two posting sets is one predicate: one scan, no join."""
    return filtered(table(spark, d, "documents"), "source = 'src3' AND n_chars >= 1000").select("doc_id")


CENTROIDS_SQL = "(SELECT label AS list, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroid_means(table(spark, d, "embeddings"), "label", "embedding")


@query("ivf_centroids", CENTROIDS_SQL.replace("list(m ORDER BY pos)", "list(round(m, 9) + 0.0 ORDER BY pos)")[1:-1])
def ivf_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids(spark, d).withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 9) + F.lit(0.0)))


@query("ivf_assign", f"SELECT vec_id, list FROM (SELECT vec_id, list, list_dot_product(embedding::double[], centroid) AS s FROM embeddings, {CENTROIDS_SQL}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, list) = 1")
def ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    return assign(table(spark, d, "embeddings"), centroids(spark, d), dot, "vec_id", "embedding")


PROBED_SQL = f"(SELECT list FROM {CENTROIDS_SQL} ORDER BY list_dot_product(centroid, {Q}) DESC, list LIMIT 3)"


@query("ivf_probe", f"SELECT vec_id, {DUCK[INNER_PRODUCT]} AS score FROM embeddings WHERE label IN {PROBED_SQL} ORDER BY score DESC, vec_id LIMIT {K}")
def ivf_probe(spark: SparkSession, d: str) -> DataFrame:
    ranked = with_query(centroids(spark, d), spark, d).orderBy(F.desc(dot(F.col("centroid"), F.col("qv"))), "list").limit(3)
    rows = table(spark, d, "embeddings").join(F.broadcast(ranked.select(F.col("list").alias("label"))), "label", "left_semi")
    return nearest(rows, spark, d, INNER_PRODUCT)


@query("ivf_residual_bound", f"SELECT list, round(max(list_distance(embedding::double[], centroid)), 6) AS bound FROM embeddings JOIN {CENTROIDS_SQL} ON label = list GROUP BY list")
def ivf_residual_bound(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").join(centroids(spark, d), F.col("label") == F.col("list"))
    return rows.groupBy("list").agg(F.round(F.max(F.sqrt(squared_l2(F.col("embedding"), F.col("centroid")))), 6).alias("bound"))


def bounded_ivf(spark: SparkSession, d: str, metric: str, probes: int = 2) -> DataFrame:
    """Two passes: the k-th score of the probed lists, then every list whose bound reaches it. Exact for L2 and inner product."""
    rows, q = with_query(table(spark, d, "embeddings"), spark, d), F.col("qv")
    stats = rows.join(centroids(spark, d), F.col("label") == F.col("list"))
    residual = F.max(F.sqrt(squared_l2(F.col("embedding"), F.col("centroid"))))
    lists = stats.groupBy("list").agg(F.first("centroid").alias("centroid"), residual.alias("residual"))
    lists = with_query(lists, spark, d)
    if metric == L2:
        bound: Column = -F.greatest(F.lit(0.0), F.sqrt(squared_l2(F.col("centroid"), q)) - F.col("residual"))
    else:
        bound = dot(F.col("centroid"), q) + l2_norm(q) * F.col("residual")
    lists = lists.select("list", score(metric, F.col("centroid"), q).alias("near"), (bound + 1e-6).alias("bound"))
    lists = lists.withColumn("rank", F.row_number().over(W.orderBy(F.desc("near"), "list")))  # one row per list
    scored = rows.select("vec_id", "label", score(metric, F.col("embedding"), q).alias("score"))
    first = scored.join(F.broadcast(lists.where(F.col("rank") <= probes)), F.col("label") == F.col("list"), "left_semi")
    cut = first.orderBy(F.desc("score")).limit(K).agg(F.min("score").alias("cut"), F.count("*").alias("n"))
    wanted = lists.crossJoin(F.broadcast(cut)).where(f"rank <= {probes} OR n < {K} OR bound >= cut")
    hits = scored.join(wanted.select(F.col("list").alias("label")), "label", "left_semi")
    return hits.orderBy(F.desc("score"), "vec_id").limit(K).select("vec_id", "score")


for _name, _metric in (("ivf_exact_l2", L2), ("ivf_exact_ip", INNER_PRODUCT)):
    query(_name, knn_sql("embeddings", _metric))(lambda s, d, m=_metric: bounded_ivf(s, d, m))

def mean_sql(rows: str, by: str) -> str:
    """(by..., m): means of the vectors e of rows."""
    return f"SELECT {by}, list(a ORDER BY pos) AS m FROM (SELECT {by}, pos, avg(x) AS a FROM (SELECT {by}, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM {rows}) GROUP BY {by}, pos) GROUP BY {by}"


def assigned_sql(centroids: str) -> str:
    return f"SELECT segment_id, vec_id, e, list FROM v JOIN {centroids} USING (segment_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, m), list) = 1"


@query(
    "ivf_train",
    f"""WITH v AS MATERIALIZED (SELECT segment_id, vec_id, embedding::double[] AS e FROM {SEGMENTS_SQL}), mean AS ({mean_sql("v", "segment_id")}),
    s0 AS MATERIALIZED (SELECT segment_id, vec_id, e AS m FROM v JOIN mean USING (segment_id) QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY list_distance(v.e, mean.m) DESC, vec_id) = 1),
    b0 AS MATERIALIZED (SELECT v.*, list_distance(v.e, s0.m) AS far FROM v JOIN s0 USING (segment_id)),
    s1 AS MATERIALIZED (SELECT segment_id, vec_id, e AS m FROM b0 WHERE vec_id NOT IN (SELECT vec_id FROM s0) QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY far DESC, vec_id) = 1),
    b1 AS MATERIALIZED (SELECT b0.* REPLACE (least(far, list_distance(b0.e, s1.m)) AS far) FROM b0 JOIN s1 USING (segment_id)),
    s2 AS MATERIALIZED (SELECT segment_id, vec_id, e AS m FROM b1 WHERE vec_id NOT IN (SELECT vec_id FROM s0 UNION SELECT vec_id FROM s1) QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY far DESC, vec_id) = 1),
    c0 AS MATERIALIZED (SELECT segment_id, 0 AS list, m FROM s0 UNION ALL SELECT segment_id, 1, m FROM s1 UNION ALL SELECT segment_id, 2, m FROM s2),
    a0 AS MATERIALIZED ({assigned_sql("c0")}), c1 AS MATERIALIZED ({mean_sql("a0", "segment_id, list")}), a1 AS ({assigned_sql("c1")})
    SELECT segment_id, vec_id, list FROM a1""",
)
def ivf_train(spark: SparkSession, d: str) -> DataFrame:
    """Seeding by the farthest row and two rounds of Lloyd's algorithm, in every segment: each row's list."""
    rows = segments(spark, d).select("segment_id", F.col("vec_id").alias("_doc_id"), F.col("embedding").alias("vector"))
    return build_lists(rows, L2, IvfParams(3, 1, 2)).select("segment_id", F.col("_doc_id").alias("vec_id"), "list")


BUDGETS = [(8, 64, 10, 10, 100, 100, 100, 100, False), (8, 64, 10, 80, 100, 100, 80, 40, True), (2, 8, 10, 10, 100, 100, 100, 100, True), (2, 8, 10, 4, 100, 100, 100, 0, True), (2, 8, 1, 4, 10, 10, 10, 5, True), (2, 8, 2, 3, 10, 10, 10, 10, True)]


@query(
    "nprobe_budget",
    "SELECT id, CASE WHEN NOT f AND cand = k AND stored = indexed AND indexed = visible THEN np WHEN populated <= cand THEN populated WHEN indexed > visible THEN populated WHEN allowed = 0 THEN populated "
    "WHEN allowed < visible THEN least(populated, ceil(np * visible / allowed)) ELSE least(populated, ceil(np * cand / k)) END::bigint AS n_probe FROM (VALUES "
    + ", ".join(f"({i}, {', '.join(map(str, b))})" for i, b in enumerate(BUDGETS))
    + ") t(id, np, populated, k, cand, stored, indexed, visible, allowed, f)",
)
def nprobe_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, widened_probe(b[0], b[1], b[2], b[3], SegmentCounts(*b[4:8]), "AdaptiveFiltered" if b[8] else "Requested")) for i, b in enumerate(BUDGETS)]
    return spark.createDataFrame(rows, "id int, n_probe long")


@query("hnsw_full_ef", knn_sql("embeddings", INNER_PRODUCT))
def hnsw_full_ef(spark: SparkSession, d: str) -> DataFrame:
    """Graphs over segments, searched with ef >= their size: the merged answer is the exact one while graphs are connected."""
    import pandas as pd

    rows = segments(spark, d)
    q = np.array(asked(spark, d).head()["qv"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        g = Graph(INNER_PRODUCT, np.stack(pdf["embedding"].to_list()), pdf["vec_id"].to_numpy(), HnswParams(ef_construction=32)).build()
        return pd.DataFrame({"vec_id": [i for i, _ in g.search(q, K, len(pdf))]}, dtype="int64")

    hits = rows.groupBy("segment_id").applyInPandas(search, "vec_id long")
    return nearest(table(spark, d, "embeddings").join(hits, "vec_id", "left_semi"), spark, d, INNER_PRODUCT)


@query("replay_log", "SELECT user_id, event_id, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'refund'")
def replay_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as an operation log: the last operation of a user decides, and a refund deletes."""
    return latest(table(spark, d, "events"), "user_id", "event_id", ["event_type", "value"]).where("event_type <> 'refund'").select("user_id", "event_id", "value")


def doc_rows(spark: SparkSession, d: str) -> DataFrame:
    """emb_docs() shaped for a collection."""
    return emb_docs(spark, d).select(
        F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("string").alias("f_pk"), F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), F.col("n_chars").alias("f_n_chars"),
        F.col("label").alias("f_label"), F.lit(None).cast("long").alias("f_quality"), F.col("embedding").alias("vector"), F.array(F.lit("quality")).alias("_missing"), F.lit(None).cast("string").alias("_extra"),
    )


def fresh_database(spark: SparkSession) -> Database:
    return Database(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_collections/{uuid.uuid4().hex}")


def loaded(spark: SparkSession, d: str, metric: str = COSINE) -> tuple[Database, Collection]:
    """A new collection with all of emb_docs, bulk loaded; segments of 128 documents."""
    db = fresh_database(spark)
    c = db.create_collection(replace(DOCS, vector=VectorField("embedding", 64, metric)), Options(segment_max_docs=128))
    c.append_frame(doc_rows(spark, d))
    return db, c


@contextmanager
def scratch(spark: SparkSession, d: str, metric: str = COSINE) -> Iterator[Collection]:
    """loaded(), and deleted when it has been used: for queries whose result reads no file of it."""
    db, c = loaded(spark, d, metric)
    try:
        with c:
            yield c
    finally:
        Files(spark, db.root).delete("")


def live_rows(c: Collection) -> DataFrame:
    return c.live().select(F.col("id").cast("long").alias("vec_id"), F.col("f_lang").alias("lang"), F.col("f_n_chars").alias("n_chars"))


def hits_of(spark: SparkSession, c: Collection, d: str, **how) -> DataFrame:
    vector = asked(spark, d).head()["qv"]
    hits = c.query(VectorQuery("embedding", K, list(vector), fields=[], **how))
    return spark.createDataFrame([(int(h.id), h.score) for h in hits], "vec_id long, score float")


@query("collection_delete_by_filter", f"SELECT vec_id, lang, n_chars FROM {DOCS_SQL} WHERE NOT (lang = 'de' OR n_chars >= 2000)")
def collection_delete_by_filter(spark: SparkSession, d: str) -> DataFrame:
    """Through the collection API: tombstones as a table, read by an anti join."""
    _, c = loaded(spark, d)
    with c:
        c.delete_by_filter("lang = 'de'")
        c.delete_by_filter("n_chars >= 2000")
        return live_rows(c)


@query("collection_dml", f"SELECT vec_id, CASE WHEN vec_id = 5 THEN 'xx' ELSE lang END AS lang, CASE WHEN vec_id IN (1, 2) THEN 7 ELSE n_chars END AS n_chars FROM {DOCS_SQL} WHERE vec_id <> 3 UNION ALL SELECT -9, 'new', 1")
def collection_dml(spark: SparkSession, d: str) -> DataFrame:
    """Insert, update, upsert and delete, each with a row that fails, then reopened from the operation log."""
    db, c = loaded(spark, d)
    with c:
        old = c.fetch(["5"])["5"]
        new = Doc("-9", {"pk": "-9", "lang": "new", "source": "s", "n_chars": 1, "label": 0}, old.vector)
        c.insert([new, new])
        c.update([Doc("1", {"n_chars": 7}), Doc("2", {"n_chars": 7}), Doc("no such id", {"n_chars": 7})])
        c.upsert([Doc("5", {**old.fields, "lang": "xx"}, old.vector), Doc("6", {}, old.vector)])
        c.delete(["3", "3"])
    with db.open_collection("emb_docs") as c:
        return live_rows(c)


@query("collection_crash", f"SELECT vec_id, lang, n_chars FROM {DOCS_SQL} WHERE lang <> 'fr' AND vec_id <> 4")
def collection_crash(spark: SparkSession, d: str) -> DataFrame:
    """Writes, then a checkpoint that fails just before its commit, with an index to be built; reopened, nothing is lost."""
    db, c = loaded(spark, d)
    with c:
        c.create_index("embedding", IVF, IvfParams(4, 1, 2))
        c.delete_by_filter("lang = 'fr'")
        c.delete(["4"])
        write = c.files.write
        c.files.write = lambda name, text: write(f"no/such\x00/{name}", text)
        with suppress(Exception):
            c.flush()
    with db.open_collection("emb_docs") as c:
        return live_rows(c)


BAD_ROWS = {"id": "''", "f_pk": "'other'", "f_lang": "CAST(NULL AS STRING)", "f_n_chars": "CAST(NULL AS BIGINT)", "vector": "slice(vector, 1, 3)", "vector_nan": "transform(vector, x -> float('nan'))"}


@query("collection_bulk_checks", "SELECT * FROM (VALUES ('as is', true), " + ", ".join(f"('{k}', false)" for k in BAD_ROWS) + ") t(changed, accepted)")
def collection_bulk_checks(spark: SparkSession, d: str) -> DataFrame:
    """Bulk upserts in which one row breaks a rule fail as a whole, and leave the collection as it is."""
    with scratch(spark, d) as c:
        rows, before, out = doc_rows(spark, d), c.version, []
        for name, value in {"as is": "id", **BAD_ROWS}.items():
            column = "id" if name == "as is" else name.removesuffix("_nan")
            try:
                c.append_frame(rows.withColumn(column, F.when(F.col("id") == "7", F.expr(value)).otherwise(F.col(column))))
                out.append((name, c.version == before + 1))
            except Exception:
                out.append((name, c.version != before + 1))
    return spark.createDataFrame(out, "changed string, accepted boolean")


@query("ivf_collection", knn_sql(DOCS_SQL, L2, "lang <> 'de' AND n_chars >= 100").replace("ORDER BY score DESC, vec_id", "ORDER BY score DESC, vec_id::varchar"))
def ivf_collection(spark: SparkSession, d: str) -> DataFrame:
    """Trained lists per segment, probed with bounds, rows deleted since, and a filter: exact for L2."""
    with scratch(spark, d, L2) as c:
        c.create_index("embedding", IVF, IvfParams(8, 2, 3))
        c.delete_by_filter("lang = 'de'")
        return hits_of(spark, c, d, filter="n_chars >= 100", search=IvfSearch(2))


@query("hnsw_collection", knn_sql(DOCS_SQL, INNER_PRODUCT, "lang <> 'de'").replace("ORDER BY score DESC, vec_id", "ORDER BY score DESC, vec_id::varchar"))
def hnsw_collection(spark: SparkSession, d: str) -> DataFrame:
    """Stored graphs per segment, searched with a breadth of a segment's size; deleted rows lead on but are not found."""
    with scratch(spark, d, INNER_PRODUCT) as c:
        c.create_index("embedding", HNSW, HnswParams(ef_construction=32))
        c.delete_by_filter("lang = 'de'")
        return hits_of(spark, c, d, search=HnswSearch(128))


@query("collection_lifecycle", f"SELECT vec_id, {DUCK[COSINE]} AS score FROM {DOCS_SQL} WHERE lang <> 'de' AND n_chars >= 100 ORDER BY score DESC, vec_id::varchar LIMIT {K}")
def collection_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Through the collection API: bulk load, delete by filter, column added and renamed, compaction, filtered query."""
    with scratch(spark, d) as c:
        c.delete_by_filter("lang = 'de'")
        c.add_column(ScalarField("seen", BOOL, default=False))
        c.rename_column("n_chars", "length")
        c.optimize()
        return hits_of(spark, c, d, filter="length >= 100 AND seen = false")
