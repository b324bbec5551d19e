"""From raw documents to packed token sequences: language ID, line dedup, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as Parquet
in the folder that the cluster shares, and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinion.llm.common import cut, delete, shared_dir
from pinion.llm.op02_ngram_jaccard import ngram_jaccard_join
from pinion.llm.op05_language_id import HELD_OUT, UNDETERMINED, fit, language_id
from pinion.llm.op06_line_dedup import line_dedup
from pinion.llm.op08_packing import best_fit_packing
from pinion.llm.op09_bpe import default_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told at all: null texts and texts without a letter go, clean ones stay.

    Rows are judged by their whole text alone, so repeated rows and rows without an id fare alike; without labels to learn from,
    a letter is enough. An empty table stays empty; columns beside those of documents are left out.
    """
    net = fit(docs.where(f"NOT {HELD_OUT}"))
    if not net.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return language_id(docs.select(*COLUMNS), net).where(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal lines one stays; documents that lose lines and have nothing but blank ones left go.

    Rows with a null id or text stay as they are; rows that share an id are documents of their own, and rows that agree in id and
    text keep and lose the same lines. An empty table stays empty; columns beside those of documents are left out.
    """
    rows = line_dedup(docs.select(*COLUMNS)).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return rows.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies the one with the least id stays, and of those with one id that of the least row hash.

    Rows count as documents by id and text: rows that share an id are told apart, rows that agree in both are one, and one
    of them stays; null ids come after all others. Null, empty and wordless texts have no copies but rows that agree with
    them. An empty table stays empty; columns beside those of documents are left out.
    """
    rows = docs.select(*COLUMNS).withColumn("__row", F.xxhash64("doc_id", "text"))
    groups = ngram_jaccard_join(rows.select("__row", "text"), "__row").groupBy("__row").agg(F.first("component_id").alias("component"), F.count("*").alias("copies"))
    groups = cut(groups.join(rows.groupBy("__row").agg(F.min("doc_id").alias("id")), "__row"))
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("m")).select("component", F.col("m.__row").alias("kept"))
    gone = cut(groups.join(first, "component").where("__row <> kept").select("__row"))
    out = rows.join(gone, "__row", "left_anti")
    if not groups.where("copies > 1").isEmpty():
        out = out.dropDuplicates(["__row"])
    return out.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row with their sequence and place: null and empty texts are their end token, long ones are cut,
    repeated rows are packed each, null ids stay null. An empty table gives no pieces; other columns are ignored."""
    return best_fit_packing(docs, default_vocabulary())


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("best_fit_packing", pack),
]
#: SQL has none of a trained network, MinHash components or bin completion; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages before it wrote is deleted once the last one is written."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    for name, _ in STAGES[:-1]:
        delete(spark, f"{at}/{name}")
    return docs
