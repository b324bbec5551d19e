"""N-gram Jaccard join by PartEnum signatures.

Documents become sets of distinct 5-word shingles. Sizes fall into bands [l, floor(l / 0.8)], so partners are in the
same or the next band. Within two such bands, linked sets differ in at most k elements. The feature domain is split into
n1 partitions of three parts each; by the pigeonhole principle some partition holds at most one of the k differences, so
two of its three parts agree: every subset of two parts is a signature. Signatures of empty subsets are only needed by
sets with so many of them that all agreeing subsets could be empty, and only such sets emit them. There are k / 16 more
partitions than that needs, so that linked sets agree in several: pairs that agree in fewer are never verified.

What is linked are sets, named by 64 bits, whatever documents hold them: a set is one however many copies it has. About 0.9
signatures of 15 bytes per shingle go through one shuffle; candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinion.llm.bloom import thinning
from pinion.llm.common import U64, cut, join_hot, mix, parts_for, set_key, shingle_set, small, table
from pinion.llm.linking import UPPER, linked_components, signature_blobs

WIDTH, PERCENT = 5, 80
#: Bytes of signatures that one task joins.
PART_BYTES, SIGNATURE_BYTES = 16_000_000, 15


class Bands:
    """Size bands for a similarity of num / 100, and k and n1 of the pair of bands (i, i + 1)."""

    def __init__(self, percent: int, largest: int):
        first, last, low = [], [], 1
        while low <= largest:
            first.append(low)
            last.append(low * 100 // percent)
            low = last[-1] + 1
        self.first, self.last = np.array([*first, low]), np.array([*last, low * 100 // percent])
        both = self.last + self.last * 100 // percent  # the largest two sizes that can be linked here
        self.k = both * (100 - percent) // (100 + percent)
        self.n1 = self.k // 2 + 1 + self.k // 16

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, side="right") - 1


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per signature the place of its set, the signature, and its need: a linked partner of the other sets of these two bands
    shares at least so many (127 at most), plus UPPER for a set of the upper band. Sets are sorted distinct hashes; empty ones
    have none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    none = np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.uint8)
    if not sizes.sum():
        return none
    bands = Bands(percent, int(sizes.max()))
    h = np.concatenate(sets)
    content, high, low = mix(h), h >> U64(32), ((h & U64(0xFFFFFFFF)) * U64(3)) >> U64(32)
    place, sig, need = [], [], []
    for upper in (0, 1):
        inst = bands.of(np.maximum(sizes, 1)) - upper
        ok = (sizes > 0) & (inst >= 0)
        ok &= bands.k[np.maximum(inst, 0)] > 0  # without a difference only equal sets are linked, and these are one
        n1 = np.where(ok, bands.n1[np.maximum(inst, 0)], 0)
        if not n1.any():
            continue
        base, each = np.cumsum(n1) - n1, np.repeat(np.arange(len(sets)), sizes)
        live = ok[each]
        e = each[live]
        cell = ((base[e] + ((high[live] * n1[e].astype(U64)) >> U64(32)).astype(np.int64)) * 3) + low[live].astype(np.int64)
        cells = int(n1.sum()) * 3
        c, own = np.bincount(cell, minlength=cells), content[live]
        total = np.bincount(cell, (own & U64(0xFFFFFFFF)).astype(np.float64), cells).astype(U64)
        total += np.bincount(cell, (own >> U64(32)).astype(np.float64), cells).astype(U64) << U64(32)
        c, total = c.reshape(-1, 3), total.reshape(-1, 3)
        left, kept = c.sum(1, keepdims=True) - c, total.sum(1, keepdims=True, dtype=U64) - total  # without one part of three
        who = np.repeat(np.arange(len(sets)), n1)
        hollow = np.bincount(who, (left == 0).any(1), len(sets))
        sure = n1 - bands.k[np.maximum(inst, 0)] // 2 - hollow
        least = (np.clip(sure, 1, 127) + upper * UPPER).astype(np.uint8)
        poor = (sure <= 0)[who]
        name = (inst[who].astype(U64) << U64(40)) + (np.arange(len(who)) - base[who]).astype(U64) * U64(4)
        name = mix(name[:, None] + np.arange(3, dtype=U64)[None, :])
        full = mix(mix(kept + left.astype(U64)) + name)
        keep = (left > 0) | poor[:, None]
        owner = np.broadcast_to(who[:, None], keep.shape)[keep]
        place.append(owner)
        sig.append(full[keep])
        need.append(least[owner])
    return (np.concatenate(place), np.concatenate(sig), np.concatenate(need)) if sig else none


def sign(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sets = [shingle_set(t, WIDTH) for t in texts]
    keys = np.array([set_key(s) for s in sets], np.int64)
    _, first = np.unique(keys, return_index=True)
    once = np.zeros(len(sets), bool)
    once[first] = True
    none = np.empty(0, U64)
    at, sig, need = signatures([s if once[i] else none for i, s in enumerate(sets)])
    return at, sig, keys, need


def sets_of(docs: DataFrame) -> DataFrame:
    """(id, text) -> (id, n, key): the number of shingles and the key of the set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set(t, WIDTH) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())], names=["id", "n", "key"])

    return docs.mapInArrow(count, "id long, n long, key long")


def texts_of(docs: DataFrame, least: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, text) of the sets with these keys, where id is the key; least: (key, low), the least document of each set.
    Documents are thinned out before anything is shuffled."""
    may_be = thinning(least.join(keys.withColumnRenamed("id", "key"), "key").select("low"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(may_be(batch.column(0).to_numpy(zero_copy_only=False))))
            for s in range(0, len(texts), 1024):
                part = texts.slice(s, 1024)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(shingle_set(t, WIDTH)) for t in part.to_pylist()], pa.int64()), part], names=["id", "text"])

    return docs.mapInArrow(keep, "id long, text string").dropDuplicates(["id"])  # any text of a set has its shingles


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the least id reachable by links, itself included).

    Null, empty and wordless texts have no shingles and are linked with nothing; rows with a null id are returned with a
    null component and take no part. Rows are taken as they are: rows that repeat or share an id come back each, with the
    component of its own text. Very long texts are read whole. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = cut(sets_of(rows))
    named = sets.where("id IS NOT NULL AND n > 0")
    total, count = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    real = rows.where("id IS NOT NULL AND text IS NOT NULL")
    blobs = signature_blobs(real, sign, parts_for(docs.sparkSession, total * 9 // 10 * SIGNATURE_BYTES, PART_BYTES))
    least = cut(named.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies")))
    labels = linked_components(blobs, lambda keys: texts_of(real, least, keys), lambda t: shingle_set(t, WIDTH), PERCENT)
    of = cut(least.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("component", "key")))
    roots = of.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("sets"))
    of = join_hot(of.select("key", "root", "copies"), roots, "root", "sets", count).select("key", "copies", "component_id")
    alone = sets.where("id IS NULL OR n = 0").select("id", "n", F.when(F.col("id").isNotNull(), F.col("id")).alias("component_id"))
    out = join_hot(named, of, "key", "copies", count).select("id", "n", "component_id").union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
one AS MATERIALIZED (SELECT min(doc_id) AS doc_id, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM one),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * k >= 80 * (n + m - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, dst) AS (SELECT doc_id, doc_id FROM one UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.dst = l.a),
least AS MATERIALIZED (SELECT s, low FROM one JOIN (SELECT id, min(dst) AS low FROM reach GROUP BY id) ON doc_id = id)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(low, d.doc_id) AS component_id FROM (SELECT doc_id, list_sort(s) AS s FROM sets) d LEFT JOIN least ON d.s = least.s
"""
