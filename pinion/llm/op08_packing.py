"""Best-fit packing by bin completion.

Documents become pieces of at most CAPACITY tokens; only their lengths matter to the packing, so the driver sees one
histogram of at most CAPACITY rows. packing.pack() turns it into fillings with multiplicities, and the executors deal the
pieces of each length over the slots that the fillings have for it: a piece's rank among its length's pieces (counted in
hashed sub-groups, so that a frequent length is no single task) selects its slot. Two small shuffles, no text in them.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinion.llm.bpe import Recurring, Vocabulary
from pinion.llm.common import cut, small, table
from pinion.llm.op09_bpe import default_vocabulary
from pinion.llm.packing import pack

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that one task ranks, about.
RANKED = 50_000
PIECES = "piece int, start long, length long, ids_crc32 long"


class TextIds:
    """Ids by the tokenizers library; what stands between white space is encoded once and remembered."""

    def __init__(self, vocabulary: str):
        v = self.vocabulary = Vocabulary(vocabulary)
        self.tokenize = v.library.model.tokenize
        self.known = Recurring(self.chunk, 120_000, 60_000)

    def chunk(self, chunk: str) -> bytes:
        v, tokenize = self.vocabulary, self.tokenize
        if chunk.isascii() and chunk.isprintable():  # its own byte level
            words = (chunk,) if chunk.isalpha() else v.split(chunk)
        else:
            words = map(v.level, v.split(chunk))
        return array("I", [t.id for w in words for t in tokenize(w)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if "<|" in text or not self.vocabulary.plain(text):  # special tokens and rare characters: the library's own steps
            return array("I", self.vocabulary.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.known.__getitem__, text.lower().split()))


_ids: dict[str, TextIds] = {}


def text_ids(vocabulary: str) -> TextIds:
    if vocabulary not in _ids:
        _ids[vocabulary] = TextIds(vocabulary)
    return _ids[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and END_ID, cut every `capacity` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = text_ids(vocabulary), array("I", [END_ID]).tobytes()
        for batch in small(batches):
            who, rows = [], [array("q") for _ in range(4)]
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, text in zip(keys, texts, strict=True):
                ids = ids_of.encode(text) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    who.append(key)
                    for col, x in zip(rows, (n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(x)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), *(pa.array(np.frombuffer(r, np.int64), t) for r, t in zip(rows, types, strict=True))], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id long, {PIECES}")


def slots(fillings: list[tuple[tuple[int, ...], int]]) -> list[np.ndarray]:
    """Per length: first rank, first sequence, copies in a bin, and where the first copy begins; sorted by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, n in fillings:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            k = filling.count(length)
            rows.append((length, taken.get(length, 0), sequence, k, offset))
            taken[length] = taken.get(length, 0) + n * k
            offset += k * length
        sequence += n
    return [np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)] if rows else [np.empty(0, np.int64)] * 5


def ranked(rows: DataFrame, by: str, total: int, order: list[str]) -> DataFrame:
    """rows with a gapless rank (from 0) within each value of `by`, counted in hashed sub-groups of bounded size."""
    subs = max(1, -(-total // RANKED))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64(*order), F.lit(subs)))
    sizes = rows.groupBy(by, "sub").agg(F.count("*").alias("n"))
    before = W.partitionBy(by).orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(by, "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy(by, "sub").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(sizes, [by, "sub"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "sub")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone; a text longer than the capacity is cut, whole. Rows that repeat are packed
    each; a null id stays null; pieces of one length are alike, so ties between them are of no account. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, vocabulary, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))  # the checkpoint fixes the numbers
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(pack(counts, capacity)))
    dealt = ranked(rows, "length", sum(counts.values()), ["row"])
    dealt = dealt.select("id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, copies, offset = plan.value
        at = length * (1 << 40) + first
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(at, n * (1 << 40) + rank, side="right") - 1
            own = rank - first[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[k] + own // copies[k]), pa.array(offset[k] + own % copies[k] * n)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return dealt.mapInArrow(place, f"id long, {PIECES}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), default_vocabulary())
