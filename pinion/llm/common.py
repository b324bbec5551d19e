"""Helpers shared by the corpus operators: lineage cuts, file publishing, word and shingle hashing."""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one beside the warehouse where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


#: Whether Spark deletes the shuffles of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so that a lost executor costs no recomputation.

    The shuffles that led to it go at once: nothing reads them any more, and the driver may not collect garbage for long.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # an execution of its own takes the setting
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def publish(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Puts data in the shared folder and ships it to every executor; the name is for local_copy()."""
    name = f"{hashlib.sha256(data).hexdigest()[:24]}.{suffix}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/published/{name}")
    fs = path.getFileSystem(conf)
    path = fs.makeQualified(path)  # with the store that the session takes a bare path to be in
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    spark.sparkContext.addFile(path.toUri().toString())
    return name


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more from whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def local_copy(name: str) -> str:
    """Where Spark has put a published file on this machine."""
    return os.path.join(SparkFiles.getRootDirectory(), name)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that is free in this process back to the machine: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of so many rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, max(1, len(batch)), rows):
            yield batch.slice(at, rows)
    release()


#: Rows of one key from which a join treats it as hot, and the share of all rows from which it does.
HOT_ROWS, HOT_SHARE = 10_000, 0.001


def join_hot(rows: DataFrame, values: DataFrame, on: str, copies: str, total: int) -> DataFrame:
    """rows joined with values (one row per `on`, with the number of its rows in `copies`), hot keys in no single task.

    Keys with more than HOT_SHARE of the rows are at most 1 / HOT_SHARE, so their values are broadcast; the others are shuffled.
    """
    hot = F.col(copies) > max(HOT_ROWS, int(total * HOT_SHARE))
    few = cut(values.where(hot))
    if few.isEmpty():
        return rows.join(unique(values), on)
    few = F.broadcast(few)
    return rows.join(few, on).unionByName(rows.join(few.select(on), on, "left_anti").join(unique(values.where(~hot)), on))


def unique(values: DataFrame) -> DataFrame:
    """Small rows, one for each key of a join: after the shuffle they are hashed, so that the other side needs no sort. Keys are
    dealt evenly, so a task's table is its share of them."""
    return values.hint("shuffle_hash")


def parts_for(spark: SparkSession, items: int, per_part: int, least: int = 16) -> int:
    """Partitions so that each holds about per_part items, whatever the size of the input."""
    return max(least, -(-int(items) // per_part))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply); a bijection."""
    x = x.astype(U64, copy=True)
    t = x >> U64(30)
    x ^= t
    x *= _M1
    np.right_shift(x, U64(27), out=t)
    x ^= t
    x *= _M2
    np.right_shift(x, U64(31), out=t)
    x ^= t
    return x


_hash = xxhash.xxh3_64_intdigest


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased (bytes.lower and bytes.split treat exactly these)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words than width make one shingle."""
    w = words(text)
    n = len(w)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(_hash, w), U64, n)
    k = min(n, width)
    out = np.full(n - k + 1, U64(k), U64)
    for j in range(k):  # order matters: each step mixes what came before
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j])
    return np.unique(out)


def char_shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's character shingles; a shorter text is one shingle."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    n = len(c)
    if not n:
        return np.empty(0, U64)
    k = left = min(n, width)
    c += U64(1)
    out, done, step = np.zeros(n - k + 1, U64), 0, 1
    while True:  # hashes of 1, 2, 4, ... characters; those that make up k are put together
        power = U64(pow(0x9E3779B97F4A7C15, step, 1 << 64))
        if left & 1:
            out = out * power + c[done : done + n - k + 1]
            done += step
        left >>= 1
        if not left:
            return np.unique(mix(out ^ U64(k)))
        c = c[:-step] * power + c[step:]
        step *= 2


def set_key(s: np.ndarray) -> int:
    """64 bits, as a signed number, that identify a set of hashes."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def similar(inter: int, union: int, percent: int) -> bool:
    return 100 * inter >= percent * union
