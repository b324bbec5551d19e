"""Fuzzy line deduplication by MinHash.

Lines (split at \\n) are compared in lower case with single spaces. Each distinct line's character shingles give BANDS * ROWS
minima by one-permutation hashing (an empty bin borrows from the first full one in an order of its own), bands of these make
high-recall buckets, and pairs of a bucket are verified by exact Jaccard similarity. Components of the verified links come
from the distributed union-find; of each component the occurrence with the least (id, row, position) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pinion.llm.bloom import thinning
from pinion.llm.common import U64, char_shingle_set, cut, join_hot, mix, parts_for, small, table, unique
from pinion.llm.linking import linked_components, signature_blobs, slices

#: 25 bands of 6: a pair of similarity 0.8 is missed with probability 0.0005, one of 0.1 becomes a candidate with 0.00003.
WIDTH, PERCENT, BANDS, ROWS = 5, 80, 25, 6
#: Per bin, the order in which it borrows from others; in one common order, the rows of a short line's band would all be one.
PROBES = np.argsort(mix(np.arange((BANDS * ROWS) ** 2, dtype=U64)).reshape(BANDS * ROWS, -1), axis=1, kind="stable")
#: Per bin, its place in the order of each other bin.
PLACES = np.ascontiguousarray(np.argsort(PROBES, axis=1).T.astype(np.min_scalar_type(BANDS * ROWS)))
#: Odd factors for the minima of a band, and what each band begins with.
FACTORS = mix(np.arange(1, ROWS + BANDS + 1, dtype=U64)) | U64(1)
#: Lines with so many full bins at most borrow in one pass over these; others find a full bin after a few probes.
FEW = 32
PART_BYTES, SIGNATURE_BYTES = 16_000_000, 15
NONE = np.uint32(0xFFFFFFFF)
#: White space other than the blank and \n: of ASCII, and all of it.
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ODD_ASCII = [c for c in ODD if c.isascii()]


def normal(line: str) -> str:
    """What a line is compared by; empty for blank lines, which are left alone."""
    return " ".join(line.lower().split())


def normals(text: str | None) -> list[str]:
    """normal() of each line of a text. Lines are split into words only where there is other than single blanks between these."""
    if not text:
        return []
    text = text.lower()
    lines = text.split("\n")
    if "  " in text or any(map(text.__contains__, ODD_ASCII if text.isascii() else ODD)):
        return [" ".join(x.split()) for x in lines]
    if text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text:
        return [x.strip(" ") for x in lines]
    return lines


def line_ids(lines: list[str]) -> np.ndarray:
    """64 bits, as signed numbers, that name lines."""
    try:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), U64, len(lines))
    except UnicodeEncodeError:  # lone surrogates
        h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), U64, len(lines))
    return (h ^ U64(1 << 63)).view(np.int64)


def lines_of(ids: np.ndarray, texts: list) -> tuple[np.ndarray, list]:
    """The distinct lines of some texts, with their ids."""
    lines = list(dict.fromkeys(n for t in texts for n in normals(t)))
    lines = [n for n in lines if n]
    return line_ids(lines), lines


def hashes32(text: str) -> np.ndarray:
    """32 bits for each shingle of a text: the leading ones select a bin, and all of them the order within it."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    b1, b2 = (np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in (1, 2))
    h2 = c[:-1] * b1
    h2 += c[1:]
    h4 = h2[:-2] * b2
    h4 += h2[2:]
    h = h4[:-1] * b1
    h += c[4:]
    t = h >> np.uint32(16)
    for by, factor in ((15, 0x21F0AAAD), (15, 0x735A2D97)):
        h ^= t
        h *= np.uint32(factor)
        np.right_shift(h, np.uint32(by), out=t)
    h ^= t
    return h


def minima(lines: list[str]) -> np.ndarray:
    """(lines * BANDS * ROWS) minima of the lines' shingles by one permutation; NONE in bins that got no shingle."""
    bins, n = BANDS * ROWS, np.array([max(len(x), WIDTH) for x in lines], np.int64)
    h = hashes32("".join([x.ljust(WIDTH) for x in lines]))
    at = np.repeat(np.arange(len(lines)) * bins, n)[: len(h)]
    at += ((h >> np.uint32(16)) * np.uint32(bins)) >> np.uint32(16)
    ends = np.cumsum(n)[:-1]
    h[(ends[:, None] - np.arange(1, WIDTH)).ravel()] = NONE  # what would reach over a line's end
    out = np.full(len(lines) * bins, NONE, np.uint32)
    np.minimum.at(out, at, h)
    return out


def borrowed(out: np.ndarray) -> np.ndarray:
    """Minima with each empty bin's borrowed from the first full one in the bin's own order."""
    bins = BANDS * ROWS
    borrow_from_few(out.reshape(-1, bins))
    empty, full, k = np.flatnonzero(out == NONE), out.copy(), 0
    while len(empty) and k < bins:
        b = empty % bins
        found = full[empty - b + PROBES[b, k]]
        out[empty] = found
        empty, k = empty[found == NONE], k + 1
    return out


def borrow_from_few(rows: np.ndarray) -> None:
    """Fills the empty bins of rows with FEW full bins at most, in place: of these, the one that comes first in a bin's order."""
    bins, full = rows.shape[1], rows != NONE
    n = np.count_nonzero(full, axis=1)
    few = np.flatnonzero((n > 0) & (n <= FEW))
    if not len(few):
        return
    few = few[np.argsort(-n[few], kind="stable")]
    n, own = n[few], full[few]
    at, start = np.nonzero(own)[1], np.cumsum(n) - n
    best = PLACES[at[start]]
    for j in range(1, n[0]):
        k = np.searchsorted(-n, -j)  # rows with more than j
        np.minimum(best[:k], PLACES[at[start[:k] + j]], out=best[:k])
    bin_ = np.arange(bins)
    source = np.where(own, bin_, PROBES[bin_, best])
    rows[few] = rows[few[:, None], source]


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of each line's shingles; a line shorter than those is one, of its own kind."""
    return [s for p in slices(lines, 150_000) for s in short_line_sets(lines[p])]


def short_line_sets(lines: list[str]) -> list[np.ndarray]:
    """line_sets() of lines that fit into memory side by side."""
    n = np.array([max(len(x) - WIDTH + 1, 1) for x in lines], np.int64)
    c = np.frombuffer("".join([x.ljust(WIDTH, "\n") for x in lines]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    b1, b2 = (U64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2))
    h2 = c[:-1] * b1 + c[1:]
    h4 = h2[:-2] * b2 + h2[2:]
    h = mix(h4[:-1] * b1 + c[4:])
    first = np.ones(len(h), bool)
    at, out = 0, []
    for k in n.tolist():
        part = h[at : at + k]  # without those that reach over the line's end
        part.sort()
        np.not_equal(part[1:], part[:-1], out=first[at + 1 : at + k])
        out.append(part[first[at : at + k]])
        at += k + WIDTH - 1
    return out


def sign(lines: list[str]) -> tuple[np.ndarray, np.ndarray, None, None]:
    if not lines:
        return np.empty(0, np.int64), np.empty(0, U64), None, None
    parts = slices(lines, 150_000)  # small arrays stay in the processor's cache
    sig = np.concatenate([band_hashes(borrowed(minima(lines[p]))) for p in parts])
    return np.repeat(np.arange(len(lines)), BANDS), sig, None, None


def band_hashes(m: np.ndarray) -> np.ndarray:
    """64 bits for the minima of each band: multilinear in these, then mixed."""
    m = m.reshape(-1, BANDS, ROWS)
    sig = np.zeros(m.shape[:2], U64) + FACTORS[ROWS:]
    for r in range(ROWS):
        sig += np.multiply(m[:, :, r], FACTORS[r], dtype=U64)
    return mix(sig.ravel())


#: What names a row: its id and its text. Rows that agree in both are one document, written down several times.
ROW = "CASE WHEN {id} IS NULL OR {text} IS NULL THEN NULL ELSE xxhash64(CAST({id} AS BIGINT), CAST({text} AS STRING)) END"


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, row, text) -> (id, row, lines): the names of a row's lines in order, null for those that are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [normals(t) for t in batch.column(2).to_pylist()]
            ends, lines = np.cumsum([0, *map(len, texts)], dtype=np.int32), [n for t in texts for n in t]
            blank = ~np.fromiter(map(bool, lines), bool, len(lines))
            names = pa.ListArray.from_arrays(pa.array(ends), pa.array(line_ids(lines), mask=blank))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names], names=["id", "row", "lines"])

    return docs.mapInArrow(run, "id long, row long, lines array<long>")


def candidate_lines(docs: DataFrame, may_be) -> DataFrame:
    """(id, text) of the distinct lines that may_be lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, lines = lines_of(None, batch.column(1).to_pylist())
            at = np.flatnonzero(may_be(ids)) if len(ids) else []
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]) if len(at) else pa.array([], pa.int64()), pa.array([lines[i] for i in at], pa.string())], names=["id", "text"])

    return docs.mapInArrow(run, "id long, text string").dropDuplicates(["id"])


def line_components(docs: DataFrame, total_lines: int) -> DataFrame:
    """(id, text) of documents -> (id, component) of the lines that have a near copy."""
    blobs = signature_blobs(docs, sign, parts_for(docs.sparkSession, total_lines * BANDS * SIGNATURE_BYTES, PART_BYTES), split=lines_of)
    return linked_components(blobs, lambda ids: candidate_lines(docs, thinning(ids)), lambda t: char_shingle_set(t, WIDTH), PERCENT, line_sets)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, drop): per row the positions of its lines that go, for rows that lose any."""
    row = F.expr(ROW.format(id=f"`{id_col}`", text=f"`{text_col}`"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).cast("string").alias("text")).where("row IS NOT NULL")
    packed = cut(occurrences(rows))  # a row for each document: one for each line would be many small ones to write and read
    total = packed.agg(F.coalesce(F.sum(F.size(F.filter("lines", F.isnotnull))), F.lit(0))).head()[0]
    seen = packed.select("id", "row", F.posexplode("lines").alias("pos", "line")).where("line IS NOT NULL")
    labels = line_components(rows.select("id", "text"), total)
    lines = seen.groupBy("line").agg(F.min(F.struct("id", "row", "pos")).alias("first"), F.count("*").alias("n"))
    lines = lines.join(unique(labels.withColumnRenamed("id", "line")), "line", "left").where("n > 1 OR component IS NOT NULL")
    lines = cut(lines.select("line", F.coalesce("component", "line").alias("component"), "first", "n"))
    keep = lines.groupBy("component").agg(F.min("first").alias("keep"))
    of = cut(lines.join(unique(keep), "component").select("line", "n", "keep"))
    gone = join_hot(seen, of, "line", "n", total).where("row <> keep.row OR pos <> keep.pos")
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text without the lines that go, and n_dropped (a clashing column is replaced). All rows stay.

    Every line that is not blank takes part, whole, whatever its length; blank lines stay where they are. Rows with a null id
    or text take no part and stay as they are; an empty text stays empty. Rows that share an id are documents of their own;
    rows that share id and text are one document in several rows, which keep and lose the same lines. Of equal firsts, the
    least (id, row hash, position) stays. An empty table gives an empty result. Other columns stay, whatever their names.
    """
    rest = [c for c in docs.columns if c != "n_dropped"]
    drops = dropped_lines(docs.select(id_col, text_col), id_col, text_col).select(F.col("row").alias("__row"), F.col("drop").alias("__drop"))
    row = F.expr(ROW.format(id=f"`{id_col}`", text=f"`{text_col}`"))
    rows = docs.select(*rest).withColumn("__key", row).join(unique(drops), F.col("__key") == F.col("__row"), "left").drop("__row", "__key")
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, n = batch.column(at).to_pylist(), []
            for i, drop in enumerate(batch.column(len(rest)).to_pylist()):
                n.append(len(drop or ()))
                if drop and texts[i] is not None:
                    gone = set(drop)
                    texts[i] = "\n".join([x for p, x in enumerate(texts[i].split("\n")) if p not in gone])
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(rest)])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32())], names=[*rest, "n_dropped"])

    return rows.mapInArrow(run, docs.select(*rest).schema.add("n_dropped", IntegerType()))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: what is left of its text, and how many lines went."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
