"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Words are counted over the whole corpus (map-side in bounded tables, then one shuffle of word counts); the LEXICON_WORDS
most frequent of those seen at least MIN_COUNT times, with their ids, become an automaton that is shipped to every
executor and mapped into memory. All other words are merged exactly. The bound on the lexicon never changes a result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from pinion.llm.bpe import Encoder, Lexicon, Vocabulary, compile_lexicon
from pinion.llm.common import cut, local_copy, publish, small, table

LEXICON_WORDS, MIN_COUNT = 60_000, 3
#: Words that a worker counts before it passes the counts on.
COUNT_TABLE = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_loaded: dict[tuple, Encoder] = {}


def encoder_for(vocabulary: str, lexicon: str | None = None) -> Encoder:
    """One encoder per worker process, kept over tasks."""
    key = (vocabulary, lexicon)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(Vocabulary(vocabulary), Lexicon.mapped(local_copy(lexicon)) if lexicon else None)
    return _loaded[key]


def word_counts(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, chunks, seen = encoder_for(vocabulary).vocabulary, Counter(), Counter()

        def flush() -> pa.RecordBatch:
            for chunk, n in chunks.items():
                for w in (chunk,) if chunk.isalpha() else v.split(chunk):
                    seen[w] = seen.get(w, 0) + n
            keys = [w.encode("utf-8", "surrogateescape") for w in seen]
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            chunks.clear()
            seen.clear()
            return out

        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                for part, special in v.segments(text) if text else ():
                    if special is None and v.plain(part):
                        chunks.update(part.lower().split())
                    elif special is None:
                        seen.update(v.words(part))
                if len(chunks) + len(seen) > COUNT_TABLE:
                    yield flush()
        yield flush()

    counted = docs.select(text_col).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocabulary: str, text_col: str = "text", most: int = LEXICON_WORDS, least: int = MIN_COUNT) -> list[bytes]:
    """At most `most` words, all of those above some count: a histogram of counts tells which, so that no task sends more."""
    counts = cut(word_counts(docs, vocabulary, text_col).where(F.col("n") >= least).withColumn("level", F.floor(F.log("n") * 16)))
    level, held = None, 0
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            break
        level = r["level"]
    if level is None:
        return []
    rows = counts.where(F.col("level") >= level).select("word", "n").collect()
    return [w for _, w in sorted((-r["n"], bytes(r["word"])) for r in rows)]


def build_lexicon(spark: SparkSession, words: list[bytes], vocabulary: str) -> str:
    """Compiles and ships the automaton; returns its name."""
    v = Vocabulary(vocabulary)
    return publish(spark, compile_lexicon({w: v.merge_bytes(w) for w in words}), "lexicon")


def encode_column(docs: DataFrame, vocabulary: str, lexicon: str | None, text_col: str = "text") -> DataFrame:
    """docs without the text, with ids (array<int>) and decoded (clashing columns are replaced, others stay).

    A null text is treated as empty; whole texts are encoded, however long. Rows are independent, so repeated rows and rows
    with a null id fare alike, and nothing ties. An empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in (text_col, "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_for(vocabulary, lexicon)
        for batch in small(batches):
            done = [e.encode(t) for t in batch.column(len(rest)).to_pylist()]
            ids = pa.array([memoryview(b).cast("I").tolist() for b, _ in done], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], ids, pa.array([t for _, t in done], pa.string())], names=[*rest, "ids", "decoded"])

    return docs.select(*rest, text_col).mapInArrow(run, docs.select(*rest).schema.add("ids", ArrayType(IntegerType())).add("decoded", "string"))


def decode_column(docs: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """docs with `decoded`, from ids: tokens joined by spaces, special tokens kept; a null list gives an empty text."""
    rest = [c for c in docs.columns if c != "decoded"]
    at = rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder_for(vocabulary).vocabulary.tokens
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids or () if i in tokens]) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*rest, "decoded"])

    return docs.select(*rest).mapInArrow(run, docs.select(*rest).schema.add("decoded", "string"))


def digests(docs: DataFrame, vocabulary: str, lexicon: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass that keeps no ids.

    Null texts are empty; whole texts are encoded, however long. Rows are independent: repeated rows come back each, a null id
    stays null, and nothing ties. An empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_for(vocabulary, lexicon)
        for batch in small(batches):
            n, a, b = array("q"), [], []
            for text in batch.column(1).to_pylist():
                ids, decoded = e.encode(text)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), default_vocabulary()
    lexicon = build_lexicon(spark, frequent_words(docs, vocabulary), vocabulary)
    return digests(docs, vocabulary, lexicon)
