"""Streaming ingestion: JSON document lines, upserted into a collection batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pinion.collection import Collection
from pinion.sources.jsonl import scan_docs


def upsert_stream(c: Collection, source: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads text files of document lines as they appear in `source`. Each micro-batch is one version of the collection,
    written in Spark; a batch that is replayed after a failure upserts the same rows again, which changes nothing."""
    lines = c.spark.readStream.schema("value string").text(source)

    def write(batch: DataFrame, _: int) -> None:
        staged = f"{c.files.root}/.stage"
        batch.write.mode("overwrite").text(staged)
        c.append_frame(scan_docs(c.spark, staged, c.schema))
        c.files.delete(".stage")

    stream = lines.where(F.trim("value") != "").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
