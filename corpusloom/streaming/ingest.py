"""Incremental ingestion: each micro-batch replaces its own keys; contents that didn't change are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as tx
from corpusloom.streaming import versions as vs


def latest(batch: DataFrame) -> DataFrame:
    """One row for each content of a batch: the one that arrived last, ties by text."""
    w = Window.partitionBy("content_id").orderBy(F.desc("arrived"), F.desc("text"))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def changed(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the batch whose hash isn't known for their id."""
    return batch.withColumn("hash", tx.text_hash(F.coalesce("text", F.lit("")))).join(known.select("content_id", "hash"), ["content_id", "hash"], "left_anti")


def consolidate(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, buckets: int = 64, share: float = 0.3, most: int = 32) -> StreamingQuery:
    """``stream (content_id, text, arrived)`` to a table of versions at ``path`` (read it by ``versions.current``) of what
    ``analyse`` returns for each content, with ``hash``.

    A batch reads the ids and hashes of the slots its contents are in, and writes a version that holds its changed contents alone;
    then those of its slots are compacted that have more than ``share`` superseded rows or more than ``most`` versions. A
    batch that failed is done again, one that was committed is not.
    """
    root, name = path.rstrip("/"), checkpoint.rstrip("/")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or name}"
        if vs.state(spark, root)["streams"].get(query, -1) < number:
            rows = latest(batch).withColumn("slot", vs.slot_of(F.col("content_id"), buckets))
            touched = [r.slot for r in rows.select("slot").distinct().collect()]  # at most ``buckets`` numbers
            seen = vs.known(spark, root, touched)
            rows = changed(rows, seen) if seen is not None else rows.withColumn("hash", tx.text_hash(F.coalesce("text", F.lit(""))))
            contents = rows.select("content_id", "hash", "slot")
            vs.append(spark, root, analyse(rows.select("content_id", "text")).join(contents, "content_id"), contents, touched, query, number)
        else:
            touched = None
        vs.compact(spark, root, share, most, touched)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
