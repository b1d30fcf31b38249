"""What several operators share: durable intermediate results and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.store import discard, stash

__all__ = ["connected_components", "discard", "stash", "table", "trimmed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches. Between them Arrow gives the memory back that it no longer uses: a worker serves several operators in turn."""
    for b in batches:
        pa.default_memory_pool().release_unused()
        yield b
        del b
    pa.default_memory_pool().release_unused()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Undirected links ``(u, v)`` to ``(id, component_id)`` for every linked id; the component is its smallest id.

    Alternating large-star and small-star rounds: each is a partial-aggregated minimum and one equi-join, so a hub with
    a third of all links is summed map-side and its join can be split. The number of rounds is logarithmic in practice.
    """
    e = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
        before, mark = mark, _mark(e)
        if before == mark:
            break
    star = e.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")
    return star.unionByName(star.select(F.col("component_id").alias("id"), "component_id").distinct())
