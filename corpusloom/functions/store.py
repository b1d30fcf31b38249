"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Without that setting a local session (tests) gets a temporary one; a
    cluster, whose executors wouldn't see it, an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: For rows of megabytes: a row group, which writer and reader hold whole, ends as soon as it is that large and not after 100 rows.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def stash(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stashed: DataFrame) -> None:
    """Delete a stash that nothing will read any more."""
    spark = stashed.sparkSession
    for parent in {f.rsplit("/", 1)[0] for f in stashed.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
