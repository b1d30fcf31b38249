"""A table that grows by versions: what a batch writes follows the batch, not the table.

Every batch appends one version below ``path``: its rows in ``rows/version=N/slot=K``, and for each of its contents a line
``content_id, hash, n`` (its rows) in ``seen/version=N/slot=K``, also for contents without rows. ``slot`` is a hash of the id. The rows
of a content are those of its newest version. A file ``log/N`` says which versions of each slot are in use, how far each stream has
come, and the schema; it is renamed into place last, so a version is there whole or not at all, and a batch that failed is
written again under the same number. Only the newest log file is read; it holds at most ``slots`` times the versions that ``compact`` leaves.

A slot is compacted into one version when the share of its rows that are superseded, or the number of its versions, passes a bound.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START = {"version": 0, "live": {}, "streams": {}, "rows": None, "id": None}


def slot_of(content_id: F.Column, slots: int) -> F.Column:
    return F.pmod(F.xxhash64(content_id), F.lit(slots)).cast("int")


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/log")
    return sorted(int(n) for s in fs.listStatus(at) if (n := s.getPath().getName()).isdigit()) if fs.exists(at) else []


def state(spark: SparkSession, path: str) -> dict:
    """What the newest log file says: ``live`` maps a slot to its versions, ``streams`` a stream to its last batch."""
    numbers = _numbers(spark, path)
    if not numbers:
        return json.loads(json.dumps(START))
    fs, at = _fs(spark, f"{path}/log/{numbers[-1]}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, new: dict) -> None:
    """Puts the log file of a version in place; an error if another writer was first."""
    fs, at = _fs(spark, f"{path}/log/{new['version']}")
    _, tmp = _fs(spark, f"{path}/log/.{new['version']}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if not fs.rename(tmp, at):
        raise RuntimeError(f"version {new['version']} of {path} is there already")


def _read(spark: SparkSession, path: str, now: dict, kind: str, slots: list[int] | None = None) -> DataFrame:
    """Rows of ``kind`` in the live versions, with ``version`` and ``slot``: only these folders are listed and read."""
    schema = T.StructType.fromJson(now["rows"]) if kind == "rows" else T.StructType.fromJson(now["id"]).add("hash", "string").add("n", "long")
    schema = T.StructType([*schema, T.StructField("version", T.LongType()), T.StructField("slot", T.IntegerType())])
    wanted = [(v, k) for k, vs in now["live"].items() if slots is None or int(k) in slots for v in vs]
    fs, _ = _fs(spark, path)
    paths = [p for v, k in wanted if (p := f"{path}/{kind}/version={v}/slot={k}") and fs.exists(_fs(spark, p)[1])]
    return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(*paths) if paths else spark.createDataFrame([], schema)


def _newest(seen: DataFrame) -> DataFrame:
    """The newest line of each content."""
    lines = [c for c in seen.columns if c not in ("content_id", "slot")]
    return seen.groupBy("content_id", "slot").agg(F.max(F.struct("version", *(c for c in lines if c != "version"))).alias("s")).select("content_id", "slot", *(F.col(f"s.{c}").alias(c) for c in lines))


def known(spark: SparkSession, path: str, slots: list[int]) -> DataFrame | None:
    """``content_id, hash`` of the contents seen in these slots; nothing before the first batch."""
    now = state(spark, path)
    return _newest(_read(spark, path, now, "seen", slots)).select("content_id", "hash") if now["version"] else None


def _superseded(seen: DataFrame) -> DataFrame:
    w = Window.partitionBy("content_id").orderBy(F.desc("version"))  # a line for each version of one content
    return seen.withColumn("_k", F.row_number().over(w)).where("_k > 1")


def _current(spark: SparkSession, path: str, now: dict, slots: list[int] | None = None) -> DataFrame:
    old = _superseded(_read(spark, path, now, "seen", slots)).select("content_id", "version")
    return _read(spark, path, now, "rows", slots).join(old, ["content_id", "version"], "left_anti")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table: of each content the rows of its newest version. Superseded versions go by an anti join with the lines that say so, a bounded share of all."""
    path = path.rstrip("/")
    return _current(spark, path, state(spark, path)).drop("version", "slot")


def _write(df: DataFrame, path: str, kind: str, version: int) -> None:
    df.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/{kind}/version={version}")


def append(spark: SparkSession, path: str, rows: DataFrame, contents: DataFrame, slots: list[int], stream: str, number: int) -> None:
    """Adds ``rows`` (with ``content_id`` and ``slot``) of ``contents (content_id, hash, slot)``, whose slots are ``slots``, as a version."""
    path, now = path.rstrip("/"), state(spark, path.rstrip("/"))
    version = now["version"] + 1
    _write(rows, path, "rows", version)
    new = now | {"version": version, "rows": rows.drop("slot").schema.jsonValue(), "id": contents.select("content_id").schema.jsonValue(), "streams": now["streams"] | {stream: number}}
    written = _read(spark, path, new | {"live": {k: [version] for k in slots}}, "rows").groupBy("content_id").agg(F.count("*").alias("n"))
    _write(contents.join(written, "content_id", "left").select("content_id", "hash", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "slot"), path, "seen", version)
    new["live"] = now["live"] | {str(k): [*now["live"].get(str(k), []), version] for k in slots}
    commit(spark, path, new)


def compact(spark: SparkSession, path: str, share: float = 0.3, most: int = 32, slots: list[int] | None = None) -> list[int]:
    """Rewrites, of ``slots`` or all, each one whose superseded share of rows is above ``share`` or that has more than ``most`` versions; returns which.

    So a row is rewritten at most once for ``share`` times as many superseded ones, or for ``most`` batches."""
    path = path.rstrip("/")
    now = state(spark, path)
    if not now["version"]:
        return []
    many = {int(k) for k, vs in now["live"].items() if len(vs) > most and (slots is None or int(k) in slots)}
    seen = _read(spark, path, now, "seen", slots)
    old = _superseded(seen).groupBy("slot").agg(F.sum("n").alias("old"))
    full = seen.groupBy("slot").agg(F.sum("n").alias("all")).join(old, "slot").where(F.col("old") > share * F.col("all"))
    due = sorted(many | {r["slot"] for r in full.select("slot").collect()})  # at most as many as slots
    if due:
        version = now["version"] + 1
        _write(_current(spark, path, now, due).drop("version"), path, "rows", version)
        _write(_newest(_read(spark, path, now, "seen", due)).drop("version"), path, "seen", version)
        commit(spark, path, now | {"version": version, "live": now["live"] | {str(k): [version] for k in due}})
    return due


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the folders that no live version is in and all log files but the newest; how many. Run it when nobody reads an older state."""
    path = path.rstrip("/")
    now = state(spark, path)
    live = {(v, int(k)) for k, vs in now["live"].items() for v in vs}
    gone = 0
    fs, at = _fs(spark, path)
    for kind in ("rows", "seen"):
        top = _fs(spark, f"{path}/{kind}")[1]
        for v in fs.listStatus(top) if fs.exists(top) else []:
            number = int(v.getPath().getName().partition("=")[2])
            left = 0
            for s in fs.listStatus(v.getPath()) if number <= now["version"] else []:
                name = s.getPath().getName()
                if name.startswith("slot="):
                    if (number, int(name[5:])) in live:
                        left += 1
                    else:
                        fs.delete(s.getPath(), True)
                        gone += 1
            if not left and number <= now["version"]:
                fs.delete(v.getPath(), True)
    for n in _numbers(spark, path)[:-1]:
        fs.delete(_fs(spark, f"{path}/log/{n}")[1], False)
    return gone
