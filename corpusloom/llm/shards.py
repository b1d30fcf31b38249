"""Sharding by extendible hashing.

A row's hash covers all its columns (so a key that many rows share is spread), and a directory is indexed by the first
bits of the hash. All buckets begin as one; only a bucket above the byte limit splits on its next bit, until each fits.
The directory comes from one aggregate: bytes by the first ``depth`` bits, then every prefix of each (a few rows a
directory entry), so documents are never moved to find it. Buckets that are still too large at that depth go on with
the next bits, alone.

A row larger than the limit has a shard of its own, with ``oversized`` true. Rows equal in all columns can't be told
apart by any hash; those that don't fit one shard are counted, and as many as fit each go into shards numbered by
``copy``, so the limit holds for each of them. Null is a value like any other. An empty table has no shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stash

LIMIT = 4 << 20
#: Bits added to the directory at a time, at most: its size is bounded by 2**STEP entries for each bucket that splits.
STEP = 12


def row_bytes(df: DataFrame) -> Column:
    """UTF-8 bytes of string and binary columns, those of the JSON of arrays, maps, structs and variants, 8 for any other."""

    def of(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("array", "map", "struct", "variant"):
            c = F.to_json(c)
        elif kind not in ("string", "binary"):
            return F.lit(8)
        return F.coalesce(F.octet_length(c), F.lit(0))

    parts = [of(f.name, f.dataType.typeName()) for f in df.schema]
    return reduce(lambda a, b: a + b, parts).cast("long")


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns as a string of 0 and 1. Columns that hold a map or variant, at any depth, are hashed as JSON."""
    hashed = (F.to_json(F.col(f"`{c}`")) if "map<" in d or "variant" in d else F.col(f"`{c}`") for c, d in df.dtypes)
    return F.lpad(F.bin(F.xxhash64(*hashed)), 64, "0")


def _leaves(sizes: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """``sizes (root, prefix, bytes, rows)`` with prefixes of ``depth`` bits, roots of ``base`` bits, to the buckets where splitting stops."""
    each = sizes.select("root", "bytes", "rows", F.explode(F.expr(f"transform(sequence({base}, {depth}), d -> substr(prefix, 1, d))")).alias("shard"))
    sums = each.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("root").alias("root"))
    stop = (F.col("bytes") <= limit) | (F.length("shard") == depth)
    above = sums.where(F.length("shard") < depth).where(~stop).select(F.col("shard").alias("up"))
    first = sums.where((F.length("shard") == base) & stop)
    return first.unionByName(sums.where((F.length("shard") > base) & stop).join(above, F.expr("substr(shard, 1, length(shard) - 1)") == F.col("up"), "left_semi"))


def directory(keyed: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """``keyed (bits, bytes)`` to ``(shard, bytes, rows)``: the buckets, named by their hash prefix."""
    sizes = stash(keyed.groupBy(F.substring("bits", 1, step).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).withColumn("root", F.lit("")))
    out, base, depth = None, 0, step
    while True:
        leaves = stash(_leaves(sizes, base, depth, limit))
        done = leaves.where((F.col("bytes") <= limit) | (F.length("shard") < depth) | (F.length("shard") == 64))
        out = done if out is None else out.unionByName(done)
        large = leaves.where((F.col("bytes") > limit) & (F.length("shard") == depth)) if depth < 64 else None
        if large is None or large.isEmpty():
            return out.select("shard", "bytes", "rows")
        base, depth = depth, min(64, depth + step)
        more = keyed.withColumn("shard", F.substring("bits", 1, base)).join(large.select("shard"), "shard", "left_semi")
        sizes = stash(more.groupBy(F.col("shard").alias("root"), F.substring("bits", 1, depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")))


def assign(df: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """``df`` with ``shard`` (hash prefix), ``copy`` (0 but for repeated rows that overflow), ``row_bytes``, ``shard_bytes`` and ``oversized``.

    The directory, a row for each of its slots at the least depth in use, meets the rows in one equi-join; Spark
    broadcasts it where its size allows. Columns of these names in ``df`` keep their names; the new ones get ``_``.
    """
    new = dict.fromkeys(("shard", "copy", "row_bytes", "shard_bytes", "oversized", "_bits", "_slot", "_leaf"))
    for n in new:
        new[n] = n
        while new[n] in df.columns:
            new[n] += "_"
    bits, size, slot, leaf = (f"`{new[n]}`" for n in ("_bits", "row_bytes", "_slot", "_leaf"))
    keyed = df.withColumns({new["_bits"]: row_hash(df), new["row_bytes"]: row_bytes(df)})
    leaves = stash(directory(keyed.select(F.col(bits).alias("bits"), F.col(size).alias("bytes")), limit, step))
    least = leaves.agg(F.min(F.length("shard"))).first()[0] or 0
    slots = leaves.groupBy(F.expr(f"substr(shard, 1, {least})").alias(new["_slot"])).agg(F.collect_list(F.struct("shard", "bytes", "rows")).alias(new["_leaf"]))
    met = keyed.withColumn(new["_slot"], F.expr(f"substr({bits}, 1, {least})")).join(slots, new["_slot"]).withColumn(new["_leaf"], F.expr(f"filter({leaf}, x -> startswith({bits}, x.shard))[0]"))
    spread = F.expr(f"length({leaf}.shard) = 64 and {leaf}.bytes > {limit} and {leaf}.rows > 1")

    def named(rows: DataFrame, copy: Column, total: Column) -> DataFrame:
        return rows.select(
            *(F.col(f"`{c}`") for c in df.columns), F.expr(f"{leaf}.shard").alias(new["shard"]), copy.cast("int").alias(new["copy"]), F.col(size), total.cast("long").alias(new["shard_bytes"]), (total > limit).alias(new["oversized"])
        )

    whole = named(met.where(~spread), F.lit(0), F.expr(f"{leaf}.bytes"))
    if leaves.where(f"length(shard) = 64 and bytes > {limit} and rows > 1").isEmpty():
        return whole
    # equal rows as one row with their number; each of its copies is a row again before the rows of the copy are made
    each = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    one = met.where(spread).groupBy(F.col(bits), F.md5(F.to_json(each, {"ignoreNullFields": "false"})).alias("mark")).agg(F.first(each).alias("row"), F.first(leaf).alias(new["_leaf"]), F.first(size).alias(new["row_bytes"]), F.count("*").alias("n"))
    one = one.withColumn("fit", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(size)))).withColumn("parts", F.ceil(F.col("n") / F.col("fit")))
    before = F.coalesce(F.sum("parts").over(Window.partitionBy(F.col(bits)).orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of different rows with one 64-bit hash
    copies = one.withColumn("before", before).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).repartition(F.col(bits), "part")
    copies = copies.withColumn("here", F.least("fit", F.col("n") - F.col("part") * F.col("fit"))).withColumn("_", F.explode(F.expr("sequence(1L, here)")))
    values = F.col("row")
    dealt = copies.select(*(values[c].alias(c) for c in df.columns), F.col(leaf), F.col(size), (F.col("before") + F.col("part")).alias(new["_slot"]), (F.col("here") * F.col(size)).alias(new["_bits"]))
    return whole.unionByName(named(dealt, F.col(slot), F.col(bits)))
