"""Near duplicates of embeddings by randomised-rotation binary codes.

Each unit vector is rotated by a seeded random rotation and kept as the signs of its coordinates, together with its
inner product with its own code (the correction factor). For two vectors, the code of one and the other one quantised to
four bits (with random rounding, so the estimate is unbiased) give an estimate of their inner product with bit counts,
and a confidence bound of ``SIGMAS`` standard errors around it. A pair whose upper bound is below the threshold is
dropped; every other pair is computed exactly, in double precision.

Pairs come from ``tables`` buckets per vector, each the signs of ``bits`` random directions. Their number follows from
the number of vectors: buckets of about a hundred vectors by chance, and as many tables as find a pair at the threshold with
probability ``RECALL``. Buckets are met twice. First with codes of several rotations only (about 60 bytes a vector and bucket): a vector that
has no candidate in a bucket leaves it. Then what is left, with the vectors. A bucket above ``BLOCK`` vectors is cut
into blocks, and each pair of blocks is a task of its own, so a bucket of any size is compared whole. Equal vectors are
one vector with a count. A pair that meets in several tables counts in the first; tasks return counts and a spanning
star for each vector, not pairs, and connected components make the classes.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors of another length, link with
nothing (vectors of the same length link among themselves). Repeated rows link with each other like any equal vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import connected_components, stash

THRESHOLD = 0.9
RECALL = 0.97
SIGMAS = 5.0
BLOCK = 512
#: Vectors that share a bucket by chance, and bits of the codes that sift them.
BUCKET = 96
SIFT_BITS = 256
SEED = 20


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket and tables for ``n`` vectors; tables find a pair at the threshold with probability ``recall``, below 1."""
    if not 0 < recall < 1:
        raise ValueError("recall must be between 0 and 1")
    bits = max(6, min(40, math.ceil(math.log2(max(2, n) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def pack_signs(x: np.ndarray) -> np.ndarray:
    """Signs of each row as 64-bit words."""
    b = np.packbits(x >= 0, axis=1, bitorder="little")
    return np.pad(b, ((0, 0), (0, -b.shape[1] % 8))).view(np.uint64)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, correction factors <o, code>, and the rotated vectors."""
    turned = unit @ rotation(unit.shape[1])
    return pack_signs(turned), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1]), turned


def sift_codes(unit: np.ndarray) -> np.ndarray:
    """Code words of as many rotations as SIFT_BITS need."""
    dim = unit.shape[1]
    return np.concatenate([pack_signs(unit @ rotation(dim, SEED + 100 + r)) for r in range(-(-SIFT_BITS // dim))], axis=1)


def quantised(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Four bit planes of each row, its low end, step and sum of levels; rounding is random but depends only on the row."""
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-12)
    x = (turned - low[:, None]) / step[:, None]
    noise = (np.sin(turned * 12345.678) * 43758.5453) % 1.0
    level = np.clip(np.floor(x + noise), 0, 15).astype(np.uint8)
    planes = np.stack([pack_signs(np.where(level >> p & 1, 1.0, -1.0)) for p in range(4)])
    return planes, low, step, level.sum(axis=1, dtype=np.int64)


def estimates(code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, total: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (codes by rows, quantised by columns) and their standard errors.

    The error has two parts: what the code leaves out of its vector, and the random rounding of the other vector to
    levels, whose variance is a sixth of the squared step in each coordinate.
    """
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    dot = np.zeros((len(code), planes.shape[1]), np.int64)
    for p in range(4):
        for w in range(code.shape[1]):
            dot += np.bitwise_count(code[:, w, None] & planes[p][None, :, w]).astype(np.int64) << p
    raw = (step[None, :] * (2 * dot - total[None, :]) + low[None, :] * (2 * ones[:, None] - dim)) / math.sqrt(dim)
    left_out = np.maximum(1 - factor**2, 0) / max(1, dim - 1)
    return raw / factor[:, None], np.sqrt(left_out[:, None] + step[None, :] ** 2 / 6) / factor[:, None]


def _unit(df: DataFrame, column: str) -> DataFrame:
    """``vec_id, uid, embedding`` of usable vectors, as double."""
    e = F.col(column).cast("array<double>")
    good = (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return df.select("vec_id", "uid", e.alias("e")).where(good)


def _coded(vectors: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """``node, dim, code binary, wide binary, factor, buckets array<long>, unit binary`` of ``node, e``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = np.stack([flat[offsets[i] : offsets[i] + dim] for i in at])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed + 1, dim]).standard_normal((dim, bits * tables))
                signs = (unit @ planes[dim] >= 0).reshape(len(at), tables, bits)
                buckets = (signs << np.arange(bits)).sum(axis=2, dtype=np.int64) * 4096 + np.arange(tables) % 4096
                code, factor, _ = codes(unit)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array([dim] * len(at), pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([c.tobytes() for c in sift_codes(unit)], pa.binary()), pa.array(factor), pa.array(list(buckets), pa.list_(pa.int64())), pa.array([u.tobytes() for u in unit], pa.binary())],
                    ["node", "dim", "code", "wide", "factor", "buckets", "unit"],
                )

    return vectors.select("node", "e").mapInArrow(run, "node long, dim int, code binary, wide binary, factor double, buckets array<long>, unit binary")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows (dim, bucket, node, ...)`` of buckets with more than one vector, each row once for each pair of blocks it belongs to: ``a`` and ``b`` with side 0, 1 or (in a block with itself) 2."""
    sizes = rows.groupBy("dim", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    n = F.expr(f"cast(ceil(size / {block}) as int)")
    met = rows.join(sizes, ["dim", "bucket"]).withColumn("parts", n).withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    pairs = F.expr("transform(sequence(0, parts - 1), q -> struct(least(q, part) as a, greatest(q, part) as b))")
    return met.withColumn("pair", F.explode(pairs)).select("*", "pair.a", "pair.b").drop("pair", "parts", "size")


def _split(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    part, a, b = t["part"].to_numpy(), t["a"][0].as_py(), t["b"][0].as_py()
    return (np.flatnonzero(part == a), np.flatnonzero(part == b), a == b)


def _bytes(t: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(t[column].to_pylist()), dtype).reshape(t.num_rows, -1)


def _candidates(code: np.ndarray, factor: np.ndarray, turned: np.ndarray | None, i: np.ndarray, j: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold: the upper confidence bound of the estimate does."""
    if turned is None:  # codes on both sides: signs of a pair at angle t differ with probability t / pi
        differ = np.zeros((len(i), len(j)), np.int64)
        for w in range(code.shape[1]):
            differ += np.bitwise_count(code[i, w, None] ^ code[None, j, w])
        p = math.acos(threshold) / math.pi
        return differ <= dim * p + SIGMAS * math.sqrt(dim * p * (1 - p))
    planes, low, step, total = quantised(turned[j])
    est, err = estimates(code[i], factor[i], planes, low, step, total, dim)
    return est + SIGMAS * err >= threshold


def link_counts(coded: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(node, linked)`` numbers of vectors that pairs link to a node, weighted by their counts, and star links ``(u, v)`` of nodes."""
    first = _blocks(coded.select("dim", F.explode("buckets").alias("bucket"), "node", "wide"), block)

    def sift(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, j, same = _split(t)
        dim = t["dim"][0].as_py()
        c = _candidates(_bytes(t, "wide", np.uint64), None, None, i, j, dim * -(-SIFT_BITS // dim), threshold)
        if same:
            np.fill_diagonal(c, False)
        keep = np.unique(np.concatenate([i[c.any(axis=1)], j[c.any(axis=0)]]))
        return t.take(pa.array(keep)).select(["node", "dim", "bucket"])

    left = first.groupBy("dim", "bucket", "a", "b").applyInArrow(sift, "node long, dim int, bucket long").distinct()
    second = _blocks(left.join(coded.select("node", "weight", "factor", "code", "unit", "buckets"), "node"), block)

    def link(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, j, same = _split(t)
        dim, bucket = t["dim"][0].as_py(), t["bucket"][0].as_py()
        code, unit, node = _bytes(t, "code", np.uint64), _bytes(t, "unit", np.float64), t["node"].to_numpy()
        c = _candidates(code, t["factor"].to_numpy(), unit @ rotation(dim), i, j, dim, threshold)
        if same:
            c &= i[:, None] < j[None, :]
        p, q = np.nonzero(c)
        p, q = i[p], j[q]
        exact = np.einsum("ij,ij->i", unit[p], unit[q]) if len(p) else np.zeros(0)
        p, q = p[exact >= threshold], q[exact >= threshold]
        buckets = np.array(t["buckets"].to_pylist(), np.int64)
        turn = bucket % 4096
        if len(p):
            seen = np.concatenate([(buckets[p[s : s + 20_000], :turn] == buckets[q[s : s + 20_000], :turn]).any(axis=1) for s in range(0, len(p), 20_000)]) if turn else np.zeros(len(p), bool)
            p, q = p[~seen], q[~seen]
        w = t["weight"].to_numpy()
        linked = np.bincount(p, w[q], t.num_rows) + np.bincount(q, w[p], t.num_rows)
        low = node.copy()  # least node in reach, by passes over the links
        while len(p):
            before = low.copy()
            np.minimum.at(low, p, low[q])
            np.minimum.at(low, q, low[p])
            if (low == before).all():
                break
        some = np.flatnonzero(linked > 0)
        return pa.table({"node": pa.array(node[some]), "linked": pa.array(linked[some].astype(np.int64)), "up": pa.array(low[some])})

    found = stash(second.groupBy("dim", "bucket", "a", "b").applyInArrow(link, "node long, linked long, up long"))
    return found.groupBy("node").agg(F.sum("linked").alias("linked")), found.where("node <> up").select(F.col("node").alias("u"), F.col("up").alias("v")).distinct()


def links(df: DataFrame, threshold: float = THRESHOLD, column: str = "embedding", recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = stash(df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("embedding")).withColumn("uid", F.monotonically_increasing_id()))
    usable = _unit(rows, "embedding").withColumn("same", F.xxhash64("e", F.lit(1))).withColumn("other", F.xxhash64("e", F.lit(2)))
    nodes = stash(usable.groupBy("same", "other").agg(F.count("*").alias("weight"), F.min("uid").alias("node"), F.min("vec_id").alias("low")))
    member = usable.select("vec_id", "uid", "same", "other").join(nodes, ["same", "other"]).select("uid", "node", "weight")
    bits, tables = plan(nodes.count(), threshold, recall)
    coded = _coded(usable.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "e"), bits, tables)
    coded = stash(coded.join(nodes.select("node", "weight"), "node"))
    counts, stars = link_counts(coded, threshold, block)
    parts = connected_components(stars).select(F.col("id").alias("node"), F.col("component_id").alias("part"))
    placed = nodes.join(counts, "node", "left").join(parts, "node", "left").select("node", "low", F.coalesce("part", "node").alias("part"), F.coalesce("linked", F.lit(0)).alias("linked"))
    least = placed.groupBy("part").agg(F.min("low").alias("component"))
    info = placed.join(least, "part").select("node", "linked", "component")
    out = rows.select("vec_id", "uid").join(member.join(info, "node"), "uid", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("linked") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
