"""Clustering of TF-IDF or embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.store import discard, stash
from corpusloom.operators.terms import ranked
from corpusloom.operators.vectors import numbered


def sparse_vectors(weights: DataFrame, size: int = 1 << 18) -> DataFrame:
    """``content_id, features`` of ``content_id, term, weight``; terms are numbered by hash, so no vocabulary is gathered."""
    at = F.pmod(F.xxhash64("term"), F.lit(size)).cast("int")
    cells = weights.groupBy("content_id", at.alias("i")).agg(F.sum("weight").alias("w"))
    rows = cells.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("cells"))


    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), b.column(1), b.column(2)]  # the stored form of a sparse vector
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], ["content_id", "features"])

    schema = T.StructType([rows.schema["content_id"], T.StructField("features", VectorUDT())])
    return rows.select("content_id", F.col("cells.i").alias("indices"), F.col("cells.w").cast("array<double>").alias("values")).mapInArrow(make, schema)


def kmeans(vectors: DataFrame, k: int = 8, seed: int = 42, rounds: int = 100) -> tuple[DataFrame, float]:
    """``vectors`` with ``cluster``, and the inertia."""
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors), model.summary.trainingCost


def normed(docs: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``content_id, norm`` (squared length, 0 without terms) of every row of ``docs (content_id)``, and the weights that aren't 0."""
    weights = weights.where("weight <> 0")
    lengths = weights.groupBy("content_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    return stash(docs.select("content_id").join(lengths, "content_id", "left").select("content_id", F.coalesce("norm", F.lit(0.0)).alias("norm"))), weights


def _nearest(vectors: DataFrame, weights: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """``content_id, cluster, distance`` (squared) to the nearest of the centroids ``cluster, term, c``; equal distances, to nine decimals, go to the lower number.

    A term's ``k`` coordinates are one row, so a posting meets one row; documents are then summed by id, map-side first.
    """
    each = [F.sum(F.when(F.col("cluster") == i, F.col("c")).otherwise(0.0)).alias(f"c{i}") for i in range(k)]
    by_term = centroids.groupBy("term").agg(*each)
    norms = F.broadcast(centroids.agg(*(F.coalesce(F.sum(F.when(F.col("cluster") == i, F.col("c") * F.col("c"))), F.lit(0.0)).alias(f"q{i}") for i in range(k))))  # one row
    dots = weights.join(by_term, "term").groupBy("content_id").agg(*(F.sum(F.col("weight") * F.col(f"c{i}")).alias(f"d{i}") for i in range(k)))
    far = F.array(*(F.round(F.col("norm") + F.col(f"q{i}") - 2 * F.coalesce(f"d{i}", F.lit(0.0)), 9) for i in range(k)))
    met = vectors.join(dots, "content_id", "left").crossJoin(norms).select("content_id", far.alias("far"))
    return met.select("content_id", (F.array_position("far", F.array_min("far")) - 1).alias("cluster"), F.array_min("far").alias("distance"))


#: Up to so many terms each task may hold the centroids of two rounds and the sums, three times as many numbers for each term as there are clusters.
HELD_TERMS = 4_000_000


def term_kmeans(vectors: DataFrame, weights: DataFrame, k: int = 8, seed: int = 42, rounds: int = 100, held: int = HELD_TERMS) -> DataFrame:
    """``content_id, cluster, distance`` (squared) of every row of ``vectors (content_id, norm)`` whose coordinates are ``weights (content_id, term, weight)``.

    k-means over the whole vocabulary. The start are ``k`` documents that have terms, in the order of a hash of seed and id; fewer make fewer
    clusters. A cluster that loses its documents keeps its centroid. It ends when no document changes its cluster, after
    ``rounds`` means at most; distances are those to the last means. A document without terms belongs to the shortest centroid.

    Up to ``held`` terms the centroids go to every task (``row_kmeans``); beyond, they are a table ``cluster, term, c``, and documents meet it on their terms.
    """
    vocab, n = numbered(weights.select("term").distinct())
    if n > held:
        return _kmeans_in_tables(vectors, weights, k, seed, rounds)
    cells = weights.join(vocab, "term").groupBy("content_id").agg(F.collect_list(F.struct("at", "weight")).alias("_c"))  # a document's terms
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = vectors.join(cells, "content_id", "left").select("content_id", "norm", F.coalesce("_c.at", none("int")).alias("at"), F.coalesce("_c.weight", none("double")).alias("w"))
    return row_kmeans(rows, n, k, seed, rounds)[0]


def _start(vectors: DataFrame, k: int, seed: int) -> list:
    return vectors.where("norm > 0").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("content_id").cast("string"))), "content_id").limit(k).collect()  # k rows


def _packed(rows: DataFrame) -> DataFrame:
    """``content_id, norm, at, w`` with each document's arrays as bytes, which pass from the table to Python as they are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b.column(0), b.column(1)]
            for c, kind in ((2, np.int32), (3, np.float64)):
                flat = np.ascontiguousarray(b.column(c).flatten().to_numpy(zero_copy_only=False), kind)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False))]) * flat.itemsize
                out.append(pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays(out, ["content_id", "norm", "at", "w"])

    return stash(rows.select("content_id", "norm", "at", "w").mapInArrow(make, f"content_id {rows.schema['content_id'].dataType.simpleString()}, norm double, at binary, w binary"))


#: So many terms' sums are one row on their way to the driver.
TERMS_A_ROW = 16_384


def row_kmeans(rows: DataFrame, n: int, k: int = 8, seed: int = 42, rounds: int = 100, counted: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``term_kmeans``, of rows ``content_id, norm, at, w`` with terms numbered below ``n``; also ``cluster, at, s``, the summed weights of each cluster's documents.

    A round is one pass over the rows: a task holds the centroids of this round and of the one before, finds each document's cluster among both and adds up the weights of those that moved.
    Only these sums are handed on. ``counted`` is told how many documents moved in each round."""
    start = _start(rows, k, seed)
    rows, spark = _packed(rows), rows.sparkSession
    k = max(1, len(start))
    c = np.zeros((n, k))
    for i, r in enumerate(start):
        c[r["at"], i] = r["w"]
    few = rows.coalesce(2 * spark.sparkContext.defaultParallelism)  # each task sums once
    span = TERMS_A_ROW * k

    def nearest(b: pa.RecordBatch, c: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the centroids and its distance; equal distances, to nine decimals, go to the lower number."""
        far = np.empty((b.num_rows, k))
        for j, (at, w) in enumerate(zip(b.column(2), b.column(3))):
            far[j] = np.einsum("i,ij->j", np.frombuffer(w.as_buffer()), c.take(np.frombuffer(at.as_buffer(), np.int32).astype(np.int64), axis=0))
        far = np.floor((b.column(1).to_numpy()[:, None] + squares - 2 * far) * 1e9 + 0.5) / 1e9
        own = far.argmin(axis=1)
        return own, far[np.arange(len(own)), own]

    def sums(new: Broadcast, old: Broadcast | None) -> DataFrame:
        """``part, at, s``: weights of each cluster's documents, less those of the clusters by ``old``, of the terms of a part; part -1 has the clusters' sizes, less the old ones, and how many moved."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, before = new.value, old.value if old else None
            total, size = None, np.zeros(k + 1)
            for b in batches:
                total = np.zeros(n * k) if total is None else total
                own = nearest(b, *c)[0]
                was = own if before is None else nearest(b, *before)[0]
                for j in range(b.num_rows) if before is None else np.flatnonzero(own != was).tolist():
                    at, w = np.frombuffer(b.column(2)[j].as_buffer(), np.int32).astype(np.int64) * k, np.frombuffer(b.column(3)[j].as_buffer())
                    np.add.at(total, at + own[j], w)
                    size[own[j]] += 1
                    size[k] += 1
                    if before is not None:
                        np.subtract.at(total, at + was[j], w)
                        size[was[j]] -= 1
            if total is None or not size[k]:
                return
            at = np.flatnonzero(total)
            cuts = np.searchsorted(at, np.arange(0, n * k + span, span))
            pieces = [(i, (at[lo:hi] - i * span), total[at[lo:hi]]) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
            for i, x, s in [(-1, np.arange(k + 1), size), *pieces]:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.astype(np.int32).tobytes()]), pa.array([s.tobytes()])], names)

        def add(g: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(max(span, k + 1))
            for x, s in zip(g["at"], g["s"]):
                total[np.frombuffer(x, np.int32)] += np.frombuffer(s)
            at = np.flatnonzero(total)
            return pd.DataFrame({"part": g["part"][:1], "at": [at.astype(np.int32).tobytes()], "s": [total[at].tobytes()]})

        names, schema = ["part", "at", "s"], "part int, at binary, s binary"
        return few.mapInArrow(step, schema).groupBy("part").applyInPandas(add, schema)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, distance = nearest(b, *held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own), pa.array(distance)], ["content_id", "cluster", "distance"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                at = np.frombuffer(x, np.int32) + part * span
                yield pa.RecordBatch.from_arrays([pa.array((at % k).astype(np.int64)), pa.array((at // k).astype(np.int32)), pa.array(np.frombuffer(s))], ["cluster", "at", "s"])

    hold = lambda c: spark.sparkContext.broadcast((c, (c * c).sum(axis=0)))  # noqa: E731  HELD_TERMS bounds it
    held, before, whole, size, moves = hold(c), None, np.zeros(n * k), np.zeros(k + 1), []
    for _ in range(rounds if start else 0):
        size[k] = 0
        for r in sums(held, before).collect():  # HELD_TERMS bounds it
            into = size if r["part"] < 0 else whole[r["part"] * span :]
            into[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["s"])
        if before is not None:
            before.destroy()
            moves.append(int(size[k]))
            if not moves[-1]:
                break
        has = size[:k] > 0
        c = np.where(has, whole.reshape(n, k) / np.where(has, size[:k], 1.0), c)
        before, held = held, hold(c)
    if counted is not None:
        counted.update(moves=moves)
    kind = rows.schema["content_id"].dataType.simpleString()
    found = stash(rows.mapInArrow(assigned, f"content_id {kind}, cluster long, distance double"))
    return found, sums(held, None).where("part >= 0").mapInArrow(unpacked, "cluster long, at int, s double")


def _kmeans_in_tables(vectors: DataFrame, weights: DataFrame, k: int, seed: int, rounds: int) -> DataFrame:
    start = _start(vectors, k, seed)
    spark, kind = vectors.sparkSession, vectors.schema["content_id"].dataType.simpleString()
    if not start:
        return vectors.select("content_id", F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("distance"))
    k = len(start)
    chosen = spark.createDataFrame([(r["content_id"], i) for i, r in enumerate(start)], f"content_id {kind}, cluster long")
    centroids = stash(weights.join(F.broadcast(chosen), "content_id").select("cluster", "term", F.col("weight").alias("c")))  # k rows
    found = stash(_nearest(vectors, weights, centroids, k))
    for _ in range(rounds):
        size = found.groupBy("cluster").agg(F.count("*").alias("size"))
        means = weights.join(found.select("content_id", "cluster"), "content_id").groupBy("cluster", "term").agg(F.sum("weight").alias("w"))
        left = centroids.join(size, "cluster", "left_anti")
        moved = stash(means.join(F.broadcast(size), "cluster").select("cluster", "term", (F.col("w") / F.col("size")).alias("c")).unionByName(left))  # k sizes
        discard(centroids)
        new = stash(_nearest(vectors, weights, moved, k))
        still = new.join(found.select("content_id", F.col("cluster").alias("_old")), "content_id").where("cluster <> _old").isEmpty()
        discard(found)
        centroids, found = moved, new
        if still:
            break
    return found


def dense(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast(T.ArrayType(T.DoubleType()))))


def _summed_distances(a: np.ndarray, y: np.ndarray, rows: int = 500) -> np.ndarray:
    """The sum of the distances of each of ``a`` to all of ``y``, by a product of matrices; near pairs, whose digits it would lose, one by one."""
    total, own, other = np.zeros(len(a)), (a * a).sum(axis=1), (y * y).sum(axis=1)
    for lo in range(0, len(a), rows):
        x = a[lo : lo + rows]
        both = own[lo : lo + rows, None] + other
        d = both - 2 * (x @ y.T)
        close = ~(d > 1e-4 * both)
        for i in np.flatnonzero(close.any(axis=1)):
            d[i, close[i]] = ((y[close[i]] - x[i]) ** 2).sum(axis=1)
        total[lo : lo + rows] = np.sqrt(d).sum(axis=1)
    return total


def _mean_distances(asked: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """``id, label, label2, d``: the mean distance of each asked ``(id, label, v, label2)`` to the members ``(id, label, v)`` of ``label2`` but itself.

    Of each label the asking vectors and the members are dealt into blocks, and a pair of blocks is a task that returns sums."""
    dealt = lambda df, key: df.groupBy(F.col(key).alias("_l")).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    n = dealt(asked, "label2").withColumnRenamed("_n", "_a").join(dealt(members, "label").withColumnRenamed("_n", "_b"), "_l")
    slot = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    x = asked.withColumn("_l", F.col("label2")).join(n, "_l").select("_l", slot("id", "_a").alias("_i"), each("_b").alias("_j"), F.lit(True).alias("mine"), "id", "label", "v")
    y = members.withColumn("_l", F.col("label")).join(n, "_l").select("_l", each("_a").alias("_i"), slot("id", "_b").alias("_j"), F.lit(False).alias("mine"), "id", "label", "v")
    kind = {c: members.schema[c].dataType.simpleString() for c in ("id", "label")}

    def sums(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["mine"]], g[~g["mine"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"][:0], "label": a["label"][:0], "label2": b["label"][:0], "total": [], "n": []})
        y = np.stack(b["v"].to_numpy())
        total = _summed_distances(np.stack(a["v"].to_numpy()), y)
        itself = a["id"].map(b["id"].value_counts()).fillna(0).astype(int)
        return pd.DataFrame({"id": a["id"], "label": a["label"], "label2": g["_l"].iloc[0], "total": total, "n": len(b) - itself})

    met = x.unionByName(y).groupBy("_l", "_i", "_j").applyInPandas(sums, f"id {kind['id']}, label {kind['label']}, label2 {kind['label']}, total double, n long")
    return met.groupBy("id", "label", "label2").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").select("id", "label", "label2", (F.col("total") / F.col("n")).alias("d"))


def silhouette(df: DataFrame, single: float = 0.0, block: int = 4000, counted: dict | None = None) -> DataFrame:
    """Mean silhouette (Euclidean) of ``id, label, v array<double>``, exact; a cluster of one scores ``single``.

    The mean distance of a vector to a cluster is at least its distance to the cluster's centre. So each vector is first compared with
    its own cluster and with the one of the nearest centre, and then only with those whose centre is nearer than that
    mean. The centres, as many as a clustering has labels, go to every task. ``counted`` is told the pairs that were computed (``pairs``) and
    all there are. ``pyspark.ml.evaluation.ClusteringEvaluator`` (squared distances) is linear.
    """
    rows = stash(df.select("id", "label", "v"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("size"))
    means = rows.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"))
    centres = means.orderBy("label").collect()
    labels, points = [r["label"] for r in centres], np.array([r["c"] for r in centres])

    @F.pandas_udf("array<double>")
    def bounds(label: pd.Series, v: pd.Series) -> pd.Series:
        """Least mean distances to each label, infinite to the own; a little less, so that rounding loses nothing."""
        return pd.Series([np.where([x != own for x in labels], np.sqrt(((points - u) ** 2).sum(axis=1)) * (1 - 1e-12), np.inf).tolist() for own, u in zip(label, v)])

    names = F.array(*map(F.lit, labels)) if labels else F.array().cast(T.ArrayType(rows.schema["label"].dataType))
    kept = ["id", "label", "v"]
    near = stash(rows.withColumn("least", bounds("label", "v")).withColumn("at", F.array_position("least", F.array_min("least")).cast("int")))
    own = rows.withColumn("label2", F.col("label"))
    first = near.where(F.array_min("least") < float("inf")).select(*kept, F.get(names, F.col("at") - 1).alias("label2"))
    begun = stash(_mean_distances(own.unionByName(first), rows, block))
    reach = begun.where("label <> label2").select("id", F.col("d").alias("_d"))
    others = F.filter(F.transform("least", lambda x, k: F.struct(k.alias("k"), x.alias("x"))), lambda s: (s["x"] < F.col("_d")) & (s["k"] != F.col("at") - 1))
    more = near.join(reach, "id").select(*kept, F.explode(others).alias("_s")).select(*kept, F.get(names, F.col("_s.k")).alias("label2"))
    met = begun.unionByName(_mean_distances(more, rows, block))
    if counted is not None:
        asked = own.select("label2").unionByName(first.select("label2")).unionByName(more.select("label2"))
        total = rows.count()
        counted.update(pairs=asked.join(sizes.withColumnRenamed("label", "label2"), "label2").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], all=total * total)
    per = rows.select("id").join(met.groupBy("id").agg(F.max(F.when(F.col("label") == F.col("label2"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("label2"), F.col("d"))).alias("b")), "id", "left")
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), single).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.agg(F.round(F.avg(s), 6).alias("silhouette"))


def cluster_terms(weights: DataFrame, clusters: DataFrame, n: int = 10) -> DataFrame:
    """``cluster, term, weight, rank``: the terms with the greatest mean weight over a cluster's documents."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    sums = weights.join(clusters.select("content_id", "cluster"), "content_id").groupBy("cluster", "term").agg(F.sum("weight").alias("w")).join(size, "cluster")
    return ranked(sums.select("cluster", "term", F.round(F.col("w") / F.col("size"), 6).alias("weight")), ["cluster"], [F.desc("weight"), F.asc("term")], n)


def centre_terms(sums: DataFrame, clusters: DataFrame, vocab: DataFrame, n: int = 10) -> DataFrame:
    """``cluster_terms`` of the sums ``cluster, at, s`` of ``row_kmeans``, with the terms ``at, term``."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    means = sums.join(size, "cluster").select("cluster", "at", F.round(F.col("s") / F.col("size"), 6).alias("weight"))
    return ranked(means.join(vocab.select("at", "term"), "at").select("cluster", "term", "weight"), ["cluster"], [F.desc("weight"), F.asc("term")], n)


def cluster_by_domain(clusters: DataFrame, domains: DataFrame) -> DataFrame:
    return clusters.join(domains, "content_id").groupBy("cluster", "nicho").agg(F.count("*").alias("n"))


def cluster_summary(clusters: DataFrame, n: int = 3) -> DataFrame:
    """``cluster, size, ejemplos``: the members of each cluster, and the first ``n`` by id."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    few = ranked(clusters.select("cluster", "content_id"), ["cluster"], [F.asc("content_id")], n).groupBy("cluster").agg(F.array_sort(F.collect_list("content_id")).alias("ejemplos"))
    return size.join(few, "cluster")
