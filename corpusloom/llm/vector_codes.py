"""Vector code compression: product quantisation with equal-average search.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook of its own, refined in rounds
that assign every part to its nearest entry and take the means of what was assigned. The nearest entry is found by an
equal-average search: entries are sorted by their component sum, and the search goes outward from the part's own sum, the
nearer side first. For ``d`` components the squared distance is at least the squared gap of the sums over ``d``, so it
ends when that bound strictly exceeds the best distance: the entry is the nearest, and equal distances go to the lower index.

Each task sums what it assigns, one row for each part position and entry, so what is shuffled doesn't grow with the rows of a task.
Codebooks (``parts x entries`` rows of at most a vector's length) are all that the driver sees.

Defined results: rows whose vector is null, empty, or has null or non-finite components are dropped. The length of
vectors is that of the row with the smallest id; rows of other lengths can't be coded with it and are dropped too. A
length that isn't a multiple of ``parts`` is filled up with zeros. Ids may be null or repeat: null ids come last in the start
codebook, equal ids are ordered by their vectors. Fewer rows than ``entries`` make a smaller codebook. An empty table gives none.
A component of ``limit(length)`` or more (262,144 for 16 components) is an error, as its squares don't fit into 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import stash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SALTS = 16


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, index]`` are whole numbers; ``length`` is that of the vectors before they are filled up."""

    entries: np.ndarray
    length: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def limit(length: int) -> float:
    """Components must be smaller than this, so that the squared distance of two vectors fits into 64 bits."""
    return (1 << 20) / math.sqrt(length)


def whole(vector: Column, length: int) -> Column:
    most = limit(length)
    checked = lambda x: F.when(F.abs(x) < most, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"vector component of {most:.0f} or more")).cast("long"))
    return F.transform(vector.cast("array<double>"), checked)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``parts`` the nearest row of ``book``, its squared distance, and how many distances were computed.

    All rows search in step: each looks at its next entry on the side whose sum is nearer, and leaves when the bound says so."""
    n, d = parts.shape
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    sums, sorted_book = sums[order], book[order]
    size = len(book)
    far = np.iinfo(np.int64).max
    best, index = np.full(n, far), np.full(n, size, np.int64)
    own = parts.sum(1)
    high = np.searchsorted(sums, own)
    low = high - 1
    rows, looked = np.arange(n), 0
    while len(rows):
        s, a, b = own[rows], low[rows], high[rows]
        down = np.where(a >= 0, s - sums[np.maximum(a, 0)], far)
        up = np.where(b < size, sums[np.minimum(b, size - 1)] - s, far)
        gap = np.minimum(down, up)
        go = gap < far
        go[go] = gap[go].astype(float) ** 2 <= best[rows[go]] * (d * (1 + 1e-12))  # rounding may only prolong a search
        rows, a, b, left = rows[go], a[go], b[go], (down <= up)[go]
        at = np.where(left, a, b)
        low[rows] -= left
        high[rows] += ~left
        dist = ((parts[rows] - sorted_book[at]) ** 2).sum(1)
        entry = order[at]
        better = (dist < best[rows]) | ((dist == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = dist[better], entry[better]
        looked += len(rows)
    return index, best, looked


def _parts(column: pa.Array, length: int, parts: int) -> np.ndarray:
    """``[row, part, component]``, filled up with zeros."""
    flat = column.flatten().to_numpy().reshape(len(column), length)
    if length % parts:
        flat = np.pad(flat, ((0, 0), (0, parts - length % parts)))
    return flat.reshape(len(column), parts, -1)


def _rows(vectors: DataFrame, length: int, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    return vectors.where(usable(v) & (F.size(v) == length)).withColumn(vector_col, whole(v, length))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all usable rows, or none if there are none. ``rounds`` jobs, each over all rows."""
    kept = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    by = (F.col("i").isNull(), "i", "v")
    first = kept.orderBy(*by).limit(1).select(F.size("v")).first()
    if not first:
        return None
    length = first[0]
    start = _rows(kept.where(F.size("v") == length).orderBy(*by).limit(entries), length, "v").collect()  # at most ``entries`` rows
    start = sorted(start, key=lambda r: (r["i"] is None, 0 if r["i"] is None else r["i"], r["v"]))
    books = _parts(pa.array([r["v"] for r in start], pa.list_(pa.int64())), length, parts).transpose(1, 0, 2).copy()
    rows = _rows(kept.select("v"), length, "v")
    width = books.shape[2]
    for _ in range(rounds):

        def assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for b in batches:
                x = _parts(b.column(0), length, parts)
                for p in range(parts):
                    index, _, _ = nearest(x[:, p], books[p])
                    counts[p] += np.bincount(index, minlength=len(books[p]))
                    np.add.at(sums[p], index, x[:, p])
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        told = rows.mapInArrow(assigned, "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
        means = told.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums"))
        books = books.copy()
        for r in means.collect():  # at most ``parts x entries`` rows
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return Codebooks(books, length)


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", carry: list[str] = ["vec_id"]) -> DataFrame:  # noqa: B006
    """``carry``, ``code`` (hex digits of the entry of each part, two for up to 256 entries) and ``error`` (squared distance) of each usable row; a narrow step."""
    parts, size = books.entries.shape[:2]
    digits = max(2, len(f"{size - 1:x}"))
    hexed = np.array([f"{k:0{digits}x}" for k in range(size)])
    names = [f"_c{i}" for i in range(len(carry))]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _parts(b.column(b.num_columns - 1), books.length, parts)
            found = [nearest(x[:, p], books.entries[p])[:2] for p in range(parts)]
            code = ["".join(c) for c in zip(*(hexed[index].tolist() for index, _ in found))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(code, pa.string()), pa.array(sum(e for _, e in found), pa.int64())], [*b.schema.names[:-1], "_code", "_error"])

    rows = _rows(vectors.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), F.col(vector_col).cast("array<double>").alias("_v")), books.length, "_v")
    kinds = T.StructType([*(T.StructField(n, rows.schema[n].dataType) for n in names), T.StructField("_code", T.StringType()), T.StructField("_error", T.LongType())])
    return rows.mapInArrow(coded, kinds).select(*(F.col(n).alias(c) for c, n in zip(carry, names)), F.col("_code").alias("code"), F.col("_error").alias("error"))


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", vector_col: str = "decoded") -> DataFrame:
    """Adds the vector that a code stands for, back in the scale of the input (up to the error of rounding down)."""
    parts, size = books.entries.shape[:2]
    digits = max(2, len(f"{size - 1:x}"))

    @F.arrow_udf("array<double>")
    def read(codes: pa.Array) -> pa.Array:
        found = (None if x is None else np.concatenate([books.entries[p, int(x[p * digits : (p + 1) * digits], 16)] for p in range(parts)])[: books.length] / SCALE for x in codes.to_pylist())
        return pa.array([None if v is None else v.tolist() for v in found], pa.list_(pa.float64()))

    return codes.withColumn(vector_col, read(code_col))


def with_label_errors(codes: DataFrame, label_col: str = "label", spread_by: str = "vec_id") -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over all rows of the same label (nulls together). Labels are summed map-side;
    the sums are there once for each salt, so that rows of a label that many have spread over as many tasks, by ``spread_by``."""
    codes = stash(codes)
    key = F.struct(F.col(label_col).alias("l"))
    sums = codes.groupBy(key.alias("_l")).agg(F.sum("error").alias("label_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return codes.withColumns({"_l": key, "_salt": F.pmod(F.xxhash64("code", "error", spread_by), F.lit(SALTS)).cast("int")}).join(sums, ["_l", "_salt"]).drop("_l", "_salt")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_v"))
    books = fit(rows, "vec_id", "_v", parts, entries, rounds) or Codebooks(np.zeros((parts, 1, 1), np.int64), parts)
    coded = with_label_errors(encode(rows.where(usable(F.col("_v"))), books, "_v", ["vec_id", "label"]))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rows by comparing every part with every entry, for DuckDB."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1024) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "d AS MATERIALIZED (SELECT arg_min(len(v), vec_id) // 4 AS d FROM v)",
        "x AS MATERIALIZED (SELECT vec_id, p, v[p * d + 1 : p * d + d] AS x FROM v, d, (VALUES (0), (1), (2), (3)) t(p))",
        "first AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 256)",
        "b0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN first USING (vec_id))",
    ]
    near = "SELECT vec_id, p, min({{'q': q, 'e': e}}) AS m FROM (SELECT x.vec_id, x.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS q FROM x JOIN b{k} b ON x.p = b.p) GROUP BY ALL"
    for k in range(4):
        steps += [
            f"a{k} AS MATERIALIZED ({near.format(k=k)})",
            f"m{k} AS MATERIALIZED (SELECT p, e, list(f ORDER BY i) AS c FROM (SELECT a.p, m.e AS e, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS f FROM a{k} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p, d, LATERAL (SELECT unnest(range(1, d + 1)) AS i) GROUP BY ALL) GROUP BY ALL)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)",
        ]
    steps += [
        f"a4 AS MATERIALIZED ({near.format(k=4)})",
        "coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.q) AS BIGINT) AS error FROM a4 GROUP BY vec_id)",
        "book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)",
    ]
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), book"


SQL = _sql()
