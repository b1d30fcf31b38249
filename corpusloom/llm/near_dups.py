"""Near duplicates by DartMinHash.

A text is the multiset of its shingles of five words (lower case, split at white space; a shorter text is one shingle);
a shingle's count is its weight, and similarity is weighted Jaccard, sum of minima over sum of maxima, 0.8 or more.

Signatures: each unit of weight of each shingle is a region in which hashed darts arrive as a Poisson process along a
rank axis, the same in every document that holds it. A document looks at all its regions up to the rank at which about
``k ln k + 2k`` darts have arrived over all of them, however many shingles it has, throws each dart at one of ``k``
coordinates and keeps the earliest on each. Two documents agree on a coordinate with the probability of their weighted
Jaccard similarity. Documents that left a coordinate empty look further.

Links: texts that are equal are one node. ``BANDS`` bands of ``ROWS`` coordinates are joined. First each text is paired
with one hub, the text of its buckets that meets most others. Then, in buckets whose texts aren't together by that,
all texts that aren't are compared inside tasks, by blocks, on sketches of ``LONG`` coordinates, and pairs within 4.5
standard errors of the threshold are proposed. Every proposed pair is decided exactly on its texts, and connected
components are classes. So a group of n copies costs about n pairs, documents that share a passage cost none, and a
similar pair is lost only if no band agrees (7 in 10,000 at 0.8).

Ids are whole numbers or null (they are read as long). Null, empty and blank texts are like nothing: each row is a class of its own. Repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import connected_components, stash, trimmed

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 6
#: Coordinates of the long sketches, made only of texts whose buckets aren't settled by their hubs.
LONG = 512
BLOCK = 1000
TABLE = 80_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of a public generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words, self.table = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes of all shingles, repeats included."""
        w = (text or "").lower().split()
        if not w:
            return np.zeros(0, _U)
        table = self.table
        for x in set(w).difference(table):
            table[x] = xxhash.xxh64_intdigest(x)
        h = np.fromiter(map(table.__getitem__, w), _U, len(w))
        if len(table) > TABLE:
            table.clear()
        n = min(self.words, len(h))
        s = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            s = s * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        s = mix(s + _U(n))
        s.sort()
        return s


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted multisets."""
    if not len(a) or not len(b):
        return 0.0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (len(a) + len(b) - low)


def signatures(docs: list[np.ndarray], k: int) -> np.ndarray:
    """A row of ``k`` dart ids for each non-empty sorted multiset."""
    sizes = np.array([len(d) for d in docs])
    out = np.zeros((len(docs), k), _U)
    if not len(docs):
        return out
    shingle = np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs)), sizes)
    begin = np.r_[True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])]
    at = np.arange(len(shingle))
    copy = at - np.maximum.accumulate(np.where(begin, at, 0))
    region = mix(shingle + mix(copy.astype(_U)))
    todo, darts = np.ones(len(docs), bool), k * np.log(k) + 2 * k
    while True:
        limit = darts / sizes
        keep = todo[doc]
        r, d, rank = region[keep], doc[keep], np.zeros(int(keep.sum()))
        flat, ranks, ids = [], [], []
        j = 0
        while len(r):
            j += 1
            x = mix(r + _U(j * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((x >> _U(11)).astype(np.float64) + 1) / 2.0**53)
            hit = rank < limit[d]
            r, d, rank, x = r[hit], d[hit], rank[hit], x[hit]
            flat.append(d * k + (mix(x + _U(1)) % _U(k)).astype(np.int64))
            ranks.append(rank)
            ids.append(mix(x + _U(2)) | _U(1))
        flat, ids, order = np.concatenate(flat), np.concatenate(ids), np.argsort(-np.concatenate(ranks), kind="stable")
        rows = out.reshape(-1)
        rows[flat[order]] = ids[order]  # the last to be put is the earliest
        todo = (out == 0).any(axis=1)
        if not todo.any():
            return out
        out[todo] = 0
        darts *= 2


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, uid: str | None = None) -> DataFrame:
    """``doc_id, key, n, bands array<long>`` of every row; key, a digest of the text, is null if it has no words."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)

        def part(ids: list, uids: list, sets: list[np.ndarray], keys: list) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full], k)
            b = np.zeros((len(full), bands), _U)
            for j in range(rows):
                b = mix(b * _U(31) + sig[:, j::rows])
            b = mix(b + np.arange(bands, dtype=_U)[None, :]).view(np.int64)
            lists = [None] * len(ids)
            for q, i in enumerate(full):
                lists[i] = b[q]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(lists, pa.list_(pa.int64())), *([pa.array(uids, pa.int64())] if uid else [])], ["doc_id", "key", "n", "bands", *(["uid"] if uid else [])])

        for batch in trimmed(batches):
            ids, uids, sets, keys, size = [], [], [], [], 0
            for i, t, q in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = t.as_py()
                s = shingler(t)
                ids.append(i)
                uids.append(q)
                sets.append(s)
                keys.append(hashlib.md5(t.encode()).digest() if len(s) else None)
                size += len(s)
                if size > 250_000 or len(ids) >= 400:
                    yield part(ids, uids, sets, keys)
                    ids, uids, sets, keys, size = [], [], [], [], 0
            yield part(ids, uids, sets, keys)

    number = F.col(uid).cast("long") if uid else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), number.alias("uid")).mapInArrow(run, "doc_id long, key binary, n long, bands array<long>" + ", uid long" * bool(uid))


def verified(pairs: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """The pairs ``(u, v)`` of keys whose texts are similar."""
    met = pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("key").alias("v"), F.col("text").alias("tv")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        known: dict[bytes, np.ndarray] = {}

        def of(key: bytes, text: str) -> np.ndarray:
            if key not in known:
                if len(known) > 200:
                    known.clear()
                known[key] = shingler(text)
            return known[key]

        for b in trimmed(batches):
            us, vs = b.column(0).to_pylist(), b.column(2).to_pylist()
            ok = [similarity(of(u, tu.as_py()), of(v, tv.as_py())) >= similar for u, tu, v, tv in zip(us, b.column(1), vs, b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, o in zip(us, ok, strict=True) if o], pa.binary()), pa.array([x for x, o in zip(vs, ok, strict=True) if o], pa.binary())], ["u", "v"])

    return met.select("u", "tu", "v", "tv").mapInArrow(run, "u binary, v binary")


def sketches(texts: DataFrame, words: int, k: int = LONG) -> DataFrame:
    """``key, long``: a byte of each of ``k`` coordinates of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in trimmed(batches):
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                sig = signatures([shingler(t.as_py()) for t in part.column(1)], k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in (sig >> _U(9) & _U(255)).astype(np.uint8)], pa.binary())], ["key", "long"])

    return texts.select("key", "text").mapInArrow(run, "key binary, long binary")


def proposed(rows: DataFrame, similar: float, block: int = BLOCK) -> DataFrame:
    """Pairs of texts that share a bucket, aren't together yet and aren't ruled out by sizes or long sketches.

    A bucket above ``block`` texts is cut into blocks, and each pair of blocks is a task of its own; pairs are compared
    inside, and one that meets in several buckets is proposed in the first only.
    """
    size = rows.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    cut = rows.join(size, "band").withColumn("part", F.pmod(F.xxhash64("key", "band"), F.col("parts")).cast("int"))
    cut = cut.withColumn("pair", F.explode(F.expr("transform(sequence(0, parts - 1), q -> struct(least(q, part) as a, greatest(q, part) as b))"))).select("*", "pair.a", "pair.b").drop("pair", "parts")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        part, a, b = t["part"].to_numpy(), t["a"][0].as_py(), t["b"][0].as_py()
        i, j = np.flatnonzero(part == a), np.flatnonzero(part == b)
        sketch = np.frombuffer(b"".join(t["long"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        n = t["n"].to_numpy()
        ids = t["key"].to_pylist()
        roots = {r: q for q, r in enumerate(dict.fromkeys(t["root"].to_pylist()))}
        root = np.array([roots[r] for r in t["root"].to_pylist()])
        main = np.array([r == m for r, m in zip(t["root"].to_pylist(), t["main"].to_pylist(), strict=True)])
        bands, band = np.array(t["bands"].to_pylist(), np.int64), t["band"][0].as_py()
        least = similar - 4.5 * (similar * (1 - similar) / sketch.shape[1]) ** 0.5
        us, vs = [], []
        for x in i:
            y = j[j > x] if a == b else j
            y = y[(root[y] != root[x]) & (np.minimum(n[y], n[x]) >= similar * np.maximum(n[y], n[x])) & ~(main[y] & main[x])]
            if len(y):
                y = y[(sketch[y] == sketch[x]).mean(axis=1) >= least]
            if len(y):
                same = bands[y] == bands[x]
                y = y[same.argmax(axis=1) == np.flatnonzero(bands[x] == band)[0]]
                us += [min(ids[x], ids[q]) for q in y]
                vs += [max(ids[x], ids[q]) for q in y]
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return cut.groupBy("band", "a", "b").applyInArrow(compare, "u binary, v binary")


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, similar: float = SIMILAR, uid: str | None = None) -> DataFrame:
    """``doc_id, uid, class_id, kept`` for every row of ``docs``: uid numbers the rows (or is the column given), class_id is the least doc_id of the class (null if all are null), one row of each class is kept: that with the least doc_id, nulls last."""
    signed = sign(docs, bands, rows, words, uid)
    signed = stash(signed if uid else signed.withColumn("uid", F.monotonically_increasing_id()))
    nodes = signed.where("key is not null").groupBy("key").agg(F.min("uid").alias("uid"))
    nodes = stash(signed.join(nodes.select("uid"), "uid", "left_semi").select("key", "n", "bands", "doc_id"))
    each = nodes.select("key", "n", F.explode("bands").alias("band"))
    sizes = each.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = stash(each.join(sizes, "band"))
    central = met.groupBy("key").agg(F.sum("size").alias("score"))  # a group's origin meets most of it
    hubs = met.join(central, "key").groupBy("band").agg(F.max(F.struct("score", "key", "n")).alias("hub"))

    involved = met.select("key").distinct().join(nodes.select("key", "doc_id"), "key")
    here = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("md5"))
    same = (F.col("md5") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc_id"))  # rows without an id are texts too
    texts = stash(here.join(involved, same).select("key", "text").dropDuplicates(["key"]))

    fits = lambda a, b: F.least(a, b) >= similar * F.greatest(a, b)
    first = met.select("band", "key", "n").join(hubs, "band").where("key <> hub.key").where(fits(F.col("n"), F.col("hub.n")))
    first = first.groupBy("key").agg(F.max("hub").alias("hub")).select(F.col("hub.key").alias("u"), F.col("key").alias("v"))
    links = stash(verified(first, texts, words, similar))

    # a text's root: what it linked to, or what that linked to
    up = links.select(F.col("v").alias("key"), F.col("u").alias("up"))
    root = up.join(up.select(F.col("key").alias("up"), F.col("up").alias("top")), "up", "left").select("key", F.coalesce(F.nullif("top", "key"), "up").alias("root"))
    placed = met.select("band", "key", "n").join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = placed.groupBy("band", "root").agg(F.count("*").alias("size")).groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    unresolved = placed.join(open_.select("band", "main"), "band")
    long = stash(sketches(unresolved.select("key").distinct().join(texts, "key"), words))
    unresolved = unresolved.join(long, "key").join(nodes.select("key", "bands"), "key")
    more = proposed(unresolved, similar).distinct()
    links = stash(links.unionByName(verified(more, texts, words, similar)))

    groups = connected_components(links).select(F.col("id").alias("key"), F.col("component_id").alias("group"))
    grouped = signed.select("doc_id", "uid", "key").join(groups, "key", "left").withColumn("group", F.coalesce("group", "key", F.to_binary(F.hex("uid"), F.lit("hex"))))
    grouped = stash(grouped.select("doc_id", "uid", "group"))
    first = stash(grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")))  # else its sums and the join share tasks, and a large group can't be split
    return grouped.join(first, "group").select("doc_id", "uid", F.col("first.doc_id").alias("class_id"), (F.col("uid") == F.col("first.uid")).alias("kept"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least doc_id; all columns as they were."""
    uid = "__uid"
    while uid in docs.columns:
        uid += "_"
    numbered = stash(docs.withColumn(uid, F.monotonically_increasing_id()))
    # what goes is less than what stays, so Spark may find it small enough to send to the texts
    gone = stash(classes(numbered.select("doc_id", "text", uid), uid=uid, **parameters).where("not kept").select(F.col("uid").alias(uid)))
    return numbered.join(gone, uid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
