"""Batches from optimal length buckets.

The length of a document is its number of BPE tokens; any other column can be given instead. Tokens are counted once, and
what later steps read is a stashed row of id, length and hash for each document.

One aggregate gives the histogram of lengths over all documents. A dynamic programme over it places the bucket ends so
that the padding of all documents together is least: with lines sorted by slope each layer takes one pass over the
lengths. Inside a bucket, documents are padded to its end and form batches of at most ``budget`` tokens.

Lengths up to ``EXACT`` count as they are, longer ones round up in steps of about a thousandth, so the histogram that the
driver reads has a fixed bound, whatever the number of documents. A bucket is dealt into groups by a hash of the rows and, of
equal rows, their number, so none is larger than some hundred documents; each group can leave one batch short. Documents longer than the budget
are batches of their own. Null and empty texts have length 1. An empty table has no batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import bpe
from corpusloom.llm.common import stash, trimmed

BUCKETS = 16
BUDGET = 16_384
EXACT = 65_536
GROUP = 256
#: Equal rows that a task numbers.
COPIES = 1000


def pretokens(text: str = "text") -> Column:
    """Words, numbers and single signs: a cheap length that is about half the number of BPE tokens; for ``pack(length=pretokens())``."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")), F.lit(0))).cast("long")


def with_tokens(docs: DataFrame, path: str | None = None, known_words: int = bpe.KNOWN_WORDS) -> DataFrame:
    """``id, text, hash`` to ``id, n_tokens, hash``; a worker keeps the lengths of ``known_words`` words, some 250 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(path or bpe.default_path())
        c.held = known_words
        for b in trimmed(batches):
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                n = np.maximum(1, np.array(c.counts(part.column(1).to_pylist()), np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), part.column(2)], ["id", "n_tokens", "hash"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, hash long")


def rounded(n: Column) -> Column:
    """Above EXACT, up to a multiple of 2**(bits - 10)."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(n)) - 9).cast("long")
    return F.when(n <= EXACT, n).otherwise(F.ceil(n / step).cast("long") * step)


def optimal_ends(histogram: Sequence[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Bucket ends (lengths) with the least total padding for ``(length, documents)``, at most ``buckets`` of them."""
    hist = sorted(histogram)
    if not hist:
        return []
    n, lengths = len(hist), [x for x, _ in hist]
    count, total = [0], [0]
    for x, c in hist:
        count.append(count[-1] + c)
        total.append(total[-1] + c * x)
    best: list[int | None] = [0] + [None] * n
    back = []
    for _ in range(min(buckets, n)):
        new, cut = list(best), list(range(n + 1))  # cut[j] == j: no further bucket ends at j
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i; slopes fall
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                m, b = -count[i], best[i] + total[i]
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2:]
                    if (b - b1) * (m1 - m2) > (b2 - b1) * (m1 - m):
                        break
                    hull.pop()
                hull.append((m, b, i))
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, i = hull[head]
                cost = m * x + b + x * count[j] - total[j]
                if new[j] is None or cost < new[j]:
                    new[j], cut[j] = cost, i
        back.append(cut)
        best = new
    ends, j = [], n
    for cut in reversed(back):
        if j and cut[j] != j:
            ends.append(lengths[j - 1])
            j = cut[j]
    return ends[::-1]


def _numbered(counted: DataFrame) -> DataFrame:
    """A row for each of ``n`` equal ones, with its ``copy`` number. Many are numbered in parts, on several tasks."""
    numbers = lambda first, last: F.explode(F.sequence(first, last - 1))
    few = counted.where(F.col("n") <= COPIES).select("id", "n_tokens", "hash", numbers(F.lit(0).cast("long"), F.col("n")).alias("copy"))
    parts = counted.where(F.col("n") > COPIES).withColumn("part", numbers(F.lit(0).cast("long"), F.ceil(F.col("n") / COPIES))).repartition("hash", "part")
    many = parts.select("id", "n_tokens", "hash", numbers(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES)).alias("copy"))
    return few.unionByName(many)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, id_col: str = "doc_id", known_words: int = bpe.KNOWN_WORDS) -> DataFrame:
    """``id, n_tokens, bucket, padded_length, batch_id, place`` for every document; its length is that of its BPE ids or the column ``length``."""
    row_id, row_hash = F.col(f"`{id_col}`").alias("id"), F.xxhash64(*(F.col(f"`{c}`") for c, d in docs.dtypes if "map" not in d)).alias("hash")
    if length is None:
        sized = with_tokens(docs.select(row_id, F.col("text").cast("string").alias("text"), row_hash), known_words=known_words)
    else:
        sized = docs.select(row_id, F.greatest(F.lit(1), F.coalesce(length, F.lit(0))).cast("long").alias("n_tokens"), row_hash)
    sized = stash(sized.groupBy("id", "n_tokens", "hash").agg(F.count("*").alias("n")))
    hist = {r[0]: r[1] for r in sized.groupBy(rounded(F.col("n_tokens")).alias("x")).agg(F.sum("n")).collect()}
    ends = optimal_ends(list(hist.items()), buckets)
    caps = [max(1, budget // e) for e in ends]
    sizes = [sum(c for x, c in hist.items() if a < x <= b) for a, b in zip([0, *ends], ends, strict=False)]
    groups = [max(1, -(-s // (c * max(1, GROUP // c)))) for s, c in zip(sizes, caps, strict=True)]
    bucket = sum(((rounded(F.col("n_tokens")) > e).cast("int") for e in ends), F.lit(0))
    of = lambda values: F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values or [1])), F.col("bucket") + 1)
    dealt = _numbered(sized).withColumn("bucket", bucket).withColumn("group", F.pmod(F.when(F.col("copy") == 0, F.col("hash")).otherwise(F.xxhash64("hash", "copy")), of(groups)))
    place = F.row_number().over(Window.partitionBy("bucket", "group").orderBy("id", "hash", "copy")) - 1
    out = dealt.withColumn("i", place).withColumn("cap", of(caps))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "bucket", of(ends).alias("padded_length"), F.concat_ws("-", "bucket", "group", F.expr("i div cap")).alias("batch_id"), F.expr("cast(i % cap as int)").alias("place")
    )
