"""Filter interaction audit: what each filter of a chain removes, in every order.

Each document becomes a 32-bit word: bit ``S`` is set if it survives the filters of subset ``S`` of the five. Carry-save
adders sum these words bit by bit: three words of equal weight become one of that weight and one of twice it, so sixteen are
folded before any bit is counted. The sums say for each part (and within it for good and for toxic documents) how many
survive each subset, and all else follows from these 32 numbers: what any order keeps after each step, what a filter
removes there, what others removed before it, and its share over all orders.

The filters: A under 100 words, B fewer than 80 distinct words in 100, C more than 10 capitals in 100 characters, D any of
``#$%&*|``, E a text that a smaller id has too, anywhere in the table.

Defined results: a null text is empty. A null id is no smaller than any, and its rows don't repeat others; of rows with
equal ids and texts none is a repeat of the other. A null language is the part with the empty name. Several label rows of a document count as the
greatest of each label. Other columns are ignored; an empty table has no parts, so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import bind
from corpusloom.llm.common import stash

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Groups whose counts a task holds before it hands them on.
HELD = 4096
#: The word of a document that fails the filters of mask ``m``: bit S is set if S has none of them.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], np.uint32)


def content_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    told = bind(words, lambda w: F.when(F.size(w) < 100, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 2).otherwise(0))
    capitals = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"), 4).otherwise(0)
    return told + capitals + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, good, toxic`` of each document. Texts leave their rows as digests: what is shuffled is ids and digests.
    A digest that many share is joined with its one first id, which Spark may split."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    told = stash(rows.select("i", "part", content_mask(F.col("t")).cast("int").alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest")))
    firsts = told.groupBy("digest").agg(F.min("i").alias("first"), F.max("i").alias("_last")).where("first < _last").drop("_last")
    known = labels.groupBy(F.col("doc_id").alias("i")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return told.join(firsts, "digest", "left").select("i", "part", F.when(F.col("i") > F.col("first"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask")).join(known, "i", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder in each of the 32 bit positions: sum and carry of three words."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set. Blocks of sixteen are added into words of weight 1, 2, 4 and 8 that stay,
    and of 16, whose bits are counted; the lanes of the arrays are blocks side by side."""
    lanes = max(1, min(1024, len(words) // 16))
    whole = len(words) // (16 * lanes) * 16 * lanes
    ones, twos, fours, eights = (np.zeros(lanes, np.uint32) for _ in range(4))
    total = np.zeros(32, np.int64)
    place = np.arange(32, dtype=np.uint32)

    def count(x: np.ndarray) -> np.ndarray:
        return ((x[:, None] >> place) & np.uint32(1)).sum(0, dtype=np.int64)

    for block in words[:whole].reshape(-1, 16, lanes):
        carried = {2: [], 4: [], 8: []}
        for k in range(0, 16, 2):
            ones, two = _add(ones, block[k], block[k + 1])
            carried[2].append(two)
        for k in range(0, 8, 2):
            twos, four = _add(twos, carried[2][k], carried[2][k + 1])
            carried[4].append(four)
        for k in range(0, 4, 2):
            fours, eight = _add(fours, carried[4][k], carried[4][k + 1])
            carried[8].append(eight)
        eights, sixteen = _add(eights, *carried[8])
        total += 16 * count(sixteen)
    return total + count(ones) + 2 * count(twos) + 4 * count(fours) + 8 * count(eights) + count(words[whole:])


def survivors(marked: DataFrame) -> DataFrame:
    """``part, everyone, good, toxic``: of each part the survivors of each of the 32 subsets, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def told() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array([held[k].tolist() for k in keys], pa.list_(pa.int64()))], ["part", "kind", "counts"])

        for b in batches:
            part, names = b.column(0).dictionary_encode(), None
            names = part.dictionary.to_pylist()
            words = WORDS[b.column(1).to_numpy()]
            at = part.indices.to_numpy()
            kinds = [np.ones(len(at), bool), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)]
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(len(names) + 1))
            for k, name in enumerate(names):
                own = order[edges[k] : edges[k + 1]]
                for kind, has in enumerate(kinds):
                    counts = bit_counts(words[own[has[own]]])
                    held[name, kind] = held[name, kind] + counts if (name, kind) in held else counts
            if len(held) >= HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    counted = marked.select("part", "mask", "good", "toxic").mapInArrow(run, "part string, kind int, counts array<long>")
    cell = lambda kind, s: F.sum(F.when(F.col("kind") == kind, F.col("counts")[s]).otherwise(0))
    return counted.groupBy("part").agg(*(F.array(*(cell(k, s) for s in range(SUBSETS))).alias(c) for k, c in enumerate(("everyone", "good", "toxic"))))


def _plan() -> list[tuple]:
    """Each step of each order: its name, number, filter, and the subsets before and after it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), k + 1, f, before, before | 1 << f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order and step; see the module."""
    plan = _plan()
    steps = F.array(*(F.struct(F.lit(name).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("f"), F.lit(b).alias("b"), F.lit(a).alias("a")) for name, k, f, b, a in plan))
    counts = stash(survivors(masks(docs, labels, id_col, text_col, part_col)))  # 96 numbers for each part
    shares = [sum((F.col("everyone")[b] - F.col("everyone")[a] for _, _, g, b, a in plan if g == f), F.lit(0)) for f in range(len(FILTERS))]
    each = counts.select("*", F.array(*shares).alias("_shares")).withColumn("s", F.explode(steps))
    of = lambda c, s: F.get(F.col(c), s)
    gone = lambda c: of(c, F.col("s.b")) - of(c, F.col("s.a"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("s.f"))
    return each.select(
        "part",
        "s.filter_order",
        "s.step",
        of("everyone", F.col("s.a")).alias("kept"),
        gone("everyone").alias("removed"),
        (of("everyone", F.lit(0)) - of("everyone", bit) - gone("everyone")).alias("redundant"),
        (of("everyone", F.lit(SUBSETS - 1) - bit) - of("everyone", F.lit(SUBSETS - 1))).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        of("_shares", F.col("s.f")).alias("shapley"),
    )


#: The same rows for DuckDB: every document against every step.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS lo FROM t),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > lo THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
letters(i, c) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, k AS step, o[k] AS i, 1 << o[k] AS bit, coalesce(list_sum(list_transform(o[:k - 1], lambda x: 1 << x)), 0)::INTEGER AS b FROM orders, range(1, 6) r(k)),
g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, i,
  sum(CASE WHEN mask & (b | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & b = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & b <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & b = 0 AND mask & bit <> 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN mask & b = 0 AND mask & bit <> 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM g
"""
