import itertools
import random

from pyspark.sql import functions as F

from corpusloom.llm import bpe, packing


def padding(hist, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in hist)


def test_least_padding():
    rng = random.Random(3)
    for _ in range(200):
        lengths = rng.sample(range(1, 60), rng.randint(1, 9))
        hist = [(x, rng.randint(1, 9)) for x in lengths]
        for k in (1, 2, 3, 5):
            ends = packing.optimal_ends(hist, k)
            assert len(ends) <= k and max(ends) == max(lengths)
            best = min(padding(hist, [*c, max(lengths)]) for n in range(k) for c in itertools.combinations(lengths, n))
            assert padding(hist, ends) == best
    assert packing.optimal_ends([]) == []


def test_batches(spark):
    rng = random.Random(1)
    rows = [(i, None if i == 5 else "" if i == 6 else "w, " * rng.randint(1, 300), "clash") for i in range(800)] + [(9, "same", "x")] * 5 + [(1000, "long " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch_id string").repartition(3)
    out = packing.pack(df, buckets=4, budget=2000).cache()
    assert out.count() == len(rows) and sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in rows)
    by = out.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("n_tokens").alias("m"), F.max("padded_length").alias("p"), F.countDistinct("place").alias("d"), F.countDistinct("bucket").alias("b")).collect()
    assert all(r.n * r.p <= 2000 or r.n == 1 for r in by) and all(r.d == r.n and r.b == 1 and r.m <= r.p for r in by)
    assert len(by) < 260
    assert packing.pack(df.limit(0)).count() == 0
    assert {r.n_tokens for r in out.where("doc_id in (5, 6)").collect()} == {1}


def test_rounding_is_bounded(spark):
    df = spark.range(65_530, 3_000_000, 7).select(packing.rounded(F.col("id")).alias("r"), "id")
    assert df.where("r < id or r > id * 1.002").count() == 0
    assert df.select("r").distinct().count() < 4000


def test_lengths_are_those_of_the_tokenizer(spark):
    texts = ["plain words of a text, with signs!", "qzxjv" * 12_000, "\u6c49\u5b57\u53e5\u5b50" * 50, "", None, "<|endoftext|> a\n\n  b 12345678"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: max(1, len(r.ids)) for r in bpe.encode(df).collect()}
    got = {r.doc_id: r for r in packing.pack(df, buckets=3, budget=500).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == want
    assert want[1] > 10_000 and got[1].batch_id not in {r.batch_id for i, r in got.items() if i != 1}
    assert {r.doc_id: r.n_tokens for r in packing.pack(df, length=packing.pretokens()).collect()}[1] == 1


def test_equal_rows_are_dealt(spark):
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text")).unionByName(spark.range(300).selectExpr("id + 100 as doc_id", "concat('text ', id) as text"))
    out = packing.pack(df, buckets=2, budget=1000, length=F.length("text")).cache()
    assert out.count() == 20_300 and out.where("doc_id = 7").count() == 20_000
    group = F.regexp_extract("batch_id", "^[0-9]+-[0-9]+", 0)
    sizes = sorted(r["count"] for r in out.groupBy(group.alias("g")).count().collect())
    assert len(sizes) > 40 and sizes[-1] < 4 * 256
    by = out.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("padded_length").alias("p"), F.countDistinct("place").alias("d")).collect()
    assert all(r.n * r.p <= 1000 and r.d == r.n for r in by)
