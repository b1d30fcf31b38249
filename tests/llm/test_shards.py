from pyspark.sql import functions as F

from corpusloom.llm import shards


def test_every_shard_fits(spark):
    rows = [(i, "t" * (i % 50)) for i in range(3000)] + [(1, "key with many rows " + str(i)) for i in range(1000)] + [(7, "big" * 5000)] + [(2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shards.assign(df, limit=3000, step=4).cache()
    assert out.count() == len(rows)
    by = out.groupBy("shard").agg(F.sum("row_bytes").alias("b"), F.max("shard_bytes").alias("s"), F.count("*").alias("n"), F.max("oversized").alias("o")).collect()
    assert all(r.b == r.s for r in by) and all(r.b <= 3000 or (r.n == 1 and r.o) for r in by)
    names = sorted(r.shard for r in by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # prefix free
    sums = {}
    for r in by:
        for d in range(len(r.shard)):
            sums[r.shard[:d]] = sums.get(r.shard[:d], 0) + r.b
    assert all(s > 3000 for s in sums.values())  # only oversized buckets have split


def test_repeated_rows_and_names(spark):
    df = spark.createDataFrame([(1, "x" * 100, "s")] * 90, "doc_id long, text string, shard string").repartition(3)
    out = shards.assign(df, limit=1000, step=30)
    assert {"shard", "shard_"} <= set(out.columns)
    by = out.groupBy("shard_", "copy").agg(F.sum("row_bytes").alias("b")).collect()
    assert len(by) == 10 and all(r.b <= 1000 for r in by) and out.count() == 90
    again = shards.assign(df.repartition(7), limit=1000, step=30)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_brute_force(spark):
    """Extendible hashing row by row: a bucket above the limit splits on its next bit."""
    rows = [(i % 700, "t" * (i % 90), [i % 3] * (i % 40), None if i % 2 else {"k": "v" * (i % 20)}) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, numbers array<int>, tags map<string,string>")
    keyed = df.select(shards.row_hash(df).alias("bits"), shards.row_bytes(df).alias("bytes")).collect()
    for limit in (1500, 20_000):
        buckets = {"": []}
        for r in keyed:
            at = next(p for p in (r.bits[:d] for d in range(65)) if p in buckets)
            buckets[at].append(r)
            todo = [at]
            while todo:
                p = todo.pop()
                if len(p) < 64 and sum(x.bytes for x in buckets[p]) > limit:
                    full = buckets.pop(p)
                    for c in "01":
                        buckets[p + c] = [x for x in full if x.bits[len(p)] == c]
                        todo.append(p + c)
        want = {p: (len(x), sum(y.bytes for y in x)) for p, x in buckets.items() if x}
        got = shards.assign(df, limit=limit, step=5).groupBy("shard").agg(F.count("*").alias("n"), F.sum("row_bytes").alias("b")).collect()
        assert {r.shard: (r.n, r.b) for r in got} == want


def test_nested_bytes(spark):
    df = spark.createDataFrame([(i, ["x" * 10_000]) for i in range(20)], "doc_id long, parts array<string>")
    assert all(r.oversized and r.row_bytes > 10_000 for r in shards.assign(df, limit=2000).collect())


def test_one_and_none(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert shards.assign(df).select("shard", "copy").collect() == [("", 0)]
    assert shards.assign(df.limit(0)).count() == 0


def test_maps_at_any_depth(spark):
    df = spark.range(40).selectExpr("id as doc_id", "named_struct('m', map('k', id), 'x', array(map('a', cast(id as string)))) as s", "array(map(id, null)) as a", "map('z', id) as m")
    out = shards.assign(df, limit=200, step=3)
    assert out.count() == 40 and out.select("shard").distinct().count() > 5 and out.columns[:4] == df.columns
