import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import segments as sg
from corpusloom.operators import terms as tm


def test_terms_and_windows_are_counted_without_a_shuffle(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "uno", "dos", "tres", "cuatro", "ñandu", "x", "Über"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(30)))) for i in range(200)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "content_id long, text string").repartition(3)
    stop = spark.createDataFrame([("the",), (None,)], "term string")
    twice = docs.unionByName(docs.where("content_id < 3"))
    for d in (docs, twice):
        for s in (None, stop):
            t = tm.tokens(d) if s is None else tm.without(tm.tokens(d), s)
            counted = t.groupBy("content_id", "term").agg(F.count("*").alias("frequency"), F.min("place").alias("place"))
            rank = F.row_number().over(Window.partitionBy("content_id").orderBy(F.desc("frequency"), "place"))
            want = counted.withColumn("rank", rank.cast("long")).where("rank <= 2").drop("place")
            got = tm.key_terms(d, s, 2)
            assert got.columns == want.columns
            plain = lambda df: sorted((r.content_id, r["rank"], r.frequency, "" if d is twice and r.content_id < 3 else r.term) for r in df.collect())
            assert plain(got) == plain(want)
        windows = sg.word_windows(d).groupBy("content_id", "kind", "gram").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        assert sorted(map(tuple, sg.counted_windows(d).collect())) == sorted(map(tuple, windows.collect()))
    for df in (tm.key_terms(docs, stop, 2), sg.counted_windows(docs)):
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert tm.row_counts(docs.limit(0), tx.words(F.col("text"))).count() == 0
