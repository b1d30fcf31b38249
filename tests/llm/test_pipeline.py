import random
import zlib

import corpus_pipeline
from corpusloom.llm import near_dups


def test_keep_one_keeps_columns(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "y"), (2, "a b c d e f g h", "y"), (3, None, "z"), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__uid` string")
    out = near_dups.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad = ["grumblewort", "snarfle", "blatherskite", "nitwit"]
    docs, labels = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(4):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        docs.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + i, docs[1][1] + f" tail{i}", "en", "s", 1) for i in range(5)] + [(2000, "card 4111111111111111 " + docs[2][1], None, None, None), (2001, None, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [at]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    toxic = {i for i in range(0, 600, 5)}
    assert len(ids[1] & toxic) <= 3 and len((ids[0] - toxic) - ids[1]) <= 3
    assert not ids[2] & {1000, 1001, 1002, 1003, 1004} and len(ids[1] - ids[2]) == 5 + (2 in ids[1] and 2000 in ids[1] and 2000 not in ids[2])
    assert seen[1].columns == seen[2].columns == seen[3].columns == at.columns
    texts = {r.doc_id: r.text for r in seen[3].collect()}
    assert 2000 not in texts or "4111111111111111" not in texts[2000]
    assert ids[4] == ids[3] and seen[4].count() == len(ids[4])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (None, None, "en", "s", None), (3, "", "en", "s", 1)], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, f"{tmp_path}/b").collect()) == [0, 1, 3]
