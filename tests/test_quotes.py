import random

from pyspark.sql import functions as F

from corpusloom.operators import domains as dm
from corpusloom.operators import segments as sg
from corpusloom.operators import terms as tm
from corpusloom.operators.quotes import document_quotes, semantic_quotes

LEXICON = {"roja": (0.5, 0.0, 0.0), "azul": (0.0, 0.75, 0.0)}
DOMAINS, PRIORITY = {"SALUD": ["roja", "sangre"], "LEGAL": ["azul", "ley"]}, {"LEGAL": 5}


def test_quotes_in_the_row_are_those_of_the_joins_and_shuffle_nothing(spark):
    rng = random.Random(4)
    words = "roja azul sangre ley (roja) ¡azul! Árbol árbol mesa silla http def the casa perro gato luna".split()
    texts = [" ".join(f"{' '.join(rng.choices(words, k=rng.randrange(1, 12)))}{rng.choice('.!?')}" for _ in range(rng.randrange(90))) for _ in range(40)]
    texts += ["", None, "   ", "...", "Uno dos tres cuatro cinco seis siete ocho. " * 9, "UNO dos tres cuatro cinco seis siete. b. c. uno DOS tres cuatro cinco seis siete. b. c.", "sin punto " * 20, "a\n\n b. " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "content_id long, text string").repartition(3)
    lexicon = spark.createDataFrame([(w, *v) for w, v in LEXICON.items()], "word string, pos double, neg double, sesgo double")
    stop = spark.createDataFrame([("the",)], "term string")
    tiers = dm.domain(docs, DOMAINS, PRIORITY).withColumn("tier", F.when(F.col("content_id") % 3 == 0, "desconocido").otherwise("SALUD"))
    joined = semantic_quotes(docs, tm.key_terms(docs, stop, 10), sg.document_cooccurrences(docs, ["the"]), sg.lexicon_sentiment(sg.sentence_chunks(docs, 3), lexicon, ["chunk_id"], "texto"), tiers=tiers)
    points = F.when(F.col("content_id") % 3 == 0, 7.5).when(dm.domain_of(F.col("text"), DOMAINS, PRIORITY) == "SALUD", 15.0).otherwise(0.0)
    own = document_quotes(docs, ["the"], lexicon=LEXICON, match=points)
    want, got = (sorted(tuple(r) for r in df.collect()) for df in (joined, own))
    assert got == want and len(got) > 100 and len({r[3] for r in got}) > 20
    base = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts))), "content_id long, text string")
    plan = document_quotes(base, ["the"], lexicon=LEXICON, match=points)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Filter ((size(" not in plan  # the array is made once
