"""Key quotes of a document, scored by what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.segments import segment_array, sentence_chunks, sentence_groups, term_bits, top_pairs
from corpusloom.operators.terms import ranked

CODE = ["{", "}", "def ", "import ", "http", "<?"]


def semantic_quotes(docs: DataFrame, terms: DataFrame, pairs: DataFrame, sentiment: DataFrame | None = None, n: int = 10, tiers: DataFrame | None = None) -> DataFrame:
    """``content_id, posicion, texto, score, rank``: chunks of three sentences, 30 characters or more and not code.

    Score: 40 % share of the document's terms present, 25 % share of its pairs with both ends present, 20 % absolute
    normalised polarity (``sentiment (chunk_id, polaridad_norm)``, 0 without), 15 % domain match of ``tiers (content_id,
    tier, nicho)``: whole if they are equal, half if the tier is unknown (``desconocido``, or not given). Equal texts but for case count once, at their first place, before the ranking.
    """
    c = sentence_chunks(docs, 3)
    bad = F.lit(False)
    for m in CODE:
        bad = bad | F.col("texto").contains(m)
    c = c.where(F.length("texto") >= 30).where(~bad).withColumn("low", F.lower("texto"))
    c = ranked(c, ["content_id", "low"], [F.asc("posicion")], 1, "copy").drop("copy")
    c = c.join(_sought(terms, pairs), "content_id", "left")
    c = c.withColumn("pol", F.lit(0.0)) if sentiment is None else c.join(sentiment.select("chunk_id", F.col("polaridad_norm").alias("pol")), "chunk_id", "left")
    if tiers is None:
        c = c.withColumn("match", F.lit(7.5))
    else:
        match = F.when(F.col("tier") == F.col("nicho"), 15.0).when(F.coalesce("tier", F.lit("desconocido")) == "desconocido", 7.5).otherwise(0.0)
        c = c.join(tiers.select("content_id", match.alias("match")), "content_id", "left").withColumn("match", F.coalesce("match", F.lit(7.5)))
    c = c.withColumn("bits", term_bits(F.col("low"), F.col("words")))
    has = lambda b: F.col("bits").bitwiseAND(b) == b
    share = lambda found, n: F.coalesce(F.try_divide(found, n), F.lit(0.0))
    score = 40 * share(F.bit_count(F.col("bits").bitwiseAND(F.col("own"))), F.col("n_own")) + 25 * share(F.size(F.filter("pairs", has)), F.size("pairs")) + 20 * F.least(F.abs(F.coalesce("pol", F.lit(0.0))), F.lit(1.0)) + F.col("match")
    out = ranked(c.withColumn("score", F.round(score, 6)), ["content_id"], [F.desc("score"), F.asc("posicion")], n)
    return out.select("content_id", "posicion", "texto", F.round("score", 2).alias("score"), "rank")


def document_quotes(docs: DataFrame, stopwords: list[str], keys: int = 10, pairs: int = 15, lexicon: dict[str, tuple] | None = None, match: Column | None = None, n: int = 10) -> DataFrame:
    """``semantic_quotes`` without a shuffle, of documents whose ids don't repeat: the ``keys`` key terms, the top ``pairs`` of them, chunks, scores and ranks are made in the row of the text.

    ``stopwords`` and ``lexicon`` (word to positive and negative weight and more) are written by hand; ``match`` are the points for the domain, 7.5 if not given."""
    words = {} if lexicon is None else {w: (float(v[0]), float(v[1])) for w, v in lexicon.items()}
    weights = [F.create_map(*(x for w, v in words.items() for x in (F.lit(w), F.lit(v[i])))) for i in (0, 1)] if words else []

    def polarity(low: Column) -> Column:
        """As ``lexicon_sentiment`` has it in ``polaridad_norm``."""
        if not words:
            return F.lit(0.0)
        bare = F.transform(F.split(F.trim(F.regexp_replace(low, r"\s+", " ")), " "), lambda w: F.btrim(w, F.lit(""".,;:!?¡¿()[]{}"'""")))
        total = lambda known, m: F.aggregate(known, F.lit(0.0), lambda a, w: a + F.try_element_at(m, w))
        return tx.bind(F.filter(bare, lambda w: w.isin(*words)), lambda known: F.when(F.size(known) > 0, F.round((total(known, weights[0]) - total(known, weights[1])) / F.size(known), 3)).otherwise(0.0))

    def scored(terms: Column, both: Column, match: Column, chunk: Column) -> Column:
        share = lambda found, n: F.coalesce(F.try_divide(found, n), F.lit(0.0))
        has = lambda bits: 40 * share(F.bit_count(bits), F.size(terms)) + 25 * share(F.size(F.filter(both, lambda b: bits.bitwiseAND(b) == b)), F.size(both))
        score = tx.bind(term_bits(chunk["low"], terms), has) + 20 * F.least(F.abs(polarity(chunk["low"])), F.lit(1.0)) + match
        return F.struct((-F.round(score, 6)).alias("less"), chunk["posicion"].alias("posicion"), chunk["texto"].alias("texto"))

    def unlike(s: Column) -> Column:
        """Of chunks in the order of their lower-cased text the first of equal ones."""
        return F.filter(s, lambda x, i: ~F.coalesce(F.get(s, i - 1)["low"] == x["low"], F.lit(False)))

    bad = lambda c: F.greatest(F.lit(False), *(c["texto"].contains(m) for m in CODE))
    texts = F.transform(sentence_groups(F.col("text"), 3), lambda g, i: F.struct(i.cast("long").alias("posicion"), F.array_join(g, " ").alias("texto")))
    fit = F.filter(texts, lambda c: (F.length(c["texto"]) >= 30) & ~bad(c))
    chunks = tx.bind(F.sort_array(F.transform(fit, lambda c: F.struct(F.lower(c["texto"]).alias("low"), c["posicion"].alias("posicion"), c["texto"].alias("texto")))), unlike)
    mask = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p["i"]).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p["j"]))
    best = lambda terms, both, points: F.slice(F.sort_array(F.transform(chunks, lambda c: scored(terms, both, points, c))), 1, n)
    found = tx.bind(
        tx.top_terms(tx.terms(F.col("text")), stopwords, keys),
        lambda terms: tx.bind(F.transform(tx.bind(segment_array(F.col("text")), lambda segs: top_pairs(terms, segs, keys, pairs)), mask), lambda both: tx.bind(F.lit(7.5) if match is None else match, lambda points: best(terms, both, points))),
    )
    # outer: else Spark puts a filter on the array's size before it, which makes the whole array two more times
    rows = docs.withColumn("_f", found).select("content_id", F.posexplode_outer("_f").alias("_k", "_q")).where("_q is not null")
    return rows.select("content_id", "_q.posicion", "_q.texto", F.round(-F.col("_q.less"), 2).alias("score"), (F.col("_k") + 1).cast("long").alias("rank"))


def _sought(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``content_id, words, own, n_own, pairs``: the distinct words to look for in a document's chunks, the bits of its terms, and of each pair's ends."""
    t = terms.groupBy("content_id").agg(F.array_sort(F.collect_set("term")).alias("ts"))  # the few key terms of a document
    p = pairs.groupBy("content_id").agg(F.collect_list(F.struct("t1", "t2")).alias("ps"))  # and pairs
    none = F.array().cast("array<string>")
    both = t.join(p, "content_id", "full_outer").withColumn("words", F.array_distinct(F.concat(F.coalesce("ts", none), F.coalesce(F.transform("ps", lambda x: x["t1"]), none), F.coalesce(F.transform("ps", lambda x: x["t2"]), none))))
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position("words", w) - 1).cast("int"))
    own = F.aggregate(F.coalesce("ts", none), F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(bit(w)))
    return both.select("content_id", "words", own.alias("own"), F.size(F.coalesce("ts", none)).alias("n_own"), F.coalesce(F.transform("ps", lambda x: bit(x["t1"]).bitwiseOR(bit(x["t2"]))), F.array().cast("array<bigint>")).alias("pairs"))
