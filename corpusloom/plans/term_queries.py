"""Queries on term counts: F1-F8, F18-F21, G1-G7, G10-G15, D1, D2, E1-E4, E10-E13, J1, L1."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import tables as tb
from corpusloom.operators import terms as tm
from corpusloom.operators import vectors as vc
from corpusloom.plans.base import D_COUNTS, D_STOP, STOPWORDS, TECHNICAL, counts, docs, table, values, words_frame
from corpusloom.plans.registry import query


@query(f"WITH {D_COUNTS}, {D_STOP} SELECT content_id, term, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY frequency DESC, place) AS rank FROM counts WHERE term NOT IN (SELECT term FROM stop)) WHERE rank <= 20")
def f1_key_terms(spark, sf_dir):
    return tm.key_terms(docs(spark, sf_dir), words_frame(spark, STOPWORDS))


@query(f"WITH {D_COUNTS}, {D_STOP} SELECT term, sum(frequency)::BIGINT AS total, count(DISTINCT content_id) AS documents FROM counts WHERE term NOT IN (SELECT term FROM stop) GROUP BY term ORDER BY total DESC, term LIMIT 20")
def f2_top_terms(spark, sf_dir):
    return tm.top_terms(tm.without(counts(spark, sf_dir), words_frame(spark, STOPWORDS)))


@query(f"WITH {D_COUNTS} SELECT content_id, count(*) AS terms, sum(frequency)::BIGINT AS total, round(avg(frequency), 6) AS mean FROM counts GROUP BY content_id")
def f3_document_summary(spark, sf_dir):
    return tm.document_summary(counts(spark, sf_dir))


@query(f"WITH {D_COUNTS}, {D_STOP} SELECT content_id, count(*) AS useful FROM counts WHERE term NOT IN (SELECT term FROM stop) GROUP BY content_id")
def f4_useful_terms(spark, sf_dir):
    return tm.without(counts(spark, sf_dir), words_frame(spark, STOPWORDS)).groupBy("content_id").agg(F.count("*").alias("useful"))


@query(
    f"WITH {D_COUNTS}, {D_STOP}, a AS (SELECT row_number() OVER (ORDER BY sum(frequency) DESC, term) AS rank, term AS term_before, sum(frequency)::BIGINT AS total_before FROM counts GROUP BY term ORDER BY rank LIMIT 20), "
    "b AS (SELECT row_number() OVER (ORDER BY sum(frequency) DESC, term) AS rank, term AS term_after, sum(frequency)::BIGINT AS total_after FROM counts WHERE term NOT IN (SELECT term FROM stop) GROUP BY term ORDER BY rank LIMIT 20) SELECT * FROM a FULL JOIN b USING (rank)"
)
def f5_before_after(spark, sf_dir):
    return tm.before_after(counts(spark, sf_dir), words_frame(spark, STOPWORDS))


@query(f"WITH {D_COUNTS} SELECT count(*) AS rows_total, count(DISTINCT content_id) AS documents, count(DISTINCT term) AS terms, sum(frequency)::BIGINT AS mentions FROM counts")
def f6_global_counters(spark, sf_dir):
    return counts(spark, sf_dir).agg(F.count("*").alias("rows_total"), F.count_distinct("content_id").alias("documents"), F.count_distinct("term").alias("terms"), F.sum("frequency").alias("mentions"))


@query("SELECT source AS nicho, count(*) AS documents FROM documents GROUP BY source")
def f7_documents_by_domain(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.col("source").alias("nicho")).agg(F.count("*").alias("documents"))


@query(f"WITH {D_COUNTS}, twice AS (SELECT content_id, term, frequency FROM counts UNION ALL SELECT content_id, term, 1 FROM counts) SELECT content_id, term, max(frequency) AS frequency FROM twice GROUP BY ALL")
def f8_dedup_safe_frequency(spark, sf_dir):
    c = counts(spark, sf_dir)
    return c.unionByName(c.withColumn("frequency", F.lit(1).cast("long"))).groupBy("content_id", "term").agg(F.max("frequency").alias("frequency"))


@query(f"WITH {D_COUNTS} SELECT content_id, sum(frequency)::BIGINT AS mentions, CASE WHEN sum(frequency) >= 1000 THEN 1 WHEN sum(frequency) >= 200 THEN 2 ELSE 3 END::BIGINT AS tier FROM counts GROUP BY content_id")
def f18_tiers(spark, sf_dir):
    return tm.tiers(counts(spark, sf_dir))


@query(
    f"WITH {D_COUNTS}, t AS (SELECT content_id, CASE WHEN sum(frequency) >= 1000 THEN 1 WHEN sum(frequency) >= 200 THEN 2 ELSE 3 END::BIGINT AS tier FROM counts GROUP BY content_id), p AS (SELECT tier, quality FROM t JOIN labels ON doc_id = content_id) "
    "SELECT tier, count(*) AS total, count(*) FILTER (quality = 1) AS completed, round(100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*), 1) AS percent FROM p GROUP BY tier"
)
def f19_progress_by_tier(spark, sf_dir):
    p = tm.tiers(counts(spark, sf_dir)).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "content_id"), "content_id")
    done = F.count_if(F.col("quality") == 1)
    return p.groupBy("tier").agg(F.count("*").alias("total"), done.alias("completed"), F.round(100.0 * done / F.count("*"), 1).alias("percent"))


@query(
    f"WITH {D_COUNTS} SELECT source AS nicho, term, count(DISTINCT content_id) AS documents, sum(frequency)::BIGINT AS total FROM counts JOIN documents ON doc_id = content_id WHERE term NOT IN (SELECT * FROM {values([(w,) for w in TECHNICAL])}) GROUP BY ALL HAVING count(DISTINCT content_id) >= 3"
)
def f20_contamination(spark, sf_dir):
    return tm.contamination(counts(spark, sf_dir), docs(spark, sf_dir).select("content_id", F.col("source").alias("nicho")), words_frame(spark, TECHNICAL))


@query(f"WITH {D_COUNTS}, d AS (SELECT DISTINCT term FROM counts), k AS (SELECT count(*) FILTER (term IN (SELECT * FROM {values([(w,) for w in TECHNICAL])})) AS technical, count(*) AS total FROM d) SELECT technical, total, round(100.0::DOUBLE * technical / total, 1) AS percent FROM k")
def f21_coverage(spark, sf_dir):
    return tm.coverage(counts(spark, sf_dir), words_frame(spark, TECHNICAL))


@query(f"WITH {D_COUNTS} SELECT content_id, term, frequency, rank() OVER (PARTITION BY content_id ORDER BY frequency DESC)::BIGINT AS rank FROM counts")
def g1_rank_in_document(spark, sf_dir):
    return counts(spark, sf_dir).withColumn("rank", F.rank().over(Window.partitionBy("content_id").orderBy(F.desc("frequency"))).cast("long"))


@query(f"WITH {D_COUNTS}, twice AS (SELECT content_id, term, frequency FROM counts UNION ALL SELECT content_id, term, frequency - 1 FROM counts) SELECT content_id, term, frequency FROM twice QUALIFY row_number() OVER (PARTITION BY content_id, term ORDER BY frequency DESC) = 1")
def g2_one_row_a_key(spark, sf_dir):
    c = counts(spark, sf_dir)
    return tm.ranked(c.unionByName(c.withColumn("frequency", F.col("frequency") - 1)), ["content_id", "term"], [F.desc("frequency")], 1).drop("rank")


@query("SELECT source, row_number() OVER (ORDER BY source) AS id FROM (SELECT DISTINCT source FROM documents)")
def g3_surrogate_ids(spark, sf_dir):
    return tm.ranked(docs(spark, sf_dir).select("source").distinct().withColumn("one", F.lit(1)), ["one"], [F.asc("source")], name="id").drop("one")


@query(f"WITH {D_COUNTS} SELECT content_id, term, frequency FROM counts QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY frequency DESC, term) <= 8")
def g4_top_terms_a_document(spark, sf_dir):
    return tm.ranked(counts(spark, sf_dir), ["content_id"], [F.desc("frequency"), F.asc("term")], 8).drop("rank")


@query(
    f"WITH {D_COUNTS}, t AS (SELECT content_id, sum(frequency)::BIGINT AS mentions, CASE WHEN sum(frequency) >= 1000 THEN 1 WHEN sum(frequency) >= 200 THEN 2 ELSE 3 END::BIGINT AS tier FROM counts GROUP BY content_id) SELECT content_id, tier, mentions FROM t JOIN labels ON doc_id = content_id WHERE quality = 0 ORDER BY tier, mentions DESC, content_id LIMIT 3"
)
def g5_next_pending(spark, sf_dir):
    pending = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("content_id"))
    return tm.tiers(counts(spark, sf_dir)).join(pending, "content_id").orderBy("tier", F.desc("mentions"), "content_id").select("content_id", "tier", "mentions").limit(3)


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total, (SELECT ceil(count(*) / 20.0)::BIGINT FROM part) AS pages, TRUE AS has_more FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20")
def g6_page(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    size = part.agg(F.count("*").alias("total"))
    last = part.orderBy("p_name", "p_partkey").limit(40)
    page = tm.ranked(last.withColumn("one", F.lit(1)), ["one"], [F.asc("p_name"), F.asc("p_partkey")]).where("rank > 20")
    return page.crossJoin(F.broadcast(size)).select("p_partkey", "p_name", "total", F.ceil(F.col("total") / 20).alias("pages"), (F.col("total") > 40).alias("has_more"))


@query(f"WITH {D_COUNTS} SELECT term, max(frequency) AS most FROM counts GROUP BY term ORDER BY most DESC, term LIMIT 15")
def g7_most_frequent(spark, sf_dir):
    return counts(spark, sf_dir).groupBy("term").agg(F.max("frequency").alias("most")).orderBy(F.desc("most"), "term").limit(15)


@query(
    "WITH s AS (SELECT lower(trim(unnest(string_split(p_type, ' ')))) AS term, 'part' AS source FROM part UNION SELECT lower(r_name), 'region' FROM region UNION SELECT lower(n_name), 'nation' FROM nation) SELECT term, source FROM s WHERE term <> ''"
)
def g10_technical_terms(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("term"), F.lit("part").alias("source"))
    others = [table(spark, sf_dir, t).select(F.col(c).alias("term"), F.lit(t).alias("source")) for t, c in (("region", "r_name"), ("nation", "n_name"))]
    return part.union(others[0]).union(others[1]).select(F.lower(F.trim("term")).alias("term"), "source").where("term <> ''").distinct()


@query(
    "WITH s AS (SELECT lower(trim(unnest(string_split(p_type, ' ')))) AS term, 'part' AS source FROM part UNION SELECT lower(r_name), 'region' FROM region UNION SELECT lower(n_name), 'nation' FROM nation) SELECT source, count(DISTINCT term) AS terms FROM s WHERE term <> '' GROUP BY source"
)
def g11_terms_by_source(spark, sf_dir):
    return g10_technical_terms(spark, sf_dir).groupBy("source").agg(F.count_distinct("term").alias("terms"))


@query(
    f"WITH {D_COUNTS}, a AS (SELECT list(term) AS l FROM counts WHERE content_id = (SELECT min(doc_id) FROM documents)), b AS (SELECT list(term) AS r FROM counts WHERE content_id = (SELECT max(doc_id) FROM documents)) "
    "SELECT len(list_intersect(l, r))::BIGINT AS common, (len(l) - len(list_intersect(l, r)))::BIGINT AS only_left, (len(r) - len(list_intersect(l, r)))::BIGINT AS only_right FROM a, b"
)
def g12_two_documents(spark, sf_dir):
    c = counts(spark, sf_dir)
    ends = docs(spark, sf_dir).agg(F.min("content_id").alias("lo"), F.max("content_id").alias("hi"))
    both = c.join(F.broadcast(ends), (F.col("content_id") == F.col("lo")) | (F.col("content_id") == F.col("hi")))  # one row
    sides = both.groupBy("term").agg(F.max(F.col("content_id") == F.col("lo")).alias("l"), F.max(F.col("content_id") == F.col("hi")).alias("r"))
    return sides.agg(F.count_if(F.col("l") & F.col("r")).alias("common"), F.count_if(F.col("l") & ~F.col("r")).alias("only_left"), F.count_if(F.col("r") & ~F.col("l")).alias("only_right"))


@query("SELECT 'documents' AS tabla, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'conversations', count(*) FROM conversations")
def g13_row_counts(spark, sf_dir):
    one = [table(spark, sf_dir, t).agg(F.lit(t).alias("tabla"), F.count("*").alias("n")) for t in ("documents", "labels", "conversations")]
    return one[0].union(one[1]).union(one[2])


@query("SELECT count(*) AS duplicated FROM (SELECT 1 FROM conversations GROUP BY conv_id, role HAVING count(*) > 1)")
def g14_duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicated"))


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS original, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS kept FROM documents")
def g15_duplicate_contents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = d.groupBy("hash").agg(F.min("doc_id").alias("original"))
    return d.join(first, "hash").select("doc_id", "original", (F.col("doc_id") == F.col("original")).alias("kept"))


@query(f"WITH {D_COUNTS} SELECT content_id, term, frequency FROM counts WHERE content_id = (SELECT min(doc_id) FROM documents)")
def d1_terms_of_a_document(spark, sf_dir):
    one = docs(spark, sf_dir).agg(F.min("content_id").alias("content_id"))
    d = docs(spark, sf_dir)
    return tm.term_counts(d.join(F.broadcast(one), "content_id", "left_semi")).orderBy(F.desc("frequency"), "term")  # one row


@query(f"WITH {D_COUNTS} SELECT content_id, term, frequency FROM counts WHERE contains(term, 'tion')")
def d2_terms_with(spark, sf_dir):
    return counts(spark, sf_dir).where(F.col("term").contains("tion"))


@query(f"WITH {D_COUNTS} SELECT content_id, term, frequency, quality::BIGINT AS estado FROM counts JOIN labels ON doc_id = content_id")
def e1_terms_with_progress(spark, sf_dir):
    return counts(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_id"), F.col("quality").cast("long").alias("estado")), "content_id")


@query(f"WITH {D_COUNTS} SELECT c.content_id, c.frequency, d.source AS nicho FROM counts c LEFT JOIN documents d ON d.doc_id = c.content_id WHERE term = 'the'")
def e2_documents_of_a_term(spark, sf_dir):
    return counts(spark, sf_dir).where("term = 'the'").join(docs(spark, sf_dir).select("content_id", F.col("source").alias("nicho")), "content_id", "left").drop("term")


@query(f"WITH {D_COUNTS}, {D_STOP} SELECT content_id, term, frequency FROM counts WHERE term NOT IN (SELECT term FROM stop)")
def e4_terms_without_stopwords(spark, sf_dir):
    return tm.without(counts(spark, sf_dir), words_frame(spark, [*STOPWORDS, None]))


@query(
    f"WITH {D_COUNTS}, t AS (SELECT content_id, string_agg(term || ' ' || term || ' ' || term, ' ' ORDER BY term) AS extra FROM counts WHERE frequency >= 5 GROUP BY content_id) SELECT doc_id AS content_id, text || ' ' || coalesce(extra, '') AS documento FROM documents LEFT JOIN t ON content_id = doc_id"
)
def e10_search_documents(spark, sf_dir):
    often = counts(spark, sf_dir).where("frequency >= 5").groupBy("content_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("term")), lambda t: F.concat_ws(" ", t, t, t)), " ").alias("extra"))
    return docs(spark, sf_dir).join(often, "content_id", "left").select("content_id", F.concat_ws(" ", F.col("text"), F.coalesce("extra", F.lit(""))).alias("documento"))


@query(
    f"WITH {D_COUNTS}, {D_STOP}, top AS (SELECT term FROM counts WHERE term NOT IN (SELECT term FROM stop) GROUP BY term ORDER BY sum(frequency) DESC, term LIMIT 100) SELECT source AS nicho, term, sum(frequency)::BIGINT AS total FROM counts JOIN documents ON doc_id = content_id WHERE term IN (SELECT term FROM top) GROUP BY ALL"
)
def e11_top_terms_by_domain(spark, sf_dir):
    c = tm.without(counts(spark, sf_dir), words_frame(spark, STOPWORDS))
    top = c.groupBy("term").agg(F.sum("frequency").alias("t")).orderBy(F.desc("t"), "term").limit(100)
    return c.join(F.broadcast(top), "term", "left_semi").join(docs(spark, sf_dir).select("content_id", F.col("source").alias("nicho")), "content_id").groupBy("nicho", "term").agg(F.sum("frequency").alias("total"))  # 100 rows


SYNONYMS = [("tion", "ACTION", "accion"), ("ment", "ACTION", "accion"), ("heit", "STATE", "estado"), ("keit", "STATE", "estado"), ("lich", "STATE", "estado")]


@query(f"WITH {D_COUNTS}, syn(term, concepto, categoria) AS (SELECT * FROM {values(SYNONYMS)}) SELECT content_id, coalesce(concepto, term) AS concepto, categoria, sum(frequency)::BIGINT AS total FROM counts LEFT JOIN syn USING (term) GROUP BY ALL")
def e13_synonyms(spark, sf_dir):
    syn = spark.createDataFrame(SYNONYMS, "term string, concepto string, categoria string")
    return counts(spark, sf_dir).join(F.broadcast(syn), "term", "left").groupBy("content_id", F.coalesce("concepto", "term").alias("concepto"), "categoria").agg(F.sum("frequency").alias("total"))  # five rows


@query(f"WITH {D_COUNTS}, n AS (SELECT count(DISTINCT content_id) AS n FROM counts) SELECT term, count(DISTINCT content_id) AS df, round(ln((1 + any_value(n)) / (1 + count(DISTINCT content_id))) + 1, 6) AS idf FROM counts, n GROUP BY term")
def j1_inverse_document_frequency(spark, sf_dir):
    return tm.idf(counts(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(
    f"WITH {D_COUNTS}, df AS (SELECT term, count(DISTINCT content_id) AS df FROM counts GROUP BY term), n AS (SELECT count(DISTINCT content_id) AS n FROM counts), w AS (SELECT content_id, term, (1 + ln(frequency)) * ln(n / (1 + df)) AS w FROM counts JOIN df USING (term), n) "
    "SELECT content_id, term, round(w / (CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY content_id)) = 0 THEN 1 ELSE sqrt(sum(w * w) OVER (PARTITION BY content_id)) END), 6) + 0 AS weight FROM w"
)
def l1_tf_idf(spark, sf_dir):
    dealt = vc.blocks(docs(spark, sf_dir), tx.terms(F.col("text")))
    return vc.term_weights(*vc.known_blocks(dealt, vc.vocabulary(dealt)[0])).withColumn("weight", F.round("weight", 6) + 0)


@query("SELECT DISTINCT lower(trim(x)) AS term, 'sinonimo' AS source FROM (SELECT unnest(string_split(replace(p_name, ' ', ' , ') || ',' || p_brand || ',ab', ',')) AS x FROM part) WHERE length(trim(x)) >= 3")
def g10_synonyms(spark, sf_dir):
    lists = table(spark, sf_dir, "part").select(F.concat_ws(",", F.replace("p_name", F.lit(" "), F.lit(" , ")), "p_brand", F.lit("ab")).alias("sinonimos"))
    return tb.exploded_synonyms(lists, "sinonimos", "sinonimo")


VALID = [*TECHNICAL, "ther", "tions", "mentes", "the"]
VALID_LEMMAS = [("tions", "tion"), ("mentes", "mente")]


@query(
    f"WITH {D_COUNTS}, {D_STOP}, lm(term, lemma) AS (SELECT * FROM {values(VALID_LEMMAS)}), k AS (SELECT content_id, coalesce(lemma, term) AS term, sum(frequency) AS frequency FROM counts LEFT JOIN lm USING (term) WHERE length(term) >= 3 AND term NOT IN (SELECT term FROM stop) AND term IN (SELECT * FROM {values([(t,) for t in VALID])}) GROUP BY ALL), "
    "df AS (SELECT term, count(DISTINCT content_id) AS df FROM k GROUP BY term), n AS (SELECT count(DISTINCT content_id) AS n FROM k), w AS (SELECT content_id, term, (1 + ln(frequency)) * ln(n / (1 + df)) AS w FROM k JOIN df USING (term), n) "
    "SELECT content_id, term, round(w / (CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY content_id)) = 0 THEN 1 ELSE sqrt(sum(w * w) OVER (PARTITION BY content_id)) END), 6) + 0 AS weight FROM w"
)
def l1_validated_tf_idf(spark, sf_dir):
    lemmas = spark.createDataFrame(VALID_LEMMAS, "term string, lemma string")
    return tm.tf_idf(tm.validated_counts(counts(spark, sf_dir), words_frame(spark, STOPWORDS), words_frame(spark, VALID), lemmas)).withColumn("weight", F.round("weight", 6) + 0)
