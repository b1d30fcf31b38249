"""Queries on retrieval and time: J2-J9, D3-D6, E5-E9, E12, E14-E16, F26, A12."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.store import shared_dir
from corpusloom.operators import index as ix
from corpusloom.operators import search as se
from corpusloom.operators import segments as sg
from corpusloom.operators import tables as tb
from corpusloom.operators import templates as tp
from corpusloom.plans.base import D_SENTENCES, D_TIMED, docs, table, timed, values
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import D_SEARCH


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25_sql(toks: str, asked: str, log_tf: bool) -> str:
    w = "(1 + ln(tf))" if log_tf else "tf"
    idf = "(ln((1 + n) / (1 + df)) + 1)" if log_tf else "ln(1 + (n - df + 0.5) / (df + 0.5))"
    return (
        f"tk AS (SELECT doc_id AS content_id, {toks} AS ts FROM documents), po AS (SELECT content_id, term, count(*) AS tf FROM (SELECT content_id, unnest(ts) AS term FROM tk) GROUP BY ALL), "
        f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({asked}) AS term FROM benchmark) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY term), tot AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS av FROM tk), "
        f"sc AS (SELECT query_id, content_id, round(sum(qtf * {idf} * {w} * 2.5::DOUBLE / ({w} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / av))), 3) AS score FROM po JOIN qt USING (term) JOIN df USING (term) JOIN tk USING (content_id), tot GROUP BY ALL), "
        "res AS (SELECT query_id, content_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 5)"
    )


D_BM25 = _bm25_sql(D_SEARCH.format(x="text"), D_SEARCH.format(x="text"), True)


def _results(spark, sf_dir):
    return se.bm25(docs(spark, sf_dir), _queries(spark, sf_dir), tx.search_tokens)


@query(f"WITH {D_BM25} SELECT query_id, content_id, score, rank FROM res")
def j2_bm25(spark, sf_dir):
    return _results(spark, sf_dir)


_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


@query(f"WITH {_bm25_sql(_W.format('text'), _W.format('text'), False)} SELECT query_id, content_id, score, rank FROM res")
def j3_chunk_search(spark, sf_dir):
    return se.bm25(docs(spark, sf_dir), _queries(spark, sf_dir), tx.words, log_tf=False)


def _stored_index(spark, sf_dir, tokens, log_tf: bool) -> str:
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    ix.write(docs(spark, sf_dir), tokens(F.col("text")), path, log_tf)
    return path


@query(f"WITH {D_BM25} SELECT query_id, content_id, score, rank FROM res")
def j2_stored_index(spark, sf_dir):
    """The same searches over a stored index, by its block bounds."""
    return ix.search(spark, _stored_index(spark, sf_dir, tx.search_tokens, True), _queries(spark, sf_dir), tx.search_tokens)


@query(f"WITH {_bm25_sql(_W.format('text'), _W.format('text'), False)} SELECT query_id, content_id, score, rank FROM res")
def j3_stored_index(spark, sf_dir):
    return ix.search(spark, _stored_index(spark, sf_dir, tx.words, False), _queries(spark, sf_dir), tx.words)


@query(
    r"WITH qw AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 2)) AS w FROM benchmark), n AS (SELECT DISTINCT w FROM qw), occ AS (SELECT doc_id AS content_id, w, (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w) AS k FROM documents, n WHERE length(text) > 20 AND contains(lower(text), w)), "
    "s AS (SELECT query_id, content_id, sum(k)::BIGINT AS score FROM occ JOIN qw USING (w) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content_id) AS rank FROM s QUALIFY rank <= 5"
)
def j4_occurrence_search(spark, sf_dir):
    return se.occurrence_search(docs(spark, sf_dir), _queries(spark, sf_dir))


def _relevant(spark, sf_dir):
    return se.containing(docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")))


@query(f"WITH {D_BM25}, rel AS (SELECT item_id AS query_id, doc_id AS content_id FROM documents d, benchmark b WHERE contains(d.text, b.text)) SELECT query_id, round(count(rank) / count(*), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS rr FROM rel LEFT JOIN res USING (query_id, content_id) GROUP BY query_id")
def j5_evaluation(spark, sf_dir):
    return se.evaluation(_results(spark, sf_dir), _relevant(spark, sf_dir))


@query(f"WITH {D_BM25}, t AS (SELECT query_id, max(score) AS top FROM res GROUP BY query_id), c AS (SELECT item_id AS query_id, top, round(least(top / 10, 1.0), 6) AS c FROM benchmark LEFT JOIN t ON query_id = item_id) SELECT query_id, coalesce(c, 0) AS confianza, CASE WHEN top IS NULL THEN 'ampliar' WHEN c >= 0.3 THEN 'responder' WHEN c >= 0.1 THEN 'ampliar' ELSE 'abstener' END AS decision FROM c")
def j6_decision(spark, sf_dir):
    return se.decision(_queries(spark, sf_dir), _results(spark, sf_dir))


@query(f"WITH {D_BM25} SELECT query_id, sha256(string_agg('[' || content_id || '] ' || substr(text, 1, 800), chr(10) || chr(10) ORDER BY rank)) AS h FROM res JOIN documents ON doc_id = content_id GROUP BY query_id")
def j7_answer_context(spark, sf_dir):
    return se.answer_context(_results(spark, sf_dir), docs(spark, sf_dir)).select("query_id", F.sha2("contexto", 256).alias("h"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 >= 2 THEN '\"' || source || '\" AND \"' || lang || '\"' ELSE 'suficiente' END AS consejo FROM documents")
def j8_evidence_advice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tp.evidence_advice(F.col("doc_id") % 4 + 1, F.array("source", "lang")).alias("consejo"))


@query(
    r"WITH d(concepto, term) AS (VALUES ('src0', 'tion'), ('src1', 'ther')), w AS (SELECT source AS concepto, unnest(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')[1:10], lambda x: regexp_replace(x, '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g'))) AS term FROM documents) SELECT concepto, term FROM d UNION SELECT concepto, term FROM w WHERE length(term) > 3"
)
def j9_learned_vocabulary(spark, sf_dir):
    known = spark.createDataFrame([("src0", "tion"), ("src1", "ther")], "concepto string, term string")
    return tb.learned(known, docs(spark, sf_dir).select(F.col("source").alias("concepto"), F.col("text").alias("title")))


@query(f"WITH {D_TIMED} SELECT video_id, seg_no, inicio FROM timed WHERE contains(lower(texto), 'tion')")
def d3_search_segments(spark, sf_dir):
    return timed(spark, sf_dir).where(F.lower("texto").contains("tion")).select("video_id", "seg_no", "inicio").orderBy("video_id", "inicio")


@query("SELECT doc_id AS id, source AS k FROM documents WHERE contains(lower(text), 'tion')")
def d4_search_with_fallback(spark, sf_dir):
    none = timed(spark, sf_dir).where(F.col("texto").contains("#nothing#")).select(F.col("video_id").alias("id"), F.col("hablante").alias("k"))
    return se.fallback_search(none, docs(spark, sf_dir).where(F.lower("text").contains("tion")).select(F.col("content_id").alias("id"), F.col("source").alias("k")))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_type), 'promo') ORDER BY p_partkey LIMIT 50")
def d5_dictionary_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("widget") | F.lower("p_type").contains("promo")).select("p_partkey", "p_name", "p_type").orderBy("p_partkey").limit(50)


@query("SELECT DISTINCT p_name FROM part WHERE lower(p_name) LIKE '%' || replace('s widget', ' ', '%') || '%'")
def d6_wildcard_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").like("%" + "s widget".replace(" ", "%") + "%")).select("p_name").distinct()


@query("WITH w(needle) AS (VALUES ('widget'), ('l rod'), ('bolt')), m AS (SELECT needle, p_partkey AS key, p_name AS name FROM part, w WHERE lower(p_name) LIKE '%' || replace(needle, ' ', '%') || '%') SELECT needle, key, name, row_number() OVER (PARTITION BY needle ORDER BY name, key) AS rank FROM m QUALIFY rank <= 5")
def e5_batch_lookup(spark, sf_dir):
    words = spark.createDataFrame([("widget",), ("l rod",), ("bolt",)], "needle string")
    return se.lookup(words, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))).select("needle", "key", "name", "rank")


@query("SELECT 'chunks_sin_analisis' AS regla, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'chunks_sin_tiempos', count(*) FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT conv_id::VARCHAR FROM conversations)")
def e6_orphans(spark, sf_dir):
    s = lambda t, c, n: table(spark, sf_dir, t).select(F.col(c).cast("string").alias(n))
    return tb.orphans(s("documents", "doc_id", "content_id"), s("labels", "doc_id", "content_id"), s("conversations", "conv_id", "video_id"))


@query(f"WITH {D_TIMED}, p AS (SELECT DISTINCT conv_id AS video_id, 7.5::DOUBLE + 15 * (conv_id % 3) AS t FROM conversations) SELECT p.video_id, t, inicio, fin, texto FROM p JOIN timed s ON s.video_id = p.video_id AND inicio <= t AND t <= fin QUALIFY row_number() OVER (PARTITION BY p.video_id, t ORDER BY inicio, fin) = 1")
def e7_segment_at(spark, sf_dir):
    t = timed(spark, sf_dir)
    points = t.select("video_id", (7.5 + 15 * (F.col("video_id") % 3)).alias("t")).distinct()
    return se.segment_at(t.select("video_id", "inicio", "fin", "texto"), points)


@query(
    f"WITH {D_TIMED}, e AS (SELECT video_id, max(fin) AS total FROM timed GROUP BY video_id), p AS (SELECT video_id, share, total * share AS t FROM e, (VALUES (0.02::DOUBLE), (0.25), (0.5), (0.75), (0.93)) s(share)) SELECT p.video_id, share, inicio FROM p JOIN timed s ON s.video_id = p.video_id QUALIFY row_number() OVER (PARTITION BY p.video_id, share ORDER BY round(abs(inicio - t), 6), inicio) = 1"
)
def e8_nearest_points(spark, sf_dir):
    return se.nearest_points(timed(spark, sf_dir))


_TOKENS6 = "regexp_extract_all(strip_accents(lower({})), '[a-z0-9]+')"
D_ALIGNED = (
    f"{D_TIMED}, doc AS (SELECT video_id AS content_id, string_agg(texto, ' ' ORDER BY seg_no) AS text FROM timed GROUP BY video_id), {D_SENTENCES.replace('doc_id AS content_id', 'content_id').replace('FROM documents', 'FROM doc')}, "
    "ch AS MATERIALIZED (SELECT content_id || '_' || lpad(posicion::VARCHAR, 4, '0') || '_' || substr(sha256(texto), 1, 8) AS chunk_id, content_id AS video_id, posicion, texto FROM (SELECT content_id, place // 3 AS posicion, string_agg(sentence, ' ' ORDER BY place) AS texto FROM sent GROUP BY ALL)), "
    f"st AS MATERIALIZED (SELECT chunk_id, video_id, posicion, CASE WHEN len(t) >= 6 THEN array_to_string(t[1:6], ' ') END AS gram FROM (SELECT *, {_TOKENS6.format('texto')} AS t FROM ch)), "
    f"wd AS (SELECT video_id, inicio, unnest(t) AS word, generate_subscripts(t, 1) AS seq FROM (SELECT video_id, inicio, {_TOKENS6.format('texto')} AS t FROM timed)), wn AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY inicio, seq) AS pl FROM wd), "
    "gr AS (SELECT video_id, pl, inicio AS t_inicio, lead(inicio, 5) OVER w AS t_fin, array_to_string([word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w, lead(word, 5) OVER w], ' ') AS gram FROM wn WINDOW w AS (PARTITION BY video_id ORDER BY pl)), "
    "hits AS MATERIALIZED (SELECT s.video_id, s.posicion, s.chunk_id, pl, t_inicio, t_fin FROM st s JOIN gr g ON s.video_id = g.video_id AND s.gram = g.gram WHERE t_fin IS NOT NULL), "
    "walk(video_id, posicion, pl, hit) AS (SELECT DISTINCT video_id, -1::BIGINT, 0::BIGINT, NULL::BIGINT FROM ch UNION ALL SELECT w.video_id, c.posicion, coalesce(min(h.pl), w.pl), min(h.pl) FROM walk w JOIN ch c ON c.video_id = w.video_id AND c.posicion = w.posicion + 1 LEFT JOIN hits h ON h.video_id = c.video_id AND h.posicion = c.posicion AND h.pl >= w.pl GROUP BY w.video_id, c.posicion, w.pl), "
    "al AS MATERIALIZED (SELECT ch.chunk_id, ch.video_id, t_inicio, t_fin FROM ch JOIN walk w ON w.video_id = ch.video_id AND w.posicion = ch.posicion LEFT JOIN hits h ON h.video_id = w.video_id AND h.posicion = w.posicion AND h.pl = w.hit)"
)


def _track_chunks(spark, sf_dir):
    text = timed(spark, sf_dir).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "texto"))), lambda s: s["texto"]), " ").alias("text"))
    return sg.sentence_chunks(text.withColumnRenamed("video_id", "content_id"), 3).withColumnRenamed("content_id", "video_id")


@query(f"WITH RECURSIVE {D_ALIGNED} SELECT chunk_id, t_inicio, t_fin FROM al")
def e9_aligned_chunks(spark, sf_dir):
    return se.align(_track_chunks(spark, sf_dir), timed(spark, sf_dir).select("video_id", "inicio", "texto"))


@query("SELECT d.doc_id, coalesce('alias-' || l.doc_id, d.source) AS nombre FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 WHERE contains(d.source, 'src1') OR contains('alias-' || l.doc_id, '7')")
def e12_search_by_either_name(spark, sf_dir):
    alias = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.concat(F.lit("alias-"), "doc_id").alias("alias"))
    d = table(spark, sf_dir, "documents").join(alias, "doc_id", "left")
    return d.where(F.col("source").contains("src1") | F.col("alias").contains("7")).select("doc_id", F.coalesce("alias", "source").alias("nombre"))


@query("SELECT p_partkey, '\"' || array_to_string(list_filter(string_split(lower(p_type), ' '), lambda w: w IN ('promo', 'large', 'small')), '\" AND \"') || '\"' AS consulta FROM part WHERE len(list_filter(string_split(lower(p_type), ' '), lambda w: w IN ('promo', 'large', 'small'))) > 0")
def e14_boolean_queries(spark, sf_dir):
    found = F.filter(F.split(F.lower("p_type"), " "), lambda w: w.isin("promo", "large", "small"))
    return table(spark, sf_dir, "part").where(F.size(found) > 0).select("p_partkey", tp.boolean_query(found).alias("consulta"))


ALIAS, CACHE = [("promo", "M1"), ("large", "M2")], [("large", "X2"), ("small", "X3")]


@query(f"WITH t AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS term FROM part), a(term, m1) AS (SELECT * FROM {values(ALIAS)}), c(term, m2) AS (SELECT * FROM {values(CACHE)}) SELECT term, coalesce(m1, m2) AS mesh_id, CASE WHEN m1 IS NOT NULL THEN 'alias' WHEN m2 IS NOT NULL THEN 'cache' ELSE 'falta' END AS origen FROM t LEFT JOIN a USING (term) LEFT JOIN c USING (term)")
def e15_authority_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("term")).distinct()
    return tb.authority(wanted, spark.createDataFrame(ALIAS, "term string, mesh_id string"), spark.createDataFrame(CACHE, "term string, mesh_id string"))


@query("SELECT video_id, CASE WHEN worst <= 2 THEN 'validado' WHEN worst <= 20 THEN 'aproximado' ELSE 'no_navegable' END AS estado FROM (SELECT conv_id AS video_id, max(abs(length(text) % 40 - 10)) AS worst FROM conversations GROUP BY conv_id)")
def f26_sync_status(spark, sf_dir):
    off = F.max(F.abs(F.length("texto") % 40 - 10))
    return timed(spark, sf_dir).groupBy("video_id").agg(F.when(off <= 2, "validado").when(off <= 20, "aproximado").otherwise("no_navegable").alias("estado"))


@query(f"WITH {D_TIMED} SELECT video_id, string_agg('[' || lpad((inicio::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad((inicio::BIGINT % 60)::VARCHAR, 2, '0') || '] ' || texto, chr(10) ORDER BY seg_no) AS transcript FROM timed GROUP BY video_id")
def a12_stamped_transcript(spark, sf_dir):
    line = F.concat(F.lit("["), tx.short_clock(F.col("inicio")), F.lit("] "), "texto")
    g = timed(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", line.alias("line")))).alias("l"))
    return g.select("video_id", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("transcript"))


COMPOUNDS, CONNECTORS, MESH = ["blue bolt", "red widget"], ["of", "and", "in"], {"blue bolt": "Bolts", "small ring": "Rings", "economy": "Economics", "hot gear": "Gears"}


@query(
    r"WITH p AS (SELECT p_partkey, lower(p_name || ' of ' || p_type || ' and  in ' || p_brand) AS f FROM part), q AS (SELECT p_partkey, CASE WHEN contains(f, 'blue bolt') THEN 'blue bolt' END AS c1, CASE WHEN contains(replace(f, 'blue bolt', ''), 'red widget') THEN 'red widget' END AS c2, replace(replace(f, 'blue bolt', ''), 'red widget', '') AS rest FROM p), "
    r"s AS (SELECT p_partkey, list_filter([c1, c2], lambda x: x IS NOT NULL) AS cs, string_split(regexp_replace(' ' || replace(trim(regexp_replace(rest, '\s+', ' ', 'g')), ' ', '  ') || ' ', ' (?:of|and|in) ', chr(1), 'g'), chr(1)) AS ps FROM q), c AS (SELECT p_partkey, list_concat(cs, list_filter(list_transform(ps, lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '')) AS cs FROM s), "
    f"m(k, v) AS (SELECT * FROM {values(list(MESH.items()))}), e AS (SELECT p_partkey, unnest(cs) AS k, generate_subscripts(cs, 1) AS n FROM c), g AS (SELECT p_partkey, string_agg('\"' || v || '\"', ' AND ' ORDER BY n) AS consulta FROM e JOIN m USING (k) GROUP BY p_partkey) SELECT p_partkey, array_to_string(cs, '|') AS conceptos, coalesce(consulta, '') AS consulta FROM c LEFT JOIN g USING (p_partkey)"
)
def e14_phrase_queries(spark, sf_dir):
    phrase = F.concat_ws(" ", "p_name", F.lit("of"), "p_type", F.lit("and  in"), "p_brand")
    known = F.create_map(*(F.lit(x) for kv in MESH.items() for x in kv))
    d = table(spark, sf_dir, "part").select("p_partkey", tb.phrase_concepts(phrase, COMPOUNDS, CONNECTORS).alias("c"))
    found = F.filter(F.transform("c", lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull())
    return d.select("p_partkey", F.array_join("c", "|").alias("conceptos"), tp.boolean_query(found).alias("consulta"))


def _turns(spark, sf_dir):
    return timed(spark, sf_dir).select(F.concat_ws("_", "video_id", "seg_no").alias("chunk_id"), "video_id", F.col("seg_no").alias("posicion"), "inicio", "fin", "texto")


def _turn_results(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return se.bm25(_turns(spark, sf_dir).select(F.col("chunk_id").alias("content_id"), F.col("texto").alias("text")), asked, tx.words, log_tf=False)


_TURN_BM25 = f"{D_TIMED}, " + _bm25_sql(_W.format("texto"), _W.format("text"), False).replace("SELECT doc_id AS content_id", "SELECT video_id || '_' || seg_no AS content_id").replace("FROM documents", "FROM timed")
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(texto, '\[[^\n]*?\]', '', 'g'), '&[a-z]+;', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"WITH {_TURN_BM25} SELECT query_id, rank, content_id AS chunk_id, video_id, inicio, {_CLEAN} AS fragmento, 'https://youtu.be/' || video_id || '?t=' || inicio::BIGINT AS enlace, score FROM res JOIN timed ON video_id || '_' || seg_no = content_id")
def j3_fragments(spark, sf_dir):
    return se.chunk_fragments(_turn_results(spark, sf_dir), _turns(spark, sf_dir))


_CLOCK = "CASE WHEN {0} < 3600 THEN '' ELSE lpad(({0}::BIGINT // 3600)::VARCHAR, 2, '0') || ':' END || lpad(({0}::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({0}::BIGINT % 60)::VARCHAR, 2, '0')"


@query(
    f"WITH {_TURN_BM25}, r AS (SELECT query_id, rank, '[Chunk ' || rank || '] Fuente: ' || video_id || ' | Pos: ' || seg_no || ' | Tiempo: ' || {_CLOCK.format('inicio')} || '→' || {_CLOCK.format('fin')} || chr(10) || substr(trim(texto), 1, 800) || CASE WHEN length(trim(texto)) > 800 THEN '...' ELSE '' END AS part, video_id || ' @ ' || {_CLOCK.format('inicio')} AS cite FROM res JOIN timed ON video_id || '_' || seg_no = content_id) "
    "SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY rank) AS contexto, string_agg(cite, ',' ORDER BY rank) AS citas FROM r GROUP BY query_id"
)
def j7_cited_context(spark, sf_dir):
    return se.chunk_context(_turn_results(spark, sf_dir), _turns(spark, sf_dir)).withColumn("citas", F.array_join("citas", ","))


@query(
    "WITH p AS (SELECT conv_id AS video_id, (length(text) % 50 - 20) / 10.0::DOUBLE AS o, length(text) % 9 <> 0 AS ok FROM conversations), g AS (SELECT video_id, count(*) FILTER (ok) AS v, count(*) FILTER (NOT ok) AS f, max(abs(o)) FILTER (ok) AS w FROM p GROUP BY video_id) "
    "SELECT video_id, CASE WHEN v = 0 THEN 'failed' WHEN w <= 2 AND f = 0 THEN 'validated' WHEN w <= 4 AND f <= 1 THEN 'approximate' ELSE 'not_for_navigation' END AS status, v AS validated_count, f AS failed_count, CASE WHEN v > 0 THEN round(w, 2) END AS max_offset_seconds FROM g"
)
def f26_track_status(spark, sf_dir):
    """Offsets and validity of each turn from its length, as the tables have no second track."""
    n = F.length("texto")
    return se.sync_status(timed(spark, sf_dir).select("video_id", ((n % 50 - 20) / 10.0).alias("offset_seconds"), (n % 9 != 0).alias("validado")))


@query(
    f"WITH RECURSIVE {D_ALIGNED}, e AS (SELECT video_id, max(fin) AS total FROM timed GROUP BY video_id), p AS (SELECT video_id, share, total * share AS t FROM e, (VALUES (0.02::DOUBLE), (0.25), (0.5), (0.75), (0.93)) s(share)), pt AS (SELECT p.video_id, share, inicio FROM p JOIN timed s ON s.video_id = p.video_id QUALIFY row_number() OVER (PARTITION BY p.video_id, share ORDER BY round(abs(inicio - t), 6), inicio) = 1), "
    "o AS (SELECT pt.video_id, share, min(abs(t_inicio - inicio)) AS off FROM pt LEFT JOIN al ON al.video_id = pt.video_id AND t_inicio IS NOT NULL GROUP BY ALL), g AS (SELECT video_id, count(*) FILTER (off <= 30) AS v, count(*) FILTER (off IS NULL OR off > 30) AS f, max(off) FILTER (off <= 30) AS w FROM o GROUP BY video_id) "
    "SELECT video_id, CASE WHEN v = 0 THEN 'failed' WHEN w <= 2 AND f = 0 THEN 'validated' WHEN w <= 4 AND f <= 1 THEN 'approximate' ELSE 'not_for_navigation' END AS status, v AS validated_count, f AS failed_count, CASE WHEN v > 0 THEN round(w, 2) END AS max_offset_seconds FROM g"
)
def f26_aligned_status(spark, sf_dir):
    """Offsets from the aligned times of chunks at the points of each track."""
    cues, chunks = timed(spark, sf_dir), _track_chunks(spark, sf_dir)
    aligned = se.align(chunks, cues.select("video_id", "inicio", "texto"))
    return se.sync_status(se.track_offsets(chunks, aligned, cues))
