"""Queries of scalar expressions and one-to-many text operators: B1-B25, C1-C12, F9-F16, G8, D9, D14, F17, F25."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import segments as sg
from corpusloom.operators import terms as tm
from corpusloom.plans.base import CONCEPTS, D_COUNTS, D_SENTENCES, D_STOP, D_TIMED, LEXICON, STOPWORDS, d_norm, d_sentences, d_terms, docs, table, timed, values, words_frame
from corpusloom.plans.registry import query

SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(
    r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '\[[^\n]*?\]', '', 'g'), '&[a-z]+;', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM (SELECT doc_id, replace('[note ' || lang || '] &amp; ' || text, chr(10), chr(10) || chr(10) || chr(10) || chr(10)) AS m FROM documents)"
)
def b1_clean(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.concat(F.lit("[note "), "lang", F.lit("] &amp; "), "text"), F.lit("\n"), F.lit("\n\n\n\n")).alias("m"))
    return d.select("doc_id", F.sha2(tx.clean(F.col("m")), 256).alias("h"))


@query(f"SELECT doc_id, sha256({SQUEEZE.format(d_norm('text'))}) AS h FROM documents")
def b2_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normalize(F.col("text")), 256).alias("h"))


@query(f"SELECT doc_id, len({d_terms('text')})::BIGINT AS n, sha256(array_to_string({d_terms('text')}, ' ')) AS h FROM documents")
def b3_terms(spark, sf_dir):
    t = tx.terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("h"))


D_SEARCH = (
    r"list_transform(list_filter(list_transform(string_split(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[.,;:!?¡¿()\[\]{{}}\"'']+|[.,;:!?¡¿()\[\]{{}}\"'']+$', '', 'g')), lambda w: length(w) >= 2), "
    r"lambda w: CASE WHEN w LIKE '%es' AND length(w) > 4 THEN substr(w, 1, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END)"
)


@query(f"SELECT doc_id, sha256(array_to_string({D_SEARCH.format(x='text')}, ' ')) AS h FROM documents")
def b4_search_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(tx.search_tokens(F.col("text")), " "), 256).alias("h"))


@query(r"SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')) AS h FROM documents")
def b5_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(tx.words(F.col("text")), " "), 256).alias("h"))


@query("SELECT doc_id, sha256(array_to_string(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+'), ' ')) AS h FROM documents")
def b6_alignment_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(tx.alignment_tokens(F.col("text")), " "), 256).alias("h"))


@query(f"SELECT doc_id, sha256({SQUEEZE.format('text')}) AS h FROM documents")
def b7_flatten(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.flatten(F.col("text")), 256).alias("h"))


@query(
    "WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), g AS (SELECT *, 70 - instr(reverse(substr(t, 1, 70)), ' ') AS cut_at FROM f) SELECT doc_id, CASE WHEN length(t) <= 70 THEN t WHEN contains(substr(t, 1, 70), ' ') AND cut_at > 49 THEN rtrim(substr(t, 1, cut_at)) || '…' ELSE rtrim(substr(t, 1, 70)) || '…' END AS s FROM g"
)
def b8_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(tx.flatten(F.col("text"))).alias("s"))


@query("SELECT doc_id, sha256(regexp_replace(text, '(tion|the)', '<<\\1>>', 'gi')) AS h FROM documents")
def b9_highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.highlight(F.col("text"), "the of tion"), 256).alias("h"))


@query(rf"WITH {D_SENTENCES} SELECT count(*) AS n, count(*) FILTER (length(trim(regexp_replace(sentence, '[^\p{{L}}\p{{N}}_\s]', '', 'g'))) >= 10) AS valid FROM sent")
def b10_segment_validity(spark, sf_dir):
    return sg.sentences(docs(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_if(tx.is_segment(F.col("sentence"))).alias("valid"))


@query("SELECT doc_id, sha256(replace(replace(text, 'tion', 'cion'), 'the', 'teh')) AS h FROM documents")
def b11_corrections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.corrected(F.col("text"), [("tion", "cion"), ("the", "teh")]), 256).alias("h"))


@query(f"WITH w AS (SELECT doc_id, text, string_split({SQUEEZE.format('text')}, ' ') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) > 12 THEN array_to_string(w[1:12], ' ') || '...' ELSE text END AS s FROM w")
def b12_paragraph_cap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.capped(F.col("text"), 12).alias("s"))


@query(f"SELECT doc_id, contains(m, 'Error 500') AS error_page, sha256({SQUEEZE.format(chr(39).join(['replace(m, ', 'Error 500', ', ', ' ', ')']))}) AS h FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Error 500 ' || text ELSE text END AS m FROM documents)")
def b13_error_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Error 500 "), "text")).otherwise(F.col("text")).alias("m"))
    return d.select("doc_id", F.col("m").contains("Error 500").alias("error_page"), F.sha2(tx.without_error_pages(F.col("m")), 256).alias("h"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace('\section{' || text || '} $x_1$', '\\[a-zA-Z]+', ' ', 'g'), '[{}\[\]$^_&#%]', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def b14_latex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.latex_text(F.concat(F.lit("\\section{"), "text", F.lit("} $x_1$"))), 256).alias("h"))


LEMMAS = [("aten", "ate"), ("ings", "ing"), ("tions", "tion"), ("heiten", "heit")]


@query(f"WITH {D_COUNTS}, lem(term, lemma) AS (SELECT * FROM {values(LEMMAS)}) SELECT coalesce(lemma, term) AS lemma, sum(frequency)::BIGINT AS total FROM counts LEFT JOIN lem USING (term) GROUP BY ALL")
def b15_lemmas(spark, sf_dir):
    lemmas = spark.createDataFrame(LEMMAS, "term string, lemma string")
    return tm.term_counts(docs(spark, sf_dir)).join(F.broadcast(lemmas), "term", "left").groupBy(F.coalesce("lemma", "term").alias("lemma")).agg(F.sum("frequency").alias("total"))  # four rows


D_CLOCK = "lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')"


@query(f"SELECT conv_id, turn, {D_CLOCK} AS long_form, CASE WHEN s < 3600 THEN substr({D_CLOCK}, 4) ELSE {D_CLOCK} END AS short_form FROM (SELECT conv_id, turn, (turn * 615 + conv_id % 60)::BIGINT AS s FROM conversations)")
def b16_clock(spark, sf_dir):
    s = F.col("turn") * 615 + F.col("conv_id") % 60
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clock(s).alias("long_form"), tx.short_clock(s).alias("short_form"))


@query("SELECT conv_id, turn, (turn * 615 + conv_id % 60)::BIGINT AS s FROM conversations")
def b17_seconds(spark, sf_dir):
    s = F.col("turn") * 615 + F.col("conv_id") % 60
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.seconds(tx.short_clock(s)).cast("long").alias("s"))


@query("SELECT conv_id, turn, 'https://youtu.be/v' || conv_id || '?t=' || (turn * 15) AS short_link, 'https://www.youtube.com/watch?v=v' || conv_id || '&t=' || (turn * 15) || 's' AS long_link FROM conversations")
def b18_links(spark, sf_dir):
    v = F.concat(F.lit("v"), F.col("video_id"))
    return timed(spark, sf_dir).select(F.col("video_id").alias("conv_id"), F.col("seg_no").alias("turn"), tx.video_link(v, F.col("inicio")).alias("short_link"), tx.video_link(v, F.col("inicio"), True).alias("long_link"))


@query("SELECT page_id, lpad(page_id::VARCHAR, 11, 'a') AS id FROM pages")
def b19_video_ids(spark, sf_dir):
    v = F.lpad(F.col("page_id").cast("string"), 11, "a")
    shapes = F.concat(F.element_at(F.array(*map(F.lit, ("https://youtu.be/", "https://www.youtube.com/watch?v=", "Transcript_", "https://youtube.com/shorts/"))), (F.col("page_id") % 4 + 1).cast("int")), v)
    return table(spark, sf_dir, "pages").select("page_id", tx.video_id(shapes).alias("id"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'youtube:v' || page_id WHEN page_id % 3 = 1 THEN 'github:u/r' || page_id ELSE 'url:' || substr(sha256(trim(url)), 1, 16) END AS id FROM pages")
def b20_content_ids(spark, sf_dir):
    p = F.col("page_id")
    made = F.when(p % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?x=1&v=v"), p)).when(p % 3 == 1, F.concat(F.lit("https://github.com/u/r"), p, F.lit("/issues"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", tx.content_id(made).alias("id"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(lower(trim(url)), 'youtube\.com|youtu\.be') THEN 'youtube' WHEN contains(lower(url), 'github.com') THEN 'github' WHEN regexp_matches(lower(trim(url)), '\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(trim(url)), '\.(txt|md)$') THEN 'text' ELSE 'unknown' END AS kind FROM pages")
def b21_source_types(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.source_type(F.col("url")).alias("kind"))


@query(f"SELECT doc_id, substr(sha256(lower({SQUEEZE.format('text')})), 1, 16) AS h FROM documents")
def b22_text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("h"))


@query("""SELECT doc_id, sha256('{"f0":"' || lang || '","f1":"' || source || '","f2":' || n_chars || '}') AS h FROM documents""")
def b23_change_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.change_hash(F.col("lang"), F.col("source"), F.col("n_chars")).alias("h"))


@query("SELECT conv_id || '_' || lpad(turn::VARCHAR, 4, '0') || '_' || substr(sha256(text), 1, 8) AS chunk_id, 'ent:' || substr(md5(lower(role || '_' || conv_id)), 1, 12) AS entity_id FROM conversations")
def b24_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(tx.chunk_id(F.col("conv_id").cast("string"), F.col("turn"), F.col("text")).alias("chunk_id"), tx.entity_id(F.col("role"), F.col("conv_id").cast("string")).alias("entity_id"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END::BIGINT AS level FROM documents")
def b25_evidence_level(spark, sf_dir):
    kinds = F.element_at(F.array(F.array(F.lit("Journal Article"), F.lit("Meta-Analysis")), F.array(F.lit("Randomized Controlled Trial")), F.array(F.lit("Cohort Study"), F.lit("English")), F.array(F.lit("Letter"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.evidence_level(kinds).alias("level"))


@query(f"WITH {D_SENTENCES} SELECT content_id, place::BIGINT AS place, sha256(sentence) AS h FROM sent")
def c1_sentences(spark, sf_dir):
    return sg.sentences(docs(spark, sf_dir)).select("content_id", F.col("place").cast("long").alias("place"), F.sha2("sentence", 256).alias("h"))


_SPLIT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
#: Sentences packed one after another up to 300 characters, by recursion over the place of a sentence.
D_SEGMENTS = (
    f"s AS (SELECT doc_id AS content_id, unnest({_SPLIT}) AS x, generate_subscripts({_SPLIT}, 1) AS i FROM documents), "
    "r AS (SELECT doc_id AS content_id, 0::BIGINT AS i, '' AS cur, NULL::VARCHAR AS done FROM documents UNION ALL SELECT r.content_id, s.i, CASE WHEN length(cur) + length(x) + 1 > 300 OR cur = '' THEN x ELSE cur || ' ' || x END, CASE WHEN length(cur) + length(x) + 1 > 300 THEN cur END FROM r JOIN s ON s.content_id = r.content_id AND s.i = r.i + 1), "
    "fin AS (SELECT content_id, i, done AS segment FROM r WHERE done <> '' UNION ALL SELECT content_id, i + 1, cur FROM r QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY i DESC) = 1), "
    r"segs AS (SELECT content_id, row_number() OVER (PARTITION BY content_id ORDER BY i) - 1 AS seg_no, trim(segment) AS segment FROM fin WHERE length(trim(regexp_replace(segment, '[^\p{L}\p{N}_\s]', '', 'g'))) >= 10)"
)


@query(f"WITH RECURSIVE {D_SEGMENTS} SELECT content_id, seg_no, sha256(segment) AS h FROM segs")
def c2_segments(spark, sf_dir):
    return sg.segments(docs(spark, sf_dir)).select("content_id", F.col("seg_no").cast("long").alias("seg_no"), F.sha2("segment", 256).alias("h"))


@query(f"WITH {D_SENTENCES}, g AS (SELECT content_id, place // 10 AS posicion, string_agg(sentence, ' ' ORDER BY place) AS texto, count(*) AS n_oraciones FROM sent GROUP BY ALL) SELECT content_id || '_' || lpad(posicion::VARCHAR, 4, '0') || '_' || substr(sha256(texto), 1, 8) AS chunk_id, content_id, posicion::BIGINT AS posicion, n_oraciones FROM g")
def c3_sentence_chunks(spark, sf_dir):
    return sg.sentence_chunks(docs(spark, sf_dir)).select("chunk_id", "content_id", "posicion", "n_oraciones")


@query(
    f"WITH RECURSIVE {D_SENTENCES}, ch AS (SELECT content_id, place // 10 AS posicion, min_by(sentence, place) AS head, sum(length(sentence) + 1)::BIGINT - 1 AS n FROM sent GROUP BY ALL), "
    "r(content_id, posicion, start_char, end_char) AS (SELECT content_id, posicion, instr(text, head) - 1, instr(text, head) - 1 + n FROM ch JOIN documents ON doc_id = content_id WHERE posicion = 0 "
    "UNION ALL SELECT c.content_id, c.posicion, CASE WHEN instr(substr(d.text, end_char + 1), head) > 0 THEN end_char + instr(substr(d.text, end_char + 1), head) - 1 ELSE end_char END, CASE WHEN instr(substr(d.text, end_char + 1), head) > 0 THEN end_char + instr(substr(d.text, end_char + 1), head) - 1 ELSE end_char END + n "
    "FROM r JOIN ch c ON c.content_id = r.content_id AND c.posicion = r.posicion + 1 JOIN documents d ON d.doc_id = c.content_id) SELECT content_id, posicion::BIGINT AS posicion, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char FROM r"
)
def c3_chunk_offsets(spark, sf_dir):
    return sg.sentence_chunk_offsets(docs(spark, sf_dir))


D_PARAGRAPHS = r"list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"WITH p AS (SELECT doc_id AS content_id, unnest({D_PARAGRAPHS}) AS p, generate_subscripts({D_PARAGRAPHS}, 1) - 1 AS place FROM documents) SELECT content_id, (place // 3)::BIGINT AS posicion, sha256(string_agg(p, chr(10) || chr(10) ORDER BY place)) AS h, 0::BIGINT AS n_oraciones FROM p GROUP BY ALL")
def c4_paragraph_chunks(spark, sf_dir):
    spaced = docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return sg.paragraph_chunks(spaced).select("content_id", "posicion", F.sha2("texto", 256).alias("h"), "n_oraciones")


@query("WITH k AS (SELECT doc_id AS content_id, text, unnest(generate_series(0, ceil(greatest(0, length(text) - 2000) / 1800.0)::BIGINT)) AS k FROM documents WHERE length(text) > 0) SELECT content_id, k AS posicion, k * 1800 AS start_char, sha256(substr(text, k * 1800 + 1, 2000)) AS h FROM k")
def c5_character_chunks(spark, sf_dir):
    return sg.character_chunks(docs(spark, sf_dir), 2000, 200).select("content_id", "posicion", "start_char", F.sha2("texto", 256).alias("h"))


@query()
def c6_guarded_chunks(spark, sf_dir):
    return sg.guard_chunks(sg.sentence_chunks(docs(spark, sf_dir), 40))


_NOISE = " AND ".join(f"NOT contains(lower(texto), '{w}')" for w in sg.QUOTE_NOISE)


@query(
    r"""WITH d AS (SELECT doc_id AS content_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, 40) || ' "' || substr(replace(text, '"', ''), 30, 60) || '" ' || text END AS text FROM documents), q AS (SELECT content_id, text, unnest(regexp_extract_all(text, '"([^"]+)"', 1)) AS quote, generate_subscripts(regexp_extract_all(text, '"([^"]+)"', 1), 1) - 1 AS place FROM d), """
    rf"""r AS (SELECT *, regexp_replace(quote, '^\s+|\s+$', '', 'g') AS texto FROM q) SELECT content_id, place::BIGINT AS place, texto, regexp_replace(substr(text, greatest(1, instr(text, quote) - 200), 400), '^\s+|\s+$', '', 'g') AS contexto, length(texto)::BIGINT AS longitud FROM r WHERE length(texto) >= 20 AND {_NOISE} AND length(trim(regexp_replace(quote, '[^\p{{L}}\p{{N}}_\s]', '', 'g'))) >= 10"""
)
def c7_quotes(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.when(F.col("content_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.substring("text", 1, 40), F.lit(' "'), F.substring(F.replace("text", F.lit('"'), F.lit("")), 30, 60), F.lit('" '), "text")))
    return sg.quotes(d)


_NAME_NOISE = ", ".join(f"'{w}'" for w in sg.NAME_NOISE)


@query(
    r"WITH ts AS (SELECT doc_id AS content_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS ts FROM documents), t AS (SELECT content_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS n FROM ts), s AS (SELECT *, lag(tok) OVER (PARTITION BY content_id ORDER BY n) AS sep FROM t), "
    r"w AS (SELECT content_id, n, tok, sep, regexp_full_match(tok, '\p{Lu}\p{Ll}+') AS cap FROM s WHERE regexp_full_match(tok, '[\p{L}\p{N}_]+')), b AS (SELECT *, coalesce(cap AND lag(cap) OVER (PARTITION BY content_id ORDER BY n) AND regexp_full_match(sep, '\s+'), FALSE) AS on_ FROM w), "
    "g AS (SELECT *, sum((NOT on_)::INT) OVER (PARTITION BY content_id ORDER BY n) AS run FROM b), m AS (SELECT DISTINCT content_id, string_agg(CASE WHEN on_ THEN sep || tok ELSE tok END, '' ORDER BY n) AS name FROM g WHERE cap GROUP BY content_id, run HAVING count(*) > 1) "
    rf"SELECT content_id, name FROM m WHERE length(name) > 3 AND len(list_intersect(regexp_split_to_array(lower(name), '\s+'), [{_NAME_NOISE}])) = 0"
)
def c8_proper_names(spark, sf_dir):
    return sg.proper_names(docs(spark, sf_dir))


_VERBS = [*sg.RELATIONS, ("of", "of"), ("de", "de")]
_W1 = r"([\p{L}\p{N}_]+)"
_FOUND = " UNION ALL ".join(rf"SELECT doc_id AS content_id, '{k}' AS tipo, unnest(regexp_extract_all(lower(text), '{_W1}\s+(?:{v})\s+{_W1}', 0)) AS m FROM documents" for k, v in _VERBS)


@query(f"WITH f AS ({_FOUND}) SELECT content_id, regexp_extract(m, '^{_W1}', 1) AS origen, tipo, regexp_extract(m, '{_W1}$', 1) AS destino, 1.0::DOUBLE AS peso FROM f")
def c9_relations(spark, sf_dir):
    return sg.relations(docs(spark, sf_dir), patterns=_VERBS)


@query("WITH t AS (SELECT lower(text) AS t, doc_id AS content_id FROM documents), p(phrase) AS (VALUES ('of the'), ('in the'), ('de la'), ('tion')) SELECT content_id, phrase, ((length(t) - length(replace(t, phrase, ''))) // length(phrase))::BIGINT AS n FROM t, p WHERE contains(t, phrase)")
def c10_phrase_counts(spark, sf_dir):
    return sg.phrase_counts(docs(spark, sf_dir), ["of the", "in the", "de la", "tion"])


D_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"WITH w AS (SELECT doc_id AS content_id, unnest({D_WORDS}) AS w, generate_subscripts({D_WORDS}, 1) - 1 AS place FROM documents), g AS (SELECT content_id, 1 AS kind, place, w AS gram FROM w UNION ALL SELECT content_id, 2, place, w || ' ' || lead(w) OVER (PARTITION BY content_id ORDER BY place) FROM w) SELECT content_id, kind::BIGINT AS kind, gram, count(*) AS n, min(place)::BIGINT AS first FROM g WHERE gram IS NOT NULL GROUP BY ALL")
def c12_word_windows(spark, sf_dir):
    return sg.counted_windows(docs(spark, sf_dir))


@query("SELECT doc_id, length(text) >= 30 AND NOT contains(text, 'http') AND NOT contains(text, '{') AND NOT contains(text, 'License') AS ok FROM documents")
def d9_quote_validity(spark, sf_dir):
    bad = F.col("text").contains("http") | F.col("text").contains("{") | F.col("text").contains("License")
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length("text") >= 30) & ~bad).alias("ok"))


@query(f"WITH {D_COUNTS}, {D_STOP}, own(source, term) AS (VALUES ('src0', 'tion'), ('src1', 'ther'), ('src2', 'ment')) SELECT content_id, c.term, frequency FROM counts c JOIN documents d ON d.doc_id = c.content_id WHERE c.term NOT IN (SELECT term FROM stop) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.source = d.source AND o.term = c.term)")
def d14_domain_stopwords(spark, sf_dir):
    own = spark.createDataFrame([("src0", "tion"), ("src1", "ther"), ("src2", "ment")], "source string, term string")
    c = tm.without(tm.term_counts(docs(spark, sf_dir)), words_frame(spark, STOPWORDS)).join(docs(spark, sf_dir).select("content_id", "source"), "content_id")
    return c.join(own, ["source", "term"], "left_anti").select("content_id", "term", "frequency")


def _segments(spark, sf_dir):
    t = timed(spark, sf_dir)
    return t.select(F.col("video_id").alias("content_id"), "seg_no", "hablante", "inicio", "fin", F.col("texto").alias("segment"))


_LEX = values([(w, *x) for w, x in LEXICON.items()])
D_SENTIMENT = (
    r"raw AS (SELECT conv_id AS content_id, turn AS seg_no, role AS hablante, unnest(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[.,;:!?¡¿()\[\]{}\"'']+|[.,;:!?¡¿()\[\]{}\"'']+$', '', 'g'))) AS word FROM conversations), "
    f"lex(word, pos, neg, sesgo) AS (SELECT * FROM {_LEX}), senti AS (SELECT content_id, seg_no, hablante, coalesce(sum(pos), 0)::DOUBLE AS pos, coalesce(sum(neg), 0)::DOUBLE AS neg, coalesce(sum(sesgo), 0)::DOUBLE AS sesgo, count(pos) AS matches, count(*) AS n_palabras FROM raw LEFT JOIN lex USING (word) GROUP BY ALL)"
)


def _sentiment(spark, sf_dir):
    lex = spark.createDataFrame([(w, *x) for w, x in LEXICON.items()], "word string, pos double, neg double, sesgo double")
    return sg.lexicon_sentiment(_segments(spark, sf_dir), F.broadcast(lex), ["content_id", "seg_no", "hablante"])  # a short lexicon


@query(f"WITH {D_SENTIMENT} SELECT hablante, round(avg(round(pos - neg, 3)), 3) AS promedio, round(min(pos - neg), 3) AS minimo, round(max(pos - neg), 3) AS maximo, count(*) AS n_segmentos, CASE WHEN count(*) >= 5 THEN 'alta' WHEN count(*) >= 2 THEN 'media' ELSE 'baja' END AS confianza FROM senti GROUP BY hablante")
def f9_sentiment_by_speaker(spark, sf_dir):
    return sg.by_speaker(_sentiment(spark, sf_dir))


@query(f"WITH {D_SENTIMENT} SELECT content_id, round(coalesce(avg(pos - neg), 0), 3) AS polaridad, round(coalesce(avg(sesgo), 0), 3) AS subjetividad FROM senti GROUP BY content_id")
def f10_global_sentiment(spark, sf_dir):
    return _sentiment(spark, sf_dir).groupBy("content_id").agg(F.round(F.coalesce(F.avg("polaridad"), F.lit(0.0)), 3).alias("polaridad"), F.round(F.coalesce(F.avg("sesgo"), F.lit(0.0)), 3).alias("subjetividad"))


@query(f"WITH {D_SENTIMENT} SELECT content_id, seg_no, round(pos - neg, 3) AS polaridad, round(CASE WHEN matches > 0 THEN (pos - neg) / matches ELSE 0 END, 3) AS polaridad_norm, round(matches / n_palabras, 3) AS densidad, round(sesgo, 3) AS sesgo, matches, n_palabras FROM senti")
def f11_lexicon_sentiment(spark, sf_dir):
    return _sentiment(spark, sf_dir).drop("hablante")


D_COOCCURRENCES = (
    f"{D_SEGMENTS}, {D_COUNTS}, {D_STOP}, keys AS (SELECT content_id, term, row_number() OVER (PARTITION BY content_id ORDER BY frequency DESC, place) AS rank FROM counts WHERE term NOT IN (SELECT term FROM stop) QUALIFY rank <= 10), low AS (SELECT content_id, seg_no, {SQUEEZE.format(d_norm('lower(segment)'))} AS t FROM segs), "
    "hit AS (SELECT l.content_id, seg_no, term, rank FROM low l JOIN keys k ON k.content_id = l.content_id AND contains(l.t, k.term)), p AS (SELECT a.content_id, a.term AS t1, b.term AS t2, a.rank AS i, b.rank AS j, count(*) AS n, min(a.seg_no) AS f FROM hit a JOIN hit b ON a.content_id = b.content_id AND a.seg_no = b.seg_no AND a.rank < b.rank GROUP BY ALL) "
    ", pairs AS (SELECT content_id, t1, t2, n, row_number() OVER (PARTITION BY content_id ORDER BY n DESC, f, i, j) AS rank FROM p QUALIFY rank <= 15)"
)


@query(f"WITH RECURSIVE {D_COOCCURRENCES} SELECT content_id, t1, t2, n, rank FROM pairs")
def f12_cooccurrences(spark, sf_dir):
    return sg.document_cooccurrences(docs(spark, sf_dir), STOPWORDS)


@query(f"WITH RECURSIVE {D_COOCCURRENCES} SELECT content_id, t1, t2, n, rank FROM pairs")
def f12_joined_cooccurrences(spark, sf_dir):
    """The same from tables of segments and of key terms."""
    d = docs(spark, sf_dir)
    return sg.cooccurrences(sg.segments(d), tm.key_terms(d, words_frame(spark, STOPWORDS), 10))


_CONCEPT_CTE = ", ".join(f"('{c}', '{w}')" for c, ws in CONCEPTS.items() for w in ws)


@query(rf"WITH {D_TIMED}, con(concepto, w) AS (VALUES {_CONCEPT_CTE}), hit AS (SELECT DISTINCT video_id, seg_no, concepto FROM timed, con WHERE list_contains(regexp_extract_all(lower(texto), '[\p{{L}}\p{{N}}_]+'), w)) SELECT video_id AS content_id, concepto, count(*) AS n FROM hit GROUP BY ALL")
def f13_concept_counts(spark, sf_dir):
    return sg.concept_counts(_segments(spark, sf_dir), CONCEPTS, ["content_id"])


_CONTEXT_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in CONCEPTS.items()) + " ELSE 'NO_CLASIFICADO' END"


@query(
    f"WITH {D_SENTIMENT}, c AS (SELECT s.content_id, s.seg_no, round(pos - neg, 3) AS pol, {_CONTEXT_CASE} AS contexto, count(*) OVER (PARTITION BY s.content_id) AS n FROM senti s JOIN conversations v ON v.conv_id = s.content_id AND v.turn = s.seg_no), "
    "z AS (SELECT *, least(seg_no // greatest(1, n // 5), 4) + 1 AS seccion FROM c), m AS (SELECT content_id, seccion, contexto, count(*) AS k, min(seg_no) AS f FROM z GROUP BY ALL), top AS (SELECT content_id, seccion, contexto FROM m QUALIFY row_number() OVER (PARTITION BY content_id, seccion ORDER BY k DESC, f) = 1) "
    "SELECT z.content_id, z.seccion::BIGINT AS seccion, count(*)::BIGINT AS segmentos, round(sum(pol) / count(*), 3) AS polaridad_promedio, round(min(pol), 3) AS polaridad_min, round(max(pol), 3) AS polaridad_max, any_value(top.contexto) AS contexto_predominante FROM z JOIN top USING (content_id, seccion) GROUP BY z.content_id, z.seccion"
)
def f14_temporal_profile(spark, sf_dir):
    s = _sentiment(spark, sf_dir).join(_segments(spark, sf_dir).select("content_id", "seg_no", sg.context(F.col("segment"), CONCEPTS).alias("contexto")), ["content_id", "seg_no"])
    return sg.temporal_profile(s).withColumn("seccion", F.col("seccion").cast("long")).withColumn("segmentos", F.col("segmentos").cast("long"))


@query(f"SELECT conv_id AS content_id, turn AS seg_no, {_CONTEXT_CASE} AS contexto FROM conversations")
def f15_segment_context(spark, sf_dir):
    return _segments(spark, sf_dir).select("content_id", "seg_no", sg.context(F.col("segment"), CONCEPTS).alias("contexto"))


@query("SELECT conv_id AS video_id, count(*) AS segmentos FROM conversations GROUP BY conv_id")
def f16_segments_a_video(spark, sf_dir):
    return timed(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("segmentos"))


@query("WITH r AS (SELECT role AS origen, 'turn' || turn AS destino, 'dice' AS tipo, 1.0::DOUBLE AS peso FROM conversations) SELECT origen, destino, tipo, round(sum(peso), 3) AS peso, count(*) AS frecuencia FROM r GROUP BY ALL")
def f17_consolidated_relations(spark, sf_dir):
    t = timed(spark, sf_dir).select(F.col("hablante").alias("origen"), F.concat(F.lit("turn"), "seg_no").alias("destino"), F.lit("dice").alias("tipo"), F.lit(1.0).alias("peso"))
    return sg.consolidated(t)


@query(f"WITH w AS (SELECT doc_id, len({D_WORDS})::BIGINT AS n, len(list_filter({D_WORDS}, lambda w: w IN ('tion', 'ther', 'ment')))::BIGINT AS k FROM documents) SELECT doc_id, n, k, CASE WHEN n = 0 THEN 0 ELSE round(100.0::DOUBLE * k / n, 2) END AS densidad, CASE WHEN n > 0 AND 100.0::DOUBLE * k / n > 5 THEN 'alta' WHEN n > 0 AND 100.0::DOUBLE * k / n > 2 THEN 'media' ELSE 'baja' END AS nivel FROM w")
def f25_complexity(spark, sf_dir):
    w = tx.words(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.filter(w, lambda x: x.isin("tion", "ther", "ment"))).cast("long").alias("k"))
    share = F.when(F.col("n") > 0, 100.0 * F.col("k") / F.col("n")).otherwise(0.0)
    return d.select("doc_id", "n", "k", F.round(share, 2).alias("densidad"), F.when(share > 5, "alta").when(share > 2, "media").otherwise("baja").alias("nivel"))


@query("SELECT conv_id AS content_id, turn AS seg_no, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ventana FROM conversations")
def g8_context_window(spark, sf_dir):
    return sg.neighbours(_segments(spark, sf_dir)).select("content_id", "seg_no", "ventana")


@query(
    f"WITH w AS (SELECT doc_id AS content_id, lower(text) AS low, len(list_filter({D_WORDS}, lambda w: w IN ('tion', 'ther', 'ment')))::BIGINT AS k, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM documents), d AS (SELECT *, CASE WHEN n > 0 THEN floor(k * 100::DOUBLE / n * 100) / 100 ELSE 0 END AS densidad FROM w) "
    "SELECT content_id, CASE WHEN contains(low, 'anding') OR contains(low, 'chlich') THEN 'practico' WHEN contains(low, 'tioner') OR contains(low, 'mente') THEN 'tecnico' ELSE 'mixto' END AS estilo, densidad, CASE WHEN densidad > 5 OR (densidad = 0 AND n > 10000) THEN 'alta' WHEN densidad > 2 OR (densidad = 0 AND n > 5000) THEN 'media' ELSE 'baja' END AS complejidad FROM d"
)
def f25_style(spark, sf_dir):
    return sg.style(docs(spark, sf_dir), ["anding", "chlich"], ["tioner", "mente"], ["tion", "ther", "ment"])
