"""Queries on domains, speakers, quotes and critical reading: H1-H12, D7, D8, D10-D13, D15, C11."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import domains as dm
from corpusloom.operators import segments as sg
from corpusloom.operators import tables as tb
from corpusloom.operators import templates as tp
from corpusloom.operators import terms as tm
from corpusloom.plans.base import D_COUNTS, D_SENTENCES, D_STOP, DOMAINS, PRIORITY, STOPWORDS, d_norm, docs, table, timed, values, words_frame
from corpusloom.plans.registry import query

_LOW = rf"trim(regexp_replace({d_norm('lower(text)')}, '\s+', ' ', 'g'))"
_DOMAIN_VALUES = values([(d, i, t) for i, (d, ts) in enumerate(DOMAINS.items()) for t in ts])
_PRIORITY = values(list(PRIORITY.items()))
#: Whole-word matches of each domain term.
D_MATCHES = rf"dom(nicho, ord, term) AS (SELECT * FROM {_DOMAIN_VALUES}), wl AS (SELECT doc_id AS content_id, unnest(regexp_extract_all({_LOW}, '[\p{{L}}\p{{N}}_]+')) AS w FROM documents), matched AS (SELECT content_id, nicho, ord, term, count(*) AS n FROM wl JOIN dom ON w = term GROUP BY ALL)"
D_SCORES = f"{D_MATCHES}, scores AS (SELECT content_id, nicho, sum(least(n, 5))::BIGINT AS score FROM matched GROUP BY ALL)"
D_DOMAIN = f"{D_SCORES}, pri(nicho, p) AS (SELECT * FROM {_PRIORITY}), best AS (SELECT content_id, nicho FROM scores JOIN pri USING (nicho) QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY score DESC, p DESC) = 1), nichos AS (SELECT doc_id AS content_id, coalesce(nicho, 'GENERAL') AS nicho FROM documents LEFT JOIN best ON content_id = doc_id)"


@query(f"WITH {D_DOMAIN} SELECT content_id, nicho FROM nichos")
def h1_domain(spark, sf_dir):
    return dm.domain(docs(spark, sf_dir), DOMAINS, PRIORITY)


@query(f"WITH {D_SCORES} SELECT content_id, nicho, score FROM scores")
def h1_domain_scores(spark, sf_dir):
    return dm.domain_scores(docs(spark, sf_dir), DOMAINS)


HYBRIDS = {("SALUD", "TECNOLOGIA"): "HEALTH-TECH", ("FINANZAS", "SALUD"): "HEALTH-FIN"}
_CONF = rf"dom(nicho, ord, term) AS (SELECT * FROM {_DOMAIN_VALUES}), wl AS (SELECT DISTINCT doc_id AS content_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents), conf AS (SELECT content_id, nicho, ord, round(least(1.0, count(*) / 10.0), 2) AS c FROM wl JOIN dom ON w = term GROUP BY ALL)"


@query(
    f"WITH {_CONF}, hyb(k, h) AS (VALUES ('SALUD|TECNOLOGIA', 'HEALTH-TECH'), ('FINANZAS|SALUD', 'HEALTH-FIN')), top AS (SELECT content_id, nicho AS dominante FROM conf QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY c DESC, ord) = 1), al AS (SELECT content_id, string_agg(nicho, ',' ORDER BY ord) AS etiquetas FROM conf GROUP BY content_id), "
    "hi AS (SELECT content_id, nicho FROM conf WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY ord) <= 2), hk AS (SELECT content_id, string_agg(nicho, '|' ORDER BY nicho) AS k FROM hi GROUP BY content_id HAVING count(*) = 2) "
    "SELECT doc_id AS content_id, coalesce(dominante, 'GENERAL') AS dominante, h AS hibrido, coalesce(etiquetas, 'GENERAL') AS etiquetas FROM documents LEFT JOIN top ON top.content_id = doc_id LEFT JOIN al ON al.content_id = doc_id LEFT JOIN hk ON hk.content_id = doc_id LEFT JOIN hyb USING (k)"
)
def h2_multi_label(spark, sf_dir):
    return dm.multi_label(docs(spark, sf_dir), DOMAINS, HYBRIDS, 0.3)


def _hits(words: str) -> str:
    return f"SELECT content_id, nicho, count(*) AS n FROM (SELECT content_id, unnest({words}) AS w FROM b) JOIN dom ON w = term GROUP BY ALL"


_WORDS_IN = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"


D_HIERARCHY = (
    rf"dom(nicho, ord, term) AS (SELECT * FROM {_DOMAIN_VALUES}), b0 AS (SELECT doc_id AS content_id, lower(text) AS low, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM documents), "
    "b AS (SELECT content_id, low, len(w) AS n, array_to_string(w[1:floor(len(w) * 0.15::DOUBLE)::INT], ' ') AS head, array_to_string(w[floor(len(w) * 0.85::DOUBLE)::INT + 1:], ' ') AS tail FROM b0), "
    f"de AS ({_hits(_WORDS_IN.format('low'))}), en AS (SELECT content_id, nicho, sum(n) AS n FROM ({_hits(_WORDS_IN.format('head'))} UNION ALL {_hits(_WORDS_IN.format('tail'))}) GROUP BY ALL), "
    r"st AS (SELECT content_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM (SELECT content_id, list_transform(regexp_split_to_array(low, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS ss FROM b)), "
    rf"sw AS (SELECT DISTINCT content_id, k, s, unnest({_WORDS_IN.format('s')}) AS w FROM st), sy AS (SELECT content_id, nicho, sum(CASE WHEN regexp_extract(s, '^[\p{{L}}\p{{N}}_]+') = term THEN 3 ELSE 1 END) AS n FROM sw JOIN dom ON w = term GROUP BY ALL), "
    "v AS (SELECT b.content_id, d.nicho, coalesce(de.n, 0)::DOUBLE AS density, CASE WHEN b.n >= 10 THEN coalesce(de.n, 0) + coalesce(en.n, 0) ELSE 0 END::DOUBLE AS position, coalesce(sy.n, 0)::DOUBLE AS syntax FROM b CROSS JOIN (SELECT DISTINCT nicho FROM dom) d LEFT JOIN de ON de.content_id = b.content_id AND de.nicho = d.nicho LEFT JOIN en ON en.content_id = b.content_id AND en.nicho = d.nicho LEFT JOIN sy ON sy.content_id = b.content_id AND sy.nicho = d.nicho), "
    "p AS (SELECT content_id, nicho, round(coalesce(100 * density / nullif(sum(density) OVER c, 0), 0), 2) AS d, round(coalesce(100 * position / nullif(sum(position) OVER c, 0), 0), 2) AS e, round(coalesce(100 * syntax / nullif(sum(syntax) OVER c, 0), 0), 2) AS f FROM v WINDOW c AS (PARTITION BY content_id)), "
    "hier AS (SELECT content_id, nicho, round(0.4::DOUBLE * d + 0.3::DOUBLE * e + 0.3::DOUBLE * f, 2) AS score FROM p)"
)


@query(f"WITH {D_HIERARCHY} SELECT content_id, nicho, score FROM hier")
def h3_weighted_hierarchy(spark, sf_dir):
    return dm.weighted_hierarchy(docs(spark, sf_dir), DOMAINS)


TOOLS, CONTEXTS = ["TECNOLOGIA"], ["LEGAL", "FINANZAS"]
_KINDS = "CASE WHEN nicho = 'TECNOLOGIA' THEN 'herramienta' WHEN nicho IN ('LEGAL', 'FINANZAS') THEN 'contexto' ELSE 'secundario' END"
D_ROLES = (
    f"{D_HIERARCHY}, pl AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY score DESC, nicho) AS k, {_KINDS} AS kind FROM hier), la AS (SELECT content_id, kind, CASE WHEN score > 0 THEN nicho END AS nicho FROM pl WHERE k > 1 QUALIFY row_number() OVER (PARTITION BY content_id, kind ORDER BY k DESC) = 1), "
    "ro AS (SELECT p.content_id, p.nicho AS principal, max(la.nicho) FILTER (la.kind = 'herramienta') AS herramienta, max(la.nicho) FILTER (la.kind = 'contexto') AS contexto, max(la.nicho) FILTER (la.kind = 'secundario') AS secundario FROM pl p LEFT JOIN la ON la.content_id = p.content_id WHERE p.k = 1 GROUP BY p.content_id, p.nicho)"
)


@query(f"WITH {D_ROLES} SELECT * FROM ro")
def h3_roles(spark, sf_dir):
    return dm.roles(h3_weighted_hierarchy(spark, sf_dir), TOOLS, CONTEXTS)


D_DECISION = f"{D_ROLES}, mg AS (SELECT content_id, max(score) FILTER (k = 1) - max(score) FILTER (k = 2) AS margin, max(score) FILTER (k = 2) AS s2 FROM pl WHERE score > 0 GROUP BY content_id), de2 AS (SELECT ro.content_id, CASE WHEN s2 IS NOT NULL AND margin < 5 THEN 'GENERAL' ELSE principal END AS principal, herramienta, contexto, secundario, ro.content_id % 2 = 0 AS es_habla FROM ro LEFT JOIN mg USING (content_id))"


def _decision(spark, sf_dir):
    names = docs(spark, sf_dir).select("content_id", F.when(F.col("content_id") % 2 == 0, F.format_string("Transcript_%d.txt", "content_id")).otherwise(F.format_string("doc_%d.txt", "content_id")).alias("name"))
    return dm.decision(h3_weighted_hierarchy(spark, sf_dir), names, TOOLS, CONTEXTS)


@query(f"WITH {D_DECISION} SELECT content_id, principal, herramienta, contexto, secundario, es_habla, concat_ws(',', principal, herramienta, contexto, secundario, CASE WHEN es_habla THEN 'HABLA' END) AS nichos FROM de2")
def h5_decision(spark, sf_dir):
    return _decision(spark, sf_dir).withColumn("nichos", F.array_join("nichos", ","))


READERS = {"TECNOLOGIA": "tecnico", "SALUD": "divulgacion", "LEGAL": "ejecutivo", "FINANZAS": "ejecutivo"}


@query(f"WITH {D_DECISION}, r(nicho, perfil) AS (SELECT * FROM {values(list(READERS.items()))}) SELECT content_id, CASE WHEN herramienta IN ('RAG') THEN 'tecnico' WHEN contexto IN ('LEGAL') THEN 'ejecutivo' ELSE coalesce(perfil, 'tecnico') END AS perfil FROM de2 LEFT JOIN r ON r.nicho = principal")
def m5_reader(spark, sf_dir):
    return _decision(spark, sf_dir).select("content_id", tp.reader(F.col("principal"), F.col("herramienta"), F.col("contexto"), READERS, ["RAG"], ["LEGAL"]).alias("perfil"))


ALLOWED_TOOLS = {"SALUD": ["A", "B"], "TECNOLOGIA": ["B", "C"], "FINANZAS": ["A", "C"], "LEGAL": ["C"]}
MARKERS = {"A": ["therer", "inges"], "B": ["mentio", "tionin", "oned"], "C": ["lichen", "ation", "auxé"]}


@query(
    f"WITH {D_DOMAIN}, mk(tool, ord, marker) AS (SELECT * FROM {values([(t, i, m) for i, (t, ms) in enumerate(MARKERS.items()) for m in ms])}), ok(nicho, tool) AS (SELECT * FROM {values([(d, t) for d, ts in ALLOWED_TOOLS.items() for t in ts])}), "
    "h AS (SELECT n.content_id, mk.tool, mk.ord, count(*) AS k FROM nichos n JOIN ok USING (nicho) JOIN mk ON mk.tool = ok.tool JOIN documents d ON d.doc_id = n.content_id AND contains(lower(d.text), mk.marker) GROUP BY ALL), b AS (SELECT content_id, tool FROM h QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY k DESC, ord) = 1) SELECT n.content_id, nicho, tool AS herramienta FROM nichos n LEFT JOIN b USING (content_id)"
)
def h4_detected_tool(spark, sf_dir):
    d = docs(spark, sf_dir)
    return dm.domain(d, DOMAINS, PRIORITY).join(d.select("content_id", "text"), "content_id").select("content_id", "nicho", dm.detected_tool(F.col("text"), F.col("nicho"), ALLOWED_TOOLS, MARKERS).alias("herramienta"))


ALLOWED = [("SALUD", "src0"), ("TECNOLOGIA", "src1"), ("FINANZAS", "src2"), ("LEGAL", "src0"), ("GENERAL", "src3")]


@query(f"WITH {D_DOMAIN}, ok(nicho, herramienta) AS (SELECT * FROM {values(ALLOWED)}) SELECT n.content_id, n.nicho, ok.herramienta, ok.herramienta IS NOT NULL AS coherente FROM nichos n JOIN documents d ON d.doc_id = n.content_id LEFT JOIN ok ON ok.nicho = n.nicho AND ok.herramienta = d.source")
def h4_coherence(spark, sf_dir):
    rows = dm.domain(docs(spark, sf_dir), DOMAINS, PRIORITY).join(docs(spark, sf_dir).select("content_id", F.col("source").alias("herramienta")), "content_id")
    return dm.coherent(rows, spark.createDataFrame(ALLOWED, "nicho string, herramienta string"))


@query(f"WITH {D_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY score DESC, nicho) AS k FROM scores), t AS (SELECT content_id, max(nicho) FILTER (k = 1) AS f, max(score) FILTER (k = 1) AS s1, max(score) FILTER (k = 2) AS s2 FROM r GROUP BY content_id) SELECT content_id, CASE WHEN s2 IS NOT NULL AND s1 - s2 < 5 THEN 'GENERAL' ELSE f END AS nicho FROM t")
def h5_final_domain(spark, sf_dir):
    return dm.final_domain(dm.domain_scores(docs(spark, sf_dir), DOMAINS))


CATALOGUE = [("SALUD", "TECNOLOGIA", "HEALTH-TECH"), ("FINANZAS", "SALUD", "HEALTH-FIN")]


@query(
    f"WITH {D_SCORES}, r AS (SELECT * FROM scores WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY score DESC, nicho) <= 2), p AS (SELECT content_id, min(nicho) AS a, max(nicho) AS b FROM r GROUP BY content_id HAVING count(*) = 2), cat(a, b, nombre) AS (SELECT * FROM {values(CATALOGUE)}) SELECT content_id, coalesce(nombre, a || '-' || b) AS hibrido, nombre IS NULL AS nuevo FROM p LEFT JOIN cat USING (a, b)"
)
def h6_hybrid_label(spark, sf_dir):
    return dm.hybrid_label(dm.domain_scores(docs(spark, sf_dir), DOMAINS), spark.createDataFrame(CATALOGUE, "a string, b string, nombre string"), 3)


@query()
def h7_fuzzy_votes(spark, sf_dir):
    terms = [(t, d) for d, ts in DOMAINS.items() for t in ts]
    return dm.fuzzy_votes(docs(spark, sf_dir), spark.createDataFrame([(t, d, i) for i, (t, d) in enumerate(terms)], "term string, nicho string, place int"))


_SAID = "said AS (SELECT conv_id AS content_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || replace(text, chr(10), ' ')) AS text FROM conversations GROUP BY conv_id)"
_MODE = r"CASE WHEN regexp_matches(lower(text), 'juez|fiscal|abogado|testigo|tribunal|judge|attorney|court|lawyer') THEN 'legal' WHEN len(regexp_extract_all(text, '(?m)^[A-ZÁÉÍÓÚÑ][\p{L} ]{1,40}:')) > 5 THEN 'ateneo' WHEN len(regexp_extract_all(text, '(?m)^[A-ZÁÉÍÓÚÑ][\p{L} ]{1,40}:')) <= 1 AND len(string_split(text, chr(10))) > 20 THEN 'tutorial' ELSE 'auto' END"


def _said(spark, sf_dir):
    line = F.concat(F.initcap("hablante"), F.lit(": "), F.replace("texto", F.lit("\n"), F.lit(" ")))
    lines = timed(spark, sf_dir).groupBy(F.col("video_id").alias("content_id")).agg(F.array_sort(F.collect_list(F.struct("seg_no", line.alias("line")))).alias("l"))
    return lines.select("content_id", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("text"))


@query(f"WITH {_SAID} SELECT content_id, {_MODE} AS modo FROM said")
def h8_speaker_mode(spark, sf_dir):
    return _said(spark, sf_dir).select("content_id", dm.speaker_mode(F.col("text")).alias("modo"))


#: The operator's classes in RE2, which knows white space and word ends in ASCII only.
_PROFESSION = dm.PROFESSION.replace("(?iU)", "(?i)").replace(r"\s", r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
_NO_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}]"


@query(
    rf"WITH {_SAID}, m AS (SELECT *, {_MODE} AS modo, len(string_split(text, chr(10))) AS n FROM said), xs AS (SELECT content_id, modo, n, list_concat(regexp_extract_all(text, '(?m)^([\p{{L}}][\p{{L}} ]{{1,40}}):', 1), regexp_extract_all(text, '{_PROFESSION}'), CASE WHEN modo = 'legal' THEN list_transform(list_filter(regexp_split_to_array(text, '{_NO_WORD}+'), lambda w: regexp_full_match(w, '(?i)testigo')), lambda w: 'testigo') ELSE [] END) AS xs FROM m), names AS (SELECT content_id, modo, n, unnest(CASE WHEN modo = 'legal' AND len(xs) = 0 THEN ['persona1', 'persona2', 'persona3'][1:least(3, n)] ELSE xs END) AS nombre FROM xs), mod(modo, rate, cap) AS (VALUES ('tutorial', 0.05::DOUBLE, 1), ('ateneo', 0.02, 10), ('legal', 0.01, 20), ('auto', 0.03, 10)), "
    "c AS (SELECT content_id, modo, n, nombre, count(*) AS veces FROM names GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY veces DESC, nombre) AS r FROM c JOIN mod USING (modo) WHERE veces >= CASE WHEN modo = 'tutorial' THEN 2 * floor(n * rate) ELSE floor(n * rate) END) SELECT content_id, nombre, veces, r = 1 AS principal FROM k WHERE r <= cap"
)
def h9_speakers(spark, sf_dir):
    said = _said(spark, sf_dir)
    return dm.speakers(said.withColumn("modo", dm.speaker_mode(F.col("text"))))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), lower(role) || ':') OR contains(lower(text), lower(role) || '-') OR NOT contains(lower(text), lower(role)) THEN role ELSE 'DESCONOCIDO' END AS hablante FROM conversations")
def h10_real_speakers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", dm.real_speaker(F.col("role"), F.col("text")).alias("hablante"))


@query(
    f"WITH {D_COUNTS}, {D_STOP}, {D_SENTENCES}, keys AS (SELECT content_id, term, row_number() OVER (PARTITION BY content_id ORDER BY frequency DESC, place) AS rank FROM counts WHERE term NOT IN (SELECT term FROM stop) QUALIFY rank <= 5), m AS (SELECT k.content_id, k.term, k.rank, s.place, s.sentence FROM keys k JOIN sent s ON s.content_id = k.content_id AND length(s.sentence) > 50 AND contains(lower(s.sentence), k.term) QUALIFY row_number() OVER (PARTITION BY k.content_id, k.term ORDER BY s.place) = 1), "
    "one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY content_id, sentence ORDER BY rank) = 1) SELECT content_id, term, rank, place::BIGINT AS place, sentence AS premisa, CASE WHEN contains(lower(sentence), 'tion') OR contains(lower(sentence), 'ment') THEN 'SOSTENIDO' WHEN contains(lower(sentence), 'the') OR contains(lower(sentence), 'de') THEN 'ESPECULATIVO' ELSE 'PARCIAL' END AS estado FROM one"
)
def h12_critical_reading(spark, sf_dir):
    d = docs(spark, sf_dir)
    return dm.critical_reading(sg.sentences(d), tm.key_terms(d, words_frame(spark, STOPWORDS), 5), ["tion", "ment"], ["the", "de"])


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src0'")
def d7_hierarchical_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("source") == "src0")).select("doc_id", "lang", "source")


@query("SELECT doc_id, source AS nicho, n_chars FROM documents WHERE source = 'src1'")
def d8_documents_of_domain(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id", F.col("source").alias("nicho"), "n_chars").orderBy("doc_id")


def _arrays(words):
    return F.array(*map(F.lit, words))


@query(f"SELECT p_partkey, length(p_name) < 3 OR lower(p_name) IN (SELECT * FROM {values([(w,) for w in STOPWORDS])}) AS generico FROM part")
def d10_generic_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ((F.length("p_name") < 3) | F.lower("p_name").isin(*STOPWORDS)).alias("generico"))


_PARTS = "SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS items FROM part"
_TECH_SQL = "(list_contains(['PROMO', 'LARGE', 'rod'], {c}) OR (contains({c}, '-') AND length({c}) > 5) OR regexp_full_match({c}, '[A-ZÁÉÍÓÚÑ]{{2,6}}'))"


@query(f"WITH p AS ({_PARTS}) SELECT p_partkey, array_to_string(list_filter(items, lambda c: {_TECH_SQL.format(c='c')}), ',') AS tecnicos FROM p")
def d11_technical_terms(spark, sf_dir):
    items = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.filter(items, lambda c: tb.is_technical(c, _arrays(["PROMO", "LARGE", "rod"]))), ",").alias("tecnicos"))


_REAL = "list_filter(items, lambda c: length(c) >= 3 AND NOT list_contains(['STANDARD', 'widget'], c))"


@query(f"WITH p AS ({_PARTS}) SELECT p_partkey, CASE WHEN len(items) = 0 THEN 'sin_conceptos' WHEN len({_REAL}) = 0 THEN 'solo_terminos_genericos' WHEN len(list_filter({_REAL}, lambda c: {_TECH_SQL.format(c='c')})) = 0 THEN 'sin_terminos_tecnicos' ELSE 'valida' END AS razon FROM p")
def d12_valid_concepts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tb.valid_concepts(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), _arrays(["PROMO", "LARGE", "rod"]), _arrays(["STANDARD", "widget"])).alias("razon"))


@query(f"WITH p AS ({_PARTS}), q AS (SELECT p_partkey, items, list_filter(items, lambda c: {_TECH_SQL.format(c='c')}) AS t, {_REAL} AS r FROM p) SELECT p_partkey, array_to_string(CASE WHEN len(t) >= 2 THEN t WHEN len(r) > 0 THEN r ELSE items END, ',') AS items FROM q")
def d13_filtered_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tb.filtered_terms(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), _arrays(["PROMO", "LARGE", "rod"]), _arrays(["STANDARD", "widget"])), ",").alias("items"))


@query("SELECT doc_id, source IN ('src0', 'src1') OR (source = 'src2' AND len(list_filter(string_split(text, ' '), lambda w: w IN ('tion', 'the'))) > 0) AS audio FROM documents")
def d15_audio_worthy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tp.audio_worthy(F.col("source"), F.split("text", " "), ["src0", "src1"], "src2", ["tion", "the"]).alias("audio"))

