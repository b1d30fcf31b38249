"""Tables in the shapes of the operators, and the same in SQL.

``documents`` are the contents, turns of ``conversations`` the timed segments (15 seconds each) and speakers,
``labels.quality`` the state of progress, ``benchmark`` the search queries, ``part`` a dictionary to look things up in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import terms as tm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), "text", "lang", "source")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.term_counts(docs(spark, sf_dir))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments ``video_id, seg_no, inicio, fin, hablante, texto``."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_no"), (F.col("turn") * 15.0).alias("inicio"), (F.col("turn") * 15.0 + 15.0).alias("fin"), F.col("role").alias("hablante"), F.col("text").alias("texto"))


def words_frame(spark: SparkSession, words: list[str], name: str = "term") -> DataFrame:
    """A short dictionary as a table."""
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


#: Function words of the four languages, our own short list.
STOPWORDS = "the and that with from this for was are not der die das und den von mit ist que los las una por con para del les des est pour dans pas une".split()
#: Domains by words and word parts of the corpus.
DOMAINS = {"SALUD": ["tion", "ther", "ment", "reth"], "TECNOLOGIA": ["mente", "ado", "ingre", "heit"], "FINANZAS": ["aux", "lich", "eren", "thes"], "LEGAL": ["inst", "oned", "enver", "ciones"]}
PRIORITY = {"FINANZAS": 9, "SALUD": 8, "LEGAL": 7, "TECNOLOGIA": 6}
TECHNICAL = ["tion", "ther", "ment", "mente", "ado", "lich", "heit", "keit", "ung", "cion"]
LEXICON = {"the": (0.5, 0.0, 0.0), "of": (0.25, 0.0, 0.0), "de": (0.0, 0.5, 0.0), "la": (0.5, 0.0, 0.25), "der": (0.0, 0.75, 0.0), "and": (0.0, 0.25, 0.5), "le": (1.0, 0.0, 0.0)}
CONCEPTS = {"INICIO": ["in", "the"], "DETALLE": ["of", "de"], "CIERRE": ["er", "la"]}


def values(rows: list[tuple]) -> str:
    """Rows as SQL VALUES."""
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def d_norm(x: str) -> str:
    """SQL: accents off but ñ kept."""
    return f"replace(replace(strip_accents(replace(replace({x}, 'ñ', chr(57344)), 'Ñ', chr(57345))), chr(57344), 'ñ'), chr(57345), 'Ñ')"


def d_terms(x: str) -> str:
    return f"list_filter(regexp_split_to_array({d_norm(f'lower({x})')}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"


def d_sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


D_TOKENS = f"tok AS (SELECT content_id, term, place FROM (SELECT doc_id AS content_id, unnest({d_terms('text')}) AS term, generate_subscripts({d_terms('text')}, 1) - 1 AS place FROM documents))"
D_COUNTS = f"{D_TOKENS}, counts AS (SELECT content_id, term, count(*) AS frequency, min(place) AS place FROM tok GROUP BY ALL)"
D_STOP = f"stop(term) AS (SELECT * FROM {values([(w,) for w in STOPWORDS])})"
D_TIMED = "timed AS (SELECT conv_id AS video_id, turn AS seg_no, turn * 15.0::DOUBLE AS inicio, turn * 15.0::DOUBLE + 15 AS fin, role AS hablante, text AS texto FROM conversations)"
D_SENTENCES = f"sent AS (SELECT content_id, sentence, place FROM (SELECT doc_id AS content_id, unnest({d_sentences('text')}) AS sentence, generate_subscripts({d_sentences('text')}, 1) - 1 AS place FROM documents))"
