"""Queries on pages of two columns, on segments with terms and on phrases: C11, E3, D6, G7."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import pages as pg
from corpusloom.operators import terms as tm
from corpusloom.plans.base import D_TIMED, d_terms, docs, timed
from corpusloom.plans.registry import query

_TWO = "two AS (SELECT doc_id AS content_id, list_transform(range(0, (greatest(length(text), 1) - 1) // 76 + 1), lambda i: rpad(trim(replace(substr(text, (i * 76 + 1)::BIGINT, 36), chr(10), ' ')), 44, ' ') || trim(replace(substr(text, (i * 76 + 37)::BIGINT, 40), chr(10), ' '))) AS ls FROM documents)"


def _two_columns(spark, sf_dir):
    """Documents laid out in two columns of 36 and 40 characters."""
    d = docs(spark, sf_dir)
    part = lambda s, i, n: F.trim(F.replace(F.substring(s, i, n), F.lit("\n"), F.lit(" ")))
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit("(?s).{1,76}"), 0))
    return d.select("content_id", F.array_join(F.transform(pieces, lambda s: F.concat(F.rpad(part(s, 1, 36), 44, " "), part(s, 37, 40))), "\n").alias("text"))


@query(
    f"WITH {_TWO}, l AS (SELECT content_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM two), p AS (SELECT content_id, unnest(range(30, 81)) AS p, line FROM l), v AS (SELECT content_id, p, count(*) AS k FROM p WHERE substr(line, p + 1, 3) = '   ' AND substr(line, p, 1) <> ' ' GROUP BY ALL), "
    "w AS (SELECT content_id, p AS width FROM v QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY k DESC, p) = 1), s AS (SELECT l.content_id, n, rtrim(substr(line, 1, coalesce(width, 48))) AS le, trim(substr(line, coalesce(width, 48) + 1)) AS ri, coalesce(width, 48)::BIGINT AS width FROM l LEFT JOIN w USING (content_id)) "
    "SELECT content_id, any_value(width) AS width, count(*) FILTER (le <> '') AS lineas_izq, count(*) FILTER (ri <> '') AS lineas_der, count(*) FILTER (le = '' AND ri = '') AS vacias, sha256(coalesce(string_agg(le, chr(10) ORDER BY n) FILTER (le <> ''), '')) AS h, sha256(coalesce(string_agg(ri, chr(10) ORDER BY n) FILTER (ri <> ''), '')) AS hd, count(*) FILTER (cut) AS cortadas, "
    "CASE WHEN lineas_izq < 10 THEN 'pocas_izquierda' WHEN lineas_der < 10 THEN 'pocas_derecha' WHEN lineas_izq / greatest(lineas_der, 1) < 0.3 OR lineas_izq / greatest(lineas_der, 1) > 3 THEN 'desbalanceado' WHEN count(*) FILTER (cut) / count(*) > 0.4 THEN 'cortadas' ELSE 'OK' END AS motivo "
    "FROM (SELECT *, le <> '' AND ri <> '' AND NOT regexp_matches(le, '[.,;:)\\]?!-]$') AND regexp_matches(ri, '^\\p{Ll}') AS cut FROM s) GROUP BY content_id"
)
def c11_two_columns(spark, sf_dir):
    return pg.split_columns(_two_columns(spark, sf_dir)).select("content_id", F.col("width").cast("long").alias("width"), "lineas_izq", "lineas_der", "vacias", F.sha2("izquierda", 256).alias("h"), F.sha2("derecha", 256).alias("hd"), "cortadas", "motivo")


@query(f"WITH {D_TIMED}, c AS (SELECT video_id, term, count(*) AS frequency FROM (SELECT video_id, unnest({d_terms('texto')}) AS term FROM timed) GROUP BY ALL) SELECT t.video_id, seg_no, term, frequency FROM timed t LEFT JOIN c ON c.video_id = t.video_id AND contains(lower(texto), term) WHERE term IS NOT NULL OR t.video_id NOT IN (SELECT video_id FROM c)")
def e3_segments_with_terms(spark, sf_dir):
    t = timed(spark, sf_dir)
    c = tm.term_counts(t.select(F.col("video_id").alias("content_id"), F.col("texto").alias("text"))).withColumnRenamed("content_id", "video_id")
    return pg.segments_with_terms(t, c).select("video_id", "seg_no", "term", "frequency")
