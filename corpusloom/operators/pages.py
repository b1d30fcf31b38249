"""Two-column pages: where the gutter is, both columns, and whether the split can be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, HIGH, DEFAULT = 30, 80, 48


def lines(docs: DataFrame) -> DataFrame:
    """``content_id, n, line`` of ``content_id, text``."""
    return docs.select("content_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def gutters(ls: DataFrame, first: int = 500) -> DataFrame:
    """``content_id, width``: the most frequent start, from 30 to 80, of a run of three or more blanks in the first lines; ties to the least, 48 without any."""
    starts = F.expr(f"filter(sequence({LOW}, {HIGH}), p -> substr(line, p + 1, 3) = '   ' and (p = 0 or substr(line, p, 1) <> ' '))")
    votes = ls.where(F.col("n") < first).select("content_id", F.explode(starts).alias("p")).groupBy("content_id", "p").agg(F.count("*").alias("k"))
    best = votes.groupBy("content_id").agg(F.max_by("p", F.struct("k", -F.col("p"))).alias("width"))
    return ls.select("content_id").distinct().join(best, "content_id", "left").select("content_id", F.coalesce("width", F.lit(DEFAULT)).alias("width"))


def split_columns(docs: DataFrame) -> DataFrame:
    """``content_id, width, izquierda, derecha, lineas_izq, lineas_der, vacias, cortadas, motivo``; motivo is OK or what is wrong.

    A line is cut if its left part doesn't end in a sign and its right part begins with a small letter. A page needs ten
    lines a side, a ratio of sides from 0.3 to 3 and at most 40 % cut lines.
    """
    ls = lines(docs)
    both = ls.join(gutters(ls), "content_id").withColumn("l", F.rtrim(F.expr("substr(line, 1, width)"))).withColumn("r", F.trim(F.expr("substr(line, width + 1)")))
    full = (F.col("l") != "") & (F.col("r") != "")
    cut = full & ~F.col("l").rlike(r"[.,;:)\]?!-]$") & F.col("r").rlike(r"^\p{Ll}")
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("n", F.col(c).alias("x"))))), lambda s: s["x"]), "\n")
    g = both.groupBy("content_id").agg(
        F.first("width").alias("width"), side("l").alias("izquierda"), side("r").alias("derecha"), F.count_if(F.col("l") != "").alias("lineas_izq"), F.count_if(F.col("r") != "").alias("lineas_der"),
        F.count_if((F.col("l") == "") & (F.col("r") == "")).alias("vacias"), F.count_if(cut).alias("cortadas"), F.count("*").alias("total"),
    )
    ratio = F.col("lineas_izq") / F.greatest("lineas_der", F.lit(1))
    why = F.when(F.col("lineas_izq") < 10, "pocas_izquierda").when(F.col("lineas_der") < 10, "pocas_derecha").when((ratio < 0.3) | (ratio > 3), "desbalanceado").when(F.col("cortadas") / F.greatest("total", F.lit(1)) > 0.4, "cortadas").otherwise("OK")
    return g.withColumn("motivo", why).drop("total")


def segments_with_terms(segs: DataFrame, counts: DataFrame, only_said: bool = True) -> DataFrame:
    """Timed segments with their video's terms ``(video_id, term, frequency)``; by default only terms that the segment says, as all of them multiply."""
    met = segs.join(counts, "video_id", "left")
    return met.where(F.col("term").isNull() | F.expr("contains(lower(texto), term)")) if only_said else met
