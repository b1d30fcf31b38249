"""Readers and writers of corpora: text folders, analysis records, term tables, dictionaries, subtitles, file lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "documento string, nicho string, total_segmentos int, total_dialogos int, sentimiento_global struct<polaridad: double, subjetividad: double>, "
    "terminos_clave array<array<string>>, resumen_llm struct<texto: string, modelo: string>"
)
SEGMENT = "video_id string, segment_id long, start double, end double, duration double, text string"


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """``content_id, text``: one row a file, its name without extension is the id."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("content_id"), F.col("value").alias("text"))


def analysis_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path, multiLine=True)


def analysis_table(records: DataFrame) -> DataFrame:
    """Flat table of records; a missing domain is GENERAL, missing numbers are 0."""
    name = F.regexp_replace(F.regexp_replace("documento", r"^\./", ""), r"_analisis_completo\.json$", "")
    return records.select(
        name.alias("filename"), F.coalesce("nicho", F.lit("GENERAL")).alias("nicho"), F.coalesce("total_segmentos", F.lit(0)).alias("total_segmentos"), F.coalesce("total_dialogos", F.lit(0)).alias("total_dialogos"),
        F.coalesce("sentimiento_global.polaridad", F.lit(0.0)).alias("sentimiento_polaridad"), F.coalesce("sentimiento_global.subjetividad", F.lit(0.0)).alias("sentimiento_subjetividad"),
        F.col("resumen_llm.texto").alias("resumen_llm"), F.col("resumen_llm.modelo").alias("resumen_modelo"),
    )


def exploded_terms(records: DataFrame, stopwords: DataFrame) -> DataFrame:
    """``documento, term, frequency`` of pairs ``[term, count]``: lower case, three letters or more, no stop words, the greatest count of a term."""
    p = records.select("documento", F.explode("terminos_clave").alias("p")).select("documento", F.lower(F.trim(F.col("p")[0])).alias("term"), F.col("p")[1].try_cast("long").alias("frequency"))
    p = p.where(F.length("term") >= 3).join(stopwords.select("term").where("term is not null"), "term", "left_anti")
    return p.groupBy("documento", "term").agg(F.max("frequency").alias("frequency"))


def term_csv(spark: SparkSession, path: str) -> DataFrame:
    """``term, frequency``: columns by their names in either language, else the first two."""
    df = spark.read.csv(path, header=True)
    low = {c.lower().strip(): c for c in df.columns}
    term = next((low[c] for c in ("term", "keyword", "termino", "palabra") if c in low), df.columns[0])
    freq = next((low[c] for c in ("frequency", "frecuencia") if c in low), df.columns[1])
    return df.select(F.col(f"`{term}`").alias("term"), F.col(f"`{freq}`").try_cast("long").alias("frequency"))


def dictionary_terms(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``term, source, grupo`` of a JSON dictionary of any of these shapes, nested to any depth: lists of words, or objects with words as keys and numbers as values.

    A dictionary is one file written by hand, so it is read whole.
    """
    import json

    def walk(x, group):
        if isinstance(x, list):
            for y in x:
                if isinstance(y, str):
                    yield y, group
        elif isinstance(x, dict):
            for k, y in x.items():
                if isinstance(y, int | float) or (isinstance(y, dict) and y and all(isinstance(z, int | float) for z in y.values())):
                    yield k, group
                else:
                    yield from walk(y, k)

    text = spark.read.text(path, wholetext=True).first()[0]
    rows = [(t, source, g) for t, g in walk(json.loads(text), "")]
    return spark.createDataFrame(rows, "term string, source string, grupo string").select(F.lower(F.trim("term")).alias("term"), "source", "grupo").where("term <> ''").distinct()


def segment_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of timed segments; blank and broken lines are left out."""
    return spark.read.schema(SEGMENT).option("mode", "DROPMALFORMED").json(path).where("video_id is not null")


_CUE = re.compile(r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})")


def parse_cues(text: str | None) -> list[tuple[float, float, str]]:
    """Cues of WebVTT or SRT: times, and text lines up to a blank one, joined by a space, without tags; empty ones are left out."""
    out, now, lines = [], None, []
    for line in [*(text or "").splitlines(), ""]:
        m = _CUE.search(line)
        if m or not line.strip():
            said = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", " ".join(lines))).strip()
            if now and said:
                out.append((*now, said))
            at = lambda h, mi, s, ms: int(h or 0) * 3600 + int(mi) * 60 + int(s) + int(ms.ljust(3, "0")) / 1000
            now, lines = ((at(*m.groups()[:4]), at(*m.groups()[4:])), []) if m else (None, [])
        elif now:
            lines.append(line.strip())
    return out


def subtitles(files: DataFrame) -> DataFrame:
    """``video_id, inicio, fin, texto`` of ``content_id, text`` (a folder of subtitle files); ``parse_cues`` runs inside tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *c) for i, t in b.itertuples(index=False) for c in parse_cues(t)]
            yield pd.DataFrame(rows, columns=["video_id", "inicio", "fin", "texto"])

    return files.select("content_id", "text").mapInPandas(run, "video_id string, inicio double, fin double, texto string")


def content_files(spark: SparkSession, path: str) -> DataFrame:
    """``content_id, source_type, source_url, status`` of files whose names hold a video id; contents aren't read."""
    from corpusloom.functions.text import video_id

    name = F.element_at(F.split("path", "/"), -1)
    ids = spark.read.format("binaryFile").load(path).select(video_id(F.regexp_replace(name, r"\.[^.]*$", "")).alias("v")).where("v is not null").distinct()
    return ids.select(F.concat(F.lit("youtube:"), "v").alias("content_id"), F.lit("youtube").alias("source_type"), F.concat(F.lit("https://www.youtube.com/watch?v="), "v").alias("source_url"), F.lit("completed").alias("status"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """Nested records as JSON lines."""
    df.write.mode("overwrite").json(path)
