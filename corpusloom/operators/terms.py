"""Term counts of documents and what is asked of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def tokens(docs: DataFrame) -> DataFrame:
    """``content_id, place, term`` of ``content_id, text``."""
    return docs.select("content_id", F.posexplode(tx.terms(F.col("text"))).alias("place", "term"))


def term_counts(docs: DataFrame) -> DataFrame:
    """``content_id, term, frequency``; counts are summed map-side before the shuffle."""
    return tokens(docs).groupBy("content_id", "term").agg(F.count("*").alias("frequency"))


def without(df: DataFrame, stopwords: DataFrame, on: str = "term") -> DataFrame:
    """Rows whose term isn't a stop word; a null stop word removes nothing."""
    return df.join(stopwords.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


#: Up to so many stop words go to every task.
HELD_STOPWORDS = 10_000


def row_counts(docs: DataFrame, tokens: Column, n: int | None = None) -> DataFrame:
    """``content_id, term, frequency, place`` of each document's tokens, with the first place of each, counted where the text is read.

    With ``n`` only the ``n`` most frequent, ties by place, with ``rank``. Documents whose ids repeat are put together by a shuffle."""
    rows = docs.select("content_id", tokens.alias("ts"))
    if not docs.groupBy("content_id").count().where("count > 1").isEmpty():
        counted = rows.select("content_id", F.posexplode("ts").alias("place", "term")).groupBy("content_id", "term").agg(F.count("*").alias("frequency"), F.min("place").alias("place"))
        return counted if n is None else ranked(counted, ["content_id"], [F.desc("frequency"), F.asc("place")], n)
    names = ["content_id", "term", "frequency", "place"] + ([] if n is None else ["rank"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column(1)).fill_null(0).to_numpy().astype(np.int64)
            said = b.column(1).flatten().dictionary_encode()
            v = max(1, len(said.dictionary))
            key, at, times = np.unique(np.repeat(np.arange(len(size)), size) * v + said.indices.to_numpy(), return_index=True, return_counts=True)
            doc, code = np.divmod(key, v)
            at = at - (np.cumsum(size) - size)[doc]
            rank = None
            if n is not None:
                order = np.lexsort((at, -times, doc))
                own = np.bincount(doc, minlength=len(size))
                rank = np.arange(len(order)) - np.repeat(np.cumsum(own) - own, own) + 1
                order, rank = order[rank <= n], rank[rank <= n]
                doc, code, times, at = doc[order], code[order], times[order], at[order]
            out = [b.column(0).take(pa.array(doc)), said.dictionary.take(pa.array(code)), pa.array(times, pa.int64()), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(out + ([] if n is None else [pa.array(rank, pa.int64())]), names)

    kind = rows.schema["content_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"content_id {kind}, term string, frequency long, place int" + ("" if n is None else ", rank long"))


def key_terms(docs: DataFrame, stopwords: DataFrame | None = None, n: int = 20) -> DataFrame:
    """Each document's ``n`` most frequent terms: ``content_id, term, frequency, rank``; ties by first place."""
    said = tx.terms(F.col("text"))
    if stopwords is not None:
        stop = [r["term"] for r in stopwords.select("term").where("term is not null").distinct().limit(HELD_STOPWORDS + 1).collect()]
        if len(stop) > HELD_STOPWORDS:
            counted = without(tokens(docs), stopwords).groupBy("content_id", "term").agg(F.count("*").alias("frequency"), F.min("place").alias("place"))
            return ranked(counted, ["content_id"], [F.desc("frequency"), F.asc("place")], n).drop("place")
        said = F.filter(said, lambda t: ~t.isin(stop)) if stop else said
    return row_counts(docs, said, n).drop("place")


def ranked(df: DataFrame, by: list[str], order: list[Column], n: int | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within ``by``; only the first ``n`` if given (Spark then cuts each group before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out if n is None else out.where(F.col(name) <= n)


def top_terms(counts: DataFrame, n: int = 20) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("frequency").alias("total"), F.count_distinct("content_id").alias("documents")).orderBy(F.desc("total"), "term").limit(n)


def document_summary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("content_id").agg(F.count("*").alias("terms"), F.sum("frequency").alias("total"), F.round(F.avg("frequency"), 6).alias("mean"))


def tiers(counts: DataFrame) -> DataFrame:
    """Tier of a document by its mentions: 1 from 1000, 2 from 200, else 3."""
    total = counts.groupBy("content_id").agg(F.sum("frequency").alias("mentions"))
    return total.withColumn("tier", F.when(F.col("mentions") >= 1000, 1).when(F.col("mentions") >= 200, 2).otherwise(3).cast("long"))


def before_after(counts: DataFrame, stopwords: DataFrame, n: int = 20) -> DataFrame:
    """Rank by rank, the top terms with and without stop words."""
    rank = lambda df, a, b: ranked(top_terms(df, n).select("term", "total").withColumn("one", F.lit(1)), ["one"], [F.desc("total"), F.asc("term")]).select("rank", F.col("term").alias(a), F.col("total").alias(b))
    return rank(counts, "term_before", "total_before").join(rank(without(counts, stopwords), "term_after", "total_after"), "rank", "full_outer")


def idf(counts: DataFrame, documents: int | None = None) -> DataFrame:
    """``term, df, idf`` with idf = ln((1 + N) / (1 + df)) + 1."""
    n = F.lit(documents) if documents is not None else None
    df = counts.groupBy("term").agg(F.count_distinct("content_id").alias("df"))
    if n is None:
        total = counts.agg(F.count_distinct("content_id").alias("n"))
        return df.crossJoin(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    return df.select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def tf_idf(counts: DataFrame) -> DataFrame:
    """``content_id, term, weight``: (1 + ln f) ln(N / (1 + df)), each document's vector of length 1; a zero vector stays zero."""
    df = counts.groupBy("term").agg(F.count_distinct("content_id").alias("df"))
    n = counts.agg(F.count_distinct("content_id").alias("n"))
    w = counts.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("frequency")) * F.log(F.col("n") / (1 + F.col("df"))))  # n is one row
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("content_id")))
    return w.select("content_id", "term", (F.col("w") / F.when(norm == 0, 1.0).otherwise(norm)).alias("weight"))


def contamination(counts: DataFrame, domains: DataFrame, technical: DataFrame, least: int = 3) -> DataFrame:
    """Terms of a domain that ``least`` or more of its documents use and that aren't technical."""
    rows = counts.join(domains, "content_id").join(technical.select("term").where("term is not null").distinct(), "term", "left_anti")
    return rows.groupBy("nicho", "term").agg(F.count_distinct("content_id").alias("documents"), F.sum("frequency").alias("total")).where(F.col("documents") >= least)


def coverage(counts: DataFrame, technical: DataFrame) -> DataFrame:
    """Distinct technical terms among all distinct terms, in per cent with one decimal."""
    marked = counts.select("term").distinct().join(technical.select("term").distinct().withColumn("known", F.lit(1)), "term", "left")
    out = marked.agg(F.count("known").alias("technical"), F.count("*").alias("total"))
    return out.withColumn("percent", F.round(100.0 * F.col("technical") / F.col("total"), 1))


def validated_counts(counts: DataFrame, generic: DataFrame, technical: DataFrame | None, lemmas: DataFrame, least: int = 1) -> DataFrame:
    """``content_id, term, frequency`` of technical terms (all, if no table is given) that aren't generic (``(term)`` each, or shorter than three), summed by lemma ``(term, lemma)`` and used by ``least`` documents; contents without any are gone."""
    kept = without(counts.where(F.length("term") >= 3), generic)
    if technical is not None:
        kept = kept.join(technical.select("term").distinct(), "term", "left_semi")
    summed = kept.join(lemmas, "term", "left").groupBy("content_id", F.coalesce("lemma", "term").alias("term")).agg(F.sum("frequency").alias("frequency"))
    return summed if least < 2 else summed.join(summed.groupBy("term").agg(F.count("*").alias("_df")).where(F.col("_df") >= least).select("term"), "term", "left_semi")
