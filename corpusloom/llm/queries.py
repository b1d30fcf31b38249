"""The registered queries of this subpackage: thin calls with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, edit_counts, filter_audit, html_text, near_dups, ogg, outliers, packing, pii, shards, toxicity, vector_codes, vector_dups
from corpusloom.llm.common import table


def pseudonym_key(spark: SparkSession) -> str:
    """The key in the Spark setting. The registered queries run on public tables: without it they take this one, which is no secret."""
    return spark.conf.get(pii.SETTING, None) or "demonstration"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return scored.select("doc_id", F.coalesce(toxicity.fold() == 1, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity_predicted").alias("predicted"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.counts(edit_counts.with_edits(table(spark, sf_dir, "documents")))


def op4_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents")).select("doc_id", "shard", "copy", "row_bytes", "shard_bytes", "oversized")


def op5_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.links(table(spark, sf_dir, "embeddings"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pseudonym_key(spark), found_col="kinds").select("doc_id", "text", F.size("kinds").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.inspect(ogg.media(table(spark, sf_dir, "documents")))


def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_html_main_text, op3_edit_token_counts, op4_hash_shards, op5_vector_duplicates, op6_bpe_round_trip, op7_length_buckets, op8_pseudonyms, op9_near_duplicates, op10_ogg_media, op11_robust_outliers, op12_vector_codes, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op12_vector_codes": vector_codes.SQL, "op13_filter_audit": filter_audit.SQL}
