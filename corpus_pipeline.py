"""From raw documents to training batches: toxic documents go, near duplicates go, personal data get pseudonyms, the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. ``docs`` may have more columns than
``documents``; they pass through all stages but the last, which returns one row for each document with its batch.
Null and empty texts aren't toxic and aren't near duplicates; they stay, as they are, in the shortest bucket. Of repeated
rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import near_dups, packing, pii, toxicity
from corpusloom.llm.common import stash, table
from corpusloom.llm.queries import pseudonym_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(f"{scored.columns[-1]} = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pseudonym_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, known_words=100_000)  # workers hold what the stages before left


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pseudonyms", pseudonymise), ("packing", pack)]

#: Compression lengths, dart signatures and the dynamic programme have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
