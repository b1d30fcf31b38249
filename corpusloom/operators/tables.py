"""Idempotent changes of tables and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; doing it twice changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` with other keys, one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti"))


def set_state(old: DataFrame, changes: DataFrame, today: Column) -> DataFrame:
    """``old (content_id, estado, fecha)`` with the states of ``changes (content_id, estado)``; ``completado`` sets the date."""
    c = changes.select("content_id", F.col("estado").alias("nuevo"))
    return old.join(c, "content_id", "left").select("content_id", F.coalesce("nuevo", "estado").alias("estado"), F.when(F.col("nuevo") == "completado", today).otherwise(F.col("fecha")).alias("fecha"))


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def last_state(steps: DataFrame) -> DataFrame:
    """``id, step, status``: of each step the status written last; ties by status."""
    return steps.groupBy("id", "step").agg(F.max_by("status", F.struct("at", "status")).alias("status"))


def orphans(chunks: DataFrame, analyses: DataFrame, segs: DataFrame) -> DataFrame:
    """Checks on references: chunks without an analysis, chunks without timed segments by name or by its first eleven characters."""
    none = chunks.join(analyses.select("content_id"), "content_id", "left_anti")
    timed = segs.select(F.col("video_id").alias("k")).distinct()
    untimed = chunks.join(timed, F.col("content_id") == F.col("k"), "left_anti").join(timed, F.substring("content_id", 1, 11) == F.col("k"), "left_anti")
    return none.agg(F.lit("chunks_sin_analisis").alias("regla"), F.count("*").alias("n")).unionByName(untimed.agg(F.lit("chunks_sin_tiempos").alias("regla"), F.count("*").alias("n")))


def name_variants(names: DataFrame) -> DataFrame:
    """Distinct names of an id in one text, for ids with more than one."""
    each = names.select("id", "name").distinct().groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("ns"))
    return each.where(F.size("ns") > 1).select("id", F.array_join("ns", ", ").alias("nombres"))


def invariants(docs: DataFrame, banned: list[str]) -> DataFrame:
    """One row a rule, with how many rows break it."""
    c = lambda x: F.count_if(x)
    found = docs.agg((F.count("*") - F.count_distinct("content_id")).alias("ids_repetidos"), c(F.coalesce(F.trim("text"), F.lit("")) == "").alias("textos_vacios"), c(F.col("content_id").cast("string").startswith("./")).alias("prefijos"), c(F.exists(tx.terms(F.col("text")), lambda t: t.isin(*banned))).alias("terminos_prohibidos"))
    return found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("regla"), F.col(n).alias("n")) for n in found.columns))).alias("r")).select("r.regla", "r.n")


def claims(expected: DataFrame, measured: DataFrame) -> DataFrame:
    """``id, esperado, medido, ok``; a claim that nothing measures isn't ok."""
    return expected.join(measured, "id", "left").select("id", "esperado", "medido", F.coalesce(F.col("esperado") == F.col("medido"), F.lit(False)).alias("ok"))


def runs_compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs ``(content_id, nicho, terms)``: what differs, with contents that only one has."""
    x = a.select("content_id", F.col("nicho").alias("n1"), F.col("terms").alias("t1"))
    y = b.select("content_id", F.col("nicho").alias("n2"), F.col("terms").alias("t2"))
    return x.join(y, "content_id", "full_outer").select("content_id", (~F.col("n1").eqNullSafe(F.col("n2"))).alias("nicho_distinto"), (~F.col("t1").eqNullSafe(F.col("t2"))).alias("terminos_distintos"))


def entities(counts: DataFrame, kind: Column) -> DataFrame:
    """Entities of terms: id, type by rule, relevance min(f / 10, 1); a further mention of a known entity adds 1."""
    e = counts.withColumn("tipo", kind).withColumn("entity_id", tx.entity_id(F.col("term"), F.col("tipo")))
    first = F.struct("content_id", "frequency")
    return e.groupBy("entity_id", "term", "tipo").agg((F.min(first)["frequency"] + F.count("*") - 1).alias("frecuencia"), F.round(F.max(F.least(F.col("frequency") / 10, F.lit(1.0))), 6).alias("relevancia"))


def merged(entities: DataFrame, alias: DataFrame) -> DataFrame:
    """Entities under their canonical name ``(term, canonical)``: summed frequency, greatest relevance, first type by name."""
    return entities.join(alias, "term", "left").groupBy(F.coalesce("canonical", "term").alias("term")).agg(F.sum("frecuencia").alias("frecuencia"), F.max("relevancia").alias("relevancia"), F.min_by("tipo", "term").alias("tipo"))


def authority(wanted: DataFrame, alias: DataFrame, cache: DataFrame) -> DataFrame:
    """``term`` to ``mesh_id, origen``: the alias if there is one, else the cache's row, else missing."""
    a, c = alias.select("term", F.col("mesh_id").alias("m1")), cache.select("term", F.col("mesh_id").alias("m2"))
    return wanted.join(a, "term", "left").join(c, "term", "left").select("term", F.coalesce("m1", "m2").alias("mesh_id"), F.when(F.col("m1").isNotNull(), "alias").when(F.col("m2").isNotNull(), "cache").otherwise("falta").alias("origen"))


def learned(dictionary: DataFrame, titles: DataFrame) -> DataFrame:
    """Words of titles ``(concepto, title)``, of the first ten those above three characters, added to the concept's synonyms ``(concepto, term)``."""
    w = F.transform(F.slice(F.split(tx.squeeze(F.lower("title")), " "), 1, 10), lambda x: F.regexp_replace(x, r"^[.,;:!?()]+|[.,;:!?()]+$", ""))
    new = titles.select("concepto", F.explode(F.filter(w, lambda x: F.length(x) > 3)).alias("term")).distinct()
    return dictionary.unionByName(new.join(dictionary, ["concepto", "term"], "left_anti"))


def valid_concepts(concepts: Column, technical: Column, generic: Column) -> Column:
    """Reason of a concept set: sin_conceptos, solo_terminos_genericos, sin_terminos_tecnicos or valida; the dictionaries are arrays."""
    real = F.filter(concepts, lambda c: (F.length(c) >= 3) & ~F.array_contains(generic, c))
    return F.when(F.coalesce(F.size(concepts), F.lit(0)) <= 0, "sin_conceptos").when(F.size(real) == 0, "solo_terminos_genericos").when(~F.exists(real, lambda c: is_technical(c, technical)), "sin_terminos_tecnicos").otherwise("valida")


def is_technical(c: Column, technical: Column) -> Column:
    """In the dictionary, or hyphenated and above five characters, or all capitals of two to six letters."""
    return F.array_contains(technical, c) | (c.contains("-") & (F.length(c) > 5)) | c.rlike("^[A-ZÁÉÍÓÚÑ]{2,6}$")


def filtered_terms(items: Column, technical: Column, generic: Column, least: int = 2) -> Column:
    """Technical terms in order; if there are fewer than ``least``, the terms that aren't generic; if none is left, the input."""
    tech = F.filter(items, lambda c: is_technical(c, technical))
    rest = F.filter(items, lambda c: (F.length(c) >= 3) & ~F.array_contains(generic, c))
    return F.when(F.size(tech) >= least, tech).when(F.size(rest) > 0, rest).otherwise(items)


def merged_groundings(groundings: DataFrame, alias: DataFrame) -> DataFrame:
    """Groundings ``(term, ...)`` under their canonical names, those of all merged terms after each other: a row each, so that no list grows."""
    return groundings.join(alias, "term", "left").withColumn("term", F.coalesce("canonical", "term")).drop("canonical")


def merged_attributes(entities: DataFrame, alias: DataFrame, columns: list[str]) -> DataFrame:
    """``term`` and ``columns``: for each canonical name the first value, by term, that isn't null."""
    e = entities.join(alias, "term", "left").withColumn("name", F.coalesce("canonical", "term"))
    return e.groupBy("name").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("term"))).alias(c) for c in columns)).withColumnRenamed("name", "term")


def missing_columns(tables: dict[str, DataFrame], required: dict[str, list[str]], spark: SparkSession) -> DataFrame:
    """``regla, n`` with a row for each required table and column, 1 if it is missing; only schemas are read."""
    rows = []
    for t, columns in required.items():
        rows.append((f"tabla {t}", int(t not in tables)))
        rows += [(f"columna {t}.{c}", int(t not in tables or c not in tables[t].columns)) for c in columns]
    return spark.createDataFrame(rows, "regla string, n long")


def generic_on_top(counts: DataFrame, generic: list[str], n: int = 10) -> DataFrame:
    """How many of the ``n`` most frequent terms are generic."""
    top = counts.groupBy("term").agg(F.sum("frequency").alias("f")).orderBy(F.desc("f"), "term").limit(n)
    return top.agg(F.lit(f"genericos_en_top_{n}").alias("regla"), F.count_if(F.col("term").isin(*generic)).alias("n"))


def exploded_synonyms(rows: DataFrame, column: str, source: str) -> DataFrame:
    """``term, source`` of a comma list: trimmed, lower case, three characters or more, each once."""
    return rows.select(F.explode(F.split(column, ",")).alias("x")).select(F.lower(F.trim("x")).alias("term"), F.lit(source).alias("source")).where(F.length("term") >= 3).distinct()


def phrase_concepts(phrase: Column, compounds: list[str], connectors: list[str]) -> Column:
    """Concepts of a phrase: the compounds that it contains, in the order of their list, then what is left between connectors."""
    rest, found = F.lower(phrase), []
    for c in compounds:
        found.append(F.when(rest.contains(c), c))
        rest = F.replace(rest, F.lit(c), F.lit(""))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.regexp_replace(rest, r"\s+", " ")), " ", "  "), F.lit(" "))
    parts = F.split(F.regexp_replace(spaced, f" (?:{'|'.join(connectors)}) ", "\u0001"), "\u0001")
    return F.concat(F.array_compact(F.array(*found)), F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, " +", " "))), lambda p: p != ""))
