"""Topic domains, speakers and critical reading."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import fuzzy
from corpusloom.operators.terms import ranked


_ONE_WORD = re.compile(r"\w+").fullmatch


def _hits(text: Column, terms: Iterable[str]) -> Column:
    """The words of a lower-cased ``text`` that are ``terms``, in order: one pass, whatever the number of terms."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w.isin(*terms)) if terms else F.array().cast("array<string>")


def _found(text: Column, terms: Iterable[str]) -> Column:
    """``array<struct<term, n>>`` of the terms that stand in ``text`` as whole words. Terms that aren't one word are looked for each by itself."""
    one, more = [t for t in terms if _ONE_WORD(t)], [t for t in terms if not _ONE_WORD(t)]
    counted = tx.bind(_hits(text, one), lambda h: F.transform(F.array_distinct(h), lambda t: F.struct(t.alias("term"), F.size(F.filter(h, lambda x: x == t)).alias("n"))))
    if not more:
        return counted
    others = F.array(*(F.struct(F.lit(t).alias("term"), F.regexp_count(text, F.lit(tx.whole_words([t]))).alias("n")) for t in more))
    return F.concat(counted, F.filter(others, lambda s: s["n"] > 0))


def _total(found: Column, terms: list[str], value: Callable[[Column], Column]) -> Column:
    """Sum of ``value`` over those structs in ``found`` whose term is one of ``terms``."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, s: a + F.when(s["term"].isin(*terms), value(s)).otherwise(0)) if terms else F.lit(0).cast("long")


def domain_scores(docs: DataFrame, domains: dict[str, list[str]], phrases: dict[str, list[str]] | None = None) -> DataFrame:
    """``content_id, nicho, score`` of domains with a score: for each term the whole-word matches, at most five, and five for each phrase.

    Terms are matched in lower-cased text without accents and aren't normalised themselves. A phrase counts only if some
    domain has a score without it.
    """
    names = [*domains, *(d for d in phrases or {} if d not in domains)]
    found = docs.select("content_id", tx.normalize(F.lower("text")).alias("low")).withColumn("found", _found(F.col("low"), sorted({t for ts in domains.values() for t in ts})))
    capped = lambda s: F.least(F.lit(5), s["n"]).cast("long")
    scored = found.select("content_id", "low", *(_total(F.col("found"), domains.get(d, []), capped).alias(f"s_{i}") for i, d in enumerate(names)))
    some = F.greatest(F.lit(0), *(F.col(f"s_{i}") for i in range(len(names)))) > 0
    bonus = lambda d: sum((F.when(F.col("low").contains(p), 5).otherwise(0) for p in (phrases or {}).get(d, [])), F.lit(0))
    rows = F.array(*(F.struct(F.lit(d).alias("nicho"), F.when(some, F.col(f"s_{i}") + bonus(d)).otherwise(0).cast("long").alias("score")) for i, d in enumerate(names)))
    return scored.select("content_id", F.explode(F.filter(rows, lambda r: r["score"] > 0)).alias("r")).select("content_id", "r.nicho", "r.score")


def domain(docs: DataFrame, domains: dict[str, list[str]], priority: dict[str, int], phrases: dict[str, list[str]] | None = None) -> DataFrame:
    """``content_id, nicho``: the domain with the highest score, ties by priority, GENERAL without any."""
    rank = F.coalesce(F.create_map(*(x for d, p in priority.items() for x in (F.lit(d), F.lit(p))))[F.col("nicho")], F.lit(0)) if priority else F.lit(0)
    best = domain_scores(docs, domains, phrases).groupBy("content_id").agg(F.max_by("nicho", F.struct("score", rank, "nicho")).alias("nicho"))
    return docs.select("content_id").join(best, "content_id", "left").withColumn("nicho", F.coalesce("nicho", F.lit("GENERAL")))


def domain_of(text: Column, domains: dict[str, list[str]], priority: dict[str, int]) -> Column:
    """As ``domain``, of one text in its row."""
    found = tx.bind(tx.normalize(F.lower(text)), lambda low: _found(low, sorted({t for ts in domains.values() for t in ts})))
    capped = lambda s: F.least(F.lit(5), s["n"]).cast("long")
    scores = lambda f: F.array(*(F.struct(_total(f, ts, capped).alias("score"), F.lit(priority.get(d, 0)).alias("rank"), F.lit(d).alias("nicho")) for d, ts in domains.items()))
    return F.coalesce(F.array_max(F.filter(tx.bind(found, scores), lambda s: s["score"] > 0))["nicho"], F.lit("GENERAL"))


def confidences(docs: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """``content_id, nicho, place, confianza``: distinct terms found over ten, at most one; accents count."""
    found = docs.select("content_id", _found(F.lower("text"), sorted({t for ts in domains.values() for t in ts})).alias("found"))
    share = lambda ts: F.round(F.least(F.lit(1.0), _total(F.col("found"), ts, lambda s: F.lit(1)) / 10), 2)
    rows = F.array(*(F.struct(F.lit(d).alias("nicho"), F.lit(i).alias("place"), share(ts).alias("confianza")) for i, (d, ts) in enumerate(domains.items())))
    return found.select("content_id", F.explode(F.filter(rows, lambda r: r["confianza"] > 0)).alias("r")).select("content_id", "r.nicho", "r.place", "r.confianza")


def multi_label(docs: DataFrame, domains: dict[str, list[str]], hybrids: dict[tuple[str, str], str], least: float = 0.6) -> DataFrame:
    """``content_id, dominante, hibrido, etiquetas``; the hybrid is of the first two domains, in dictionary order, at ``least`` or more."""
    c = confidences(docs, domains)
    agg = c.groupBy("content_id").agg(
        F.max_by("nicho", F.struct("confianza", -F.col("place"))).alias("dominante"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "nicho", "confianza"))), lambda s: s).alias("all"),  # as many as domains
    )
    high = F.transform(F.filter("all", lambda s: s["confianza"] >= least), lambda s: s["nicho"])
    key = F.array_join(F.array_sort(F.slice(high, 1, 2)), "|")
    known = F.create_map(*(x for k, v in hybrids.items() for x in (F.lit("|".join(sorted(k))), F.lit(v)))) if hybrids else F.create_map()
    out = agg.select("content_id", "dominante", F.when(F.size(high) >= 2, known[key]).alias("hibrido"), F.array_join(F.transform("all", lambda s: s["nicho"]), ",").alias("etiquetas"))
    return docs.select("content_id").join(out, "content_id", "left").select("content_id", F.coalesce("dominante", F.lit("GENERAL")).alias("dominante"), "hibrido", F.coalesce("etiquetas", F.lit("GENERAL")).alias("etiquetas"))


def weighted_hierarchy(docs: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """``content_id, nicho, score``: 0.4 density, 0.3 position (matches in the first or last 15 % of the words count twice; from ten words on) and 0.3 syntax (3 at a sentence start, else 1, once a sentence and term), each as a share of 100."""
    terms = sorted({t for ts in domains.values() for t in ts})
    low = F.lower("text")
    n = lambda w: F.size(w)
    head = lambda w: F.array_join(F.slice(w, 1, F.greatest(F.lit(0), F.floor(n(w) * 0.15).cast("int"))), " ")
    tail = lambda w: F.array_join(F.slice(w, F.floor(n(w) * 0.85).cast("int") + 1, n(w)), " ")
    first = lambda s, t: F.when(s.startswith(t) & ~F.substring(s, F.length(t) + 1, F.lit(1)).rlike(tx.WORD), 3).otherwise(1)
    marked = lambda s: F.transform(_found(s, terms), lambda f: F.struct(f["term"].alias("term"), first(s, f["term"]).alias("n")))
    sents = F.transform(F.split(low, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    base = docs.select("content_id", low.alias("low"), tx.bind(F.split(tx.squeeze(low), " "), lambda w: F.struct(n(w).alias("n"), head(w).alias("head"), tail(w).alias("tail"))).alias("w"), F.flatten(F.transform(sents, marked)).alias("syntax"))
    base = base.select("content_id", "w.n", _found(F.col("low"), terms).alias("all"), F.concat(_found(F.col("w.head"), terms), _found(F.col("w.tail"), terms)).alias("ends"), "syntax")
    rows = []
    for d, ts in domains.items():
        density, ends, syntax = (_total(F.col(c), ts, lambda s: s["n"].cast("long")) for c in ("all", "ends", "syntax"))
        rows.append(F.struct(F.lit(d).alias("nicho"), density.cast("double").alias("density"), F.when(F.col("n") >= 10, density + ends).otherwise(0).cast("double").alias("position"), syntax.cast("double").alias("syntax")))
    parts = ["density", "position", "syntax"]
    sums = tx.bind(F.array(*rows), lambda r: F.struct(r.alias("r"), *(F.aggregate(r, F.lit(0.0), lambda a, x: a + x[c]).alias(c) for c in parts)))
    each = base.select("content_id", sums.alias("s")).select("content_id", F.struct(*(F.col(f"s.{c}").alias(c) for c in parts)).alias("s"), F.explode("s.r").alias("r"))
    share = lambda c: F.round(F.coalesce(100 * F.col(f"r.{c}") / F.nullif(F.col(f"s.{c}"), F.lit(0.0)), F.lit(0.0)), 2)
    return each.select("content_id", "r.nicho", F.round(0.4 * share("density") + 0.3 * share("position") + 0.3 * share("syntax"), 2).alias("score"))


def final_domain(scores: DataFrame, margin: float = 5.0) -> DataFrame:
    """The best-scored domain, or GENERAL if the second is within ``margin``."""
    top = ranked(scores.where("score > 0"), ["content_id"], [F.desc("score"), F.asc("nicho")], 2)
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    two = top.groupBy("content_id").agg(pick(1, "nicho").alias("first"), pick(1, "score").alias("s1"), pick(2, "score").alias("s2"))
    return two.select("content_id", F.when(F.col("s2").isNotNull() & (F.col("s1") - F.col("s2") < margin), "GENERAL").otherwise(F.col("first")).alias("nicho"))


def hybrid_label(scores: DataFrame, catalogue: DataFrame, least: float) -> DataFrame:
    """Two best domains at ``least`` or more to the catalogue's name ``(a, b, nombre)`` with a before b, else their names joined; ``nuevo`` says it isn't in the catalogue."""
    top = ranked(scores.where(F.col("score") >= least), ["content_id"], [F.desc("score"), F.asc("nicho")], 2)
    pairs = top.groupBy("content_id").agg(F.array_sort(F.collect_list("nicho")).alias("p")).where(F.size("p") == 2).select("content_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    out = pairs.join(F.broadcast(catalogue), ["a", "b"], "left")  # a catalogue written by hand
    return out.select("content_id", F.coalesce("nombre", F.concat_ws("-", "a", "b")).alias("hibrido"), F.col("nombre").isNull().alias("nuevo"))


def coherent(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """``content_id, nicho, herramienta`` with the tool set to null where ``allowed (nicho, herramienta)`` doesn't list it."""
    ok = allowed.select("nicho", "herramienta", F.lit(True).alias("ok"))
    return rows.join(ok, ["nicho", "herramienta"], "left").select("content_id", "nicho", F.when(F.col("ok"), F.col("herramienta")).alias("herramienta"), F.coalesce("ok", F.lit(False)).alias("coherente"))


def fuzzy_votes(docs: DataFrame, dictionary: DataFrame, least: float = 0.6) -> DataFrame:
    """``content_id, nicho, votos`` of ``content_id, text`` and ``term, nicho, place``: each word and pair votes for its most similar term (Ratcliff-Obershelp ratio of ``least`` or more), the domain with most votes wins, GENERAL without any.

    Ties go to the first term and to the domain that was voted for first. Words and pairs meet the dictionary where the
    text is read, by bounds first and each once for many texts (``fuzzy``); nothing but votes is shuffled. The dictionary is written by hand and goes to
    every task.
    """
    known = sorted({(r["at"], r["term"], r["nicho"]) for r in dictionary.select(F.lower("term").alias("term"), "nicho", F.col("place").alias("at")).collect()})
    words = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != "")
    votes = fuzzy.domain_votes(docs.where("text is not null").select("content_id", words.alias("words")), [t for _, t, _ in known], [d for _, _, d in known], least)
    won = votes.groupBy("content_id").agg(F.max(F.struct("votos", -F.col("place"), "nicho")).alias("w")).select("content_id", "w.nicho", "w.votos")
    return docs.select("content_id").join(won, "content_id", "left").select("content_id", F.coalesce("nicho", F.lit("GENERAL")).alias("nicho"), F.coalesce("votos", F.lit(0)).cast("long").alias("votos"))


LEGAL = ["juez", "fiscal", "abogado", "testigo", "tribunal", "judge", "attorney", "court", "lawyer"]


def speaker_mode(t: Column, legal: list[str] = LEGAL, word_boundary: bool = False) -> Column:
    """legal if a legal word occurs, ateneo above five speaker marks, tutorial with at most one mark and more than 20 lines, else auto."""
    low = F.lower(t)
    hit = F.lit(False)
    for w in legal:
        hit = hit | (low.rlike(tx.whole_words([w])) if word_boundary else low.contains(w))
    marks = F.regexp_count(t, F.lit(r"(?md)^[A-ZÁÉÍÓÚÑ][\p{L} ]{1,40}:"))
    lines = F.size(F.split(t, "\n"))
    return F.when(hit, "legal").when(marks > 5, "ateneo").when((marks <= 1) & (lines > 20), "tutorial").otherwise("auto")


#: Rate of the lines a speaker needs, and how many are kept, by mode.
MODES = [("tutorial", 0.05, 1), ("ateneo", 0.02, 10), ("legal", 0.01, 20), ("auto", 0.03, 10)]


#: A profession and one or two names, in any case.
PROFESSION = r"(?iU)(?:Dr\.?|Dra\.?|Abogad[oa]|Juez|Jueza|Fiscal|Defensor[ao]?)\s+[A-ZÁÉÍÓÚ][a-záéíóú]+(?:\s+[A-ZÁÉÍÓÚ][a-záéíóú]+)?"
WITNESS = r"(?iU)\btestigo\b"


def speakers(docs: DataFrame) -> DataFrame:
    """``content_id, modo, text`` to ``content_id, nombre, veces, principal`` above the mode's threshold, at most its cap.

    Speakers are the names of lines ``Name: words`` (lines end with \\n), professions with a name, and in legal mode ``testigo``; a legal text
    without any has ``persona1`` to ``persona3``, as many as lines.
    """
    modes = docs.sparkSession.createDataFrame(MODES, "modo string, rate double, cap int")
    n = F.size(F.split("text", "\n"))
    said = F.regexp_extract_all("text", F.lit(r"(?md)^([\p{L}][\p{L} ]{1,40}):"), 1)
    titled = F.regexp_extract_all("text", F.lit(PROFESSION), 0)
    legal = F.col("modo") == "legal"
    witness = F.when(legal, F.transform(F.regexp_extract_all("text", F.lit(WITNESS), 0), lambda _: F.lit("testigo"))).otherwise(F.array().cast("array<string>"))
    persons = F.slice(F.array(*(F.lit(f"persona{i}") for i in (1, 2, 3))), 1, F.least(F.lit(3), F.col("n")))
    found = docs.select("content_id", "modo", n.alias("n"), F.concat(said, titled, witness).alias("all"))
    names = found.select("content_id", "modo", "n", F.explode(F.when(legal & (F.size("all") == 0), persons).otherwise(F.col("all"))).alias("nombre"))
    counted = names.groupBy("content_id", "modo", "n", "nombre").agg(F.count("*").alias("veces")).join(F.broadcast(modes), "modo")  # four rows
    threshold = F.floor(F.col("n") * F.col("rate"))
    kept = counted.where(F.col("veces") >= F.when(F.col("modo") == "tutorial", 2 * threshold).otherwise(threshold))
    top = ranked(kept, ["content_id"], [F.desc("veces"), F.asc("nombre")])
    return top.where(F.col("rank") <= F.col("cap")).select("content_id", "nombre", "veces", (F.col("rank") == 1).alias("principal"))


def real_speaker(name: Column, context: Column) -> Column:
    """The name, or ``DESCONOCIDO`` if the context mentions it without speaking as ``name:`` or ``name-``."""
    speaks = F.lower(context).contains(F.concat(F.lower(name), F.lit(":"))) | F.lower(context).contains(F.concat(F.lower(name), F.lit("-")))
    return F.when(speaks | ~F.lower(context).contains(F.lower(name)), name).otherwise("DESCONOCIDO")


EVIDENCE = ["estudio", "datos", "evidencia", "study", "data", "evidence", "results"]
SPECULATION = ["quizas", "tal vez", "podria", "maybe", "perhaps", "might", "could"]


def critical_reading(sents: DataFrame, key_terms: DataFrame, evidence: list[str] = EVIDENCE, speculation: list[str] = SPECULATION) -> DataFrame:
    """For each key term the first sentence above 50 characters that has it: SOSTENIDO with evidence, ESPECULATIVO with speculation only, else PARCIAL. One row a premise."""
    low = F.lower("sentence")
    has = lambda ws: sum((low.contains(w).cast("int") for w in ws), F.lit(0)) > 0
    terms = key_terms.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("terms"))  # a few key terms
    met = sents.where(F.length("sentence") > 50).join(terms, "content_id").withColumn("t", F.explode(F.filter("terms", lambda t: F.lower("sentence").contains(t["term"]))))
    first = met.groupBy("content_id", "t.term", "t.rank").agg(F.min_by("sentence", "place").alias("sentence"), F.min("place").alias("place"))
    one = ranked(first, ["content_id", "sentence"], [F.asc("rank")], 1, "k").drop("k")
    return one.select("content_id", "term", "rank", "place", F.col("sentence").alias("premisa"), F.when(has(evidence), "SOSTENIDO").when(has(speculation), "ESPECULATIVO").otherwise("PARCIAL").alias("estado"))


def roles(scores: DataFrame, tools: list[str], contexts: list[str]) -> DataFrame:
    """``content_id, principal, herramienta, contexto, secundario`` of ``(content_id, nicho, score)``: the best domain, and of the others the last of each kind, null if it has no score."""
    kind = F.when(F.col("nicho").isin(*tools), "herramienta").when(F.col("nicho").isin(*contexts), "contexto").otherwise("secundario")
    w = Window.partitionBy("content_id").orderBy(F.desc("score"), F.asc("nicho"))
    placed = scores.withColumn("place", F.row_number().over(w)).withColumn("kind", kind)
    last = lambda k: F.max_by(F.when(F.col("score") > 0, F.col("nicho")), F.when((F.col("place") > 1) & (F.col("kind") == k), F.col("place"))).alias(k)
    return placed.groupBy("content_id").agg(F.min_by("nicho", "place").alias("principal"), *map(last, ("herramienta", "contexto", "secundario")))


def decision(scores: DataFrame, names: DataFrame, tools: list[str], contexts: list[str], margin: float = 5.0) -> DataFrame:
    """``roles`` with the final main domain (GENERAL within ``margin`` of the second), ``es_habla`` for names ``(content_id, name)`` of transcripts, and ``nichos``, the domains whose stop words apply."""
    best = final_domain(scores, margin).withColumnRenamed("nicho", "final")
    r = roles(scores, tools, contexts).join(best, "content_id", "left").join(names.select("content_id", F.lower("name").rlike("transcript|subtitle|caption").alias("habla")), "content_id", "left")
    main = F.coalesce("final", "principal")
    speech = F.coalesce("habla", F.lit(False))
    all_ = F.array_distinct(F.array_compact(F.array(main, "herramienta", "contexto", "secundario", F.when(speech, "HABLA"))))
    return r.select("content_id", main.alias("principal"), "herramienta", "contexto", "secundario", speech.alias("es_habla"), all_.alias("nichos"))


def detected_tool(text: Column, domain: Column, allowed: dict[str, list[str]], markers: dict[str, list[str]]) -> Column:
    """Of the tools that ``domain`` allows, the one most of whose markers the lower-cased text contains; the first of equals, null without any."""
    low = F.lower(text)
    hits = lambda t: sum((low.contains(m).cast("int") for m in markers[t]), F.lit(0))
    may = lambda t: domain.isin(*[d for d, ts in allowed.items() if t in ts])
    best = F.array_max(F.array(*(F.struct(F.when(may(t), hits(t)).otherwise(0).alias("n"), F.lit(-i).alias("place"), F.lit(t).alias("tool")) for i, t in enumerate(markers))))
    return F.when(best["n"] > 0, best["tool"])
