"""Short texts from results: abstracts, debate questions, PICO records, summaries, reflections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abstract(domain: Column, tool: Column, context: Column, terms: Column) -> Column:
    """Core, tool and context paragraphs of what is known."""
    core = F.format_string("El contenido trata de %s: %s.", F.lower(domain), F.array_join(F.slice(terms, 1, 3), ", "))
    return F.concat_ws("\n\n", core, F.when(tool.isNotNull(), F.format_string("Usa %s como herramienta.", tool)), F.when(context.isNotNull(), F.format_string("Su contexto es %s.", context)))


def questions(terms: Column, quote: Column) -> Column:
    """Debate questions of two or three terms, else of the first quote, else none."""
    a, b, c = (F.get(terms, i) for i in range(3))
    two = F.array(F.format_string("¿Cómo se relacionan %s y %s?", a, b), F.format_string("¿Qué límites tiene %s frente a %s?", a, b))
    three = F.array_append(two, F.format_string("¿Qué cambia si se añade %s?", c))
    return F.when(F.size(terms) >= 3, three).when(F.size(terms) == 2, two).when(quote.isNotNull(), F.array(F.concat(F.lit("¿Estás de acuerdo con: «"), quote, F.lit("»?")))).otherwise(F.array().cast("array<string>"))


OUTCOMES = ["dolor", "mortalidad", "calidad", "tion", "ment"]


def pico(terms: Column, outcomes: list[str] = OUTCOMES) -> Column:
    """Population, intervention, comparison and outcome; the outcome is the first term that is an outcome word, else the fourth."""
    hit = F.get(F.filter(terms, lambda t: t.isin(*outcomes)), 0)
    return F.struct(F.coalesce(F.get(terms, 0), F.lit("")).alias("p"), F.coalesce(F.get(terms, 1), F.lit("")).alias("i"), F.coalesce(F.get(terms, 2), F.lit("ninguna")).alias("c"), F.coalesce(hit, F.get(terms, 3), F.lit("")).alias("o"))


def summary(domain: Column, polarity: Column, terms: Column, quotes_chars: Column) -> Column:
    """A sentence with the tone by polarity; null if the quotes have fewer than 80 characters."""
    tone = F.when(polarity > 0.1, "positivo").when(polarity < -0.1, "negativo").otherwise("neutral")
    return F.when(quotes_chars >= 80, F.format_string("Contenido de %s con tono %s sobre %s.", domain, tone, F.array_join(F.slice(terms, 1, 3), ", ")))


def profile(level: Column) -> Column:
    """The reader a text is for, by its complexity."""
    return F.when(level == "alta", "experto").when(level == "media", "estudiante").otherwise("general")


def reflections(terms: Column, pair: Column, domain: Column) -> Column:
    """What stands out: the first term, the strongest pair, advice for a known domain."""
    return F.filter(F.array(F.when(F.size(terms) > 0, F.format_string("Domina %s.", F.get(terms, 0))), F.when(pair.isNotNull(), F.format_string("El par más fuerte es %s.", pair)), F.when(domain != "GENERAL", F.format_string("Conviene contrastar con fuentes de %s.", domain))), lambda x: x.isNotNull())


def audio_worthy(domain: Column, terms: Column, always: list[str], tech: str, words: list[str]) -> Column:
    """Domains that always are; the technical domain only with one of the words; others never."""
    return domain.isin(*always) | ((domain == tech) & F.exists(terms, lambda t: t.isin(*words)))


def boolean_query(terms: Column) -> Column:
    """Found concepts joined by AND."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " AND ")


def evidence_advice(level: Column, terms: Column) -> Column:
    """From level 3 a query of the first three terms, else that evidence is enough."""
    return F.when(level >= 3, boolean_query(F.slice(terms, 1, 3))).otherwise("suficiente")


#: Words that are an outcome in a weighted record.
WEIGHTED_OUTCOMES = ["riesgo", "riziko", "risk", "resultado", "outcome", "mortalidad"]


def weighted_pico(terms: Column, outcomes: list[str] = WEIGHTED_OUTCOMES) -> Column:
    """A PICO record of terms ordered by weight: the first is the problem, the second the intervention, the first outcome word the outcome."""
    p, i = F.coalesce(F.get(terms, 0), F.lit("pacientes")), F.coalesce(F.get(terms, 1), F.lit("intervención"))
    o = F.coalesce(F.get(F.filter(terms, lambda t: F.lower(t).isin(*outcomes)), 0), F.lit("riesgo"))
    ask = F.format_string("En pacientes con %s, ¿cuál es el efecto de %s sobre %s?", p, i, o)
    return F.struct(F.concat(F.lit("pacientes con "), p).alias("p"), i.alias("i"), F.lit("tratamiento estándar").alias("c"), o.alias("o"), ask.alias("pregunta"))


def reader(domain: Column, tool: Column, context: Column, by_domain: dict[str, str], technical_tools: list[str], executive_contexts: list[str]) -> Column:
    """The profile of a summary's reader by domain, tecnico if it has none; a technical tool, else an executive context, decides before."""
    own = F.coalesce(F.create_map(*(F.lit(x) for kv in by_domain.items() for x in kv))[domain], F.lit("tecnico"))
    return F.when(tool.isin(*technical_tools), "tecnico").when(context.isin(*executive_contexts), "ejecutivo").otherwise(own)
