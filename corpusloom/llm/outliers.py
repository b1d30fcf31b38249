"""Quality rules by robust multivariate outliers: minimum covariance determinant estimates per language and source.

Five statistics of each text are counted in SQL expressions: words, characters in words, symbols, repeated lines, and words
in repeated windows. Texts that fail a base rule (too short, too much repeated) go; of the others the statistics are
transformed to shortness and logarithms of rates, and a text whose vector lies too far from its group, by Mahalanobis
distance to the minimum covariance determinant estimate of that group, goes too.

Everything is a DataFrame expression, joins and sums included: a concentration step measures the distance of each
vector from its group's estimate, sums counts and products in narrow bins of distance (partial sums first, so a hot
group costs a task no more than its bins), and takes the bins nearest to the centre that hold ``coverage`` of the vectors as the
next subset. Vectors are fixed-point integers and their sums exact, so results don't depend on the order of tasks.

Defined results: a null or empty text has no words and fails the base rules. Equal vectors of statistics in a group
count once in its estimate, so copies can't pull it, and copies get equal verdicts. Null languages and sources are
values of their own. A group with fewer than ``least`` distinct vectors is judged by the estimate of its language, and where
that has too few by that of all texts; where these are too few as well, nothing is rejected but by the base rules.
Columns other than those asked for are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import bind
from corpusloom.llm.common import discard, stash

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST = 60
COVERAGE = 0.75
#: Chance of a normal vector to be rejected.
TAIL = 1e-6
STEPS = 20
#: Least standard deviation of each transformed statistic: a group whose texts never have a symbol mustn't reject one for its first.
FLOORS = (0.05, 0.03, 0.30, 0.30, 0.30)
P, UNIT, SALTS, BINS = 5, 1024, 16, 32
SPACE = r"[\x20\x09-\x0D]+"
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _repeated_words(words: Column) -> Column:
    """How many words stand in a window of eight that the text holds twice or more. A window is known by its 64-bit hash."""
    paired = lambda h, by: F.zip_with(h, F.slice(h, F.lit(by + 1), F.greatest(F.size(h) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, first, lambda acc, i: F.struct((acc["n"] + i + 8 - F.greatest(acc["end"], i)).alias("n"), (i + 8).alias("end")), lambda acc: acc["n"])

    def twice(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        hit = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(same(x, i), (x["h"] == F.get(s, i + 1)["h"]), F.lit(False)), x["i"])), lambda i: i.isNotNull())
        return covered(F.sort_array(hit))

    def of(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(bind(ordered, twice))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    windows = bind(ones, lambda a: bind(paired(a, 1), lambda b: bind(paired(b, 2), lambda c: F.slice(paired(c, 4), F.lit(1), F.size(words) - 7))))
    return F.when(F.size(words) < 9, 0).otherwise(bind(windows, of)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text", carry: list[str] = ["doc_id", "lang", "source"]) -> DataFrame:  # noqa: B006
    """``carry`` and the five counts of each text; a narrow step."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words")))
    duplicates = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return docs.select(
        *carry,
        counted.alias("_counted"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        duplicates.alias("n_dup_lines"),
    ).select(*carry, "_counted.n_words", "word_chars", "n_symbols", "n_dup_lines", "_counted.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def transformed() -> list[Column]:
    """The vector, in units of 1/1024: a length that levels off, as no text is too long, and logarithms of rates. Fifty
    usual words are added to each text, so that a rate of a short one doesn't stand out by chance."""
    n, more = F.col("n_words"), F.col("n_words") + 50
    parts = [100 / (n + 100), F.log((F.col("word_chars") + 250) / more), F.log1p(100 * F.col("n_symbols") / more), F.log1p(100 * F.col("n_dup_lines") / more), F.log1p(10 * F.col("n_repeat_words") / more)]
    return [F.round(UNIT * x).cast("long").alias(f"x{i}") for i, x in enumerate(parts)]


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an odd number of degrees of freedom."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(3, degrees + 1, 2):
        total, term = total - term, term * x / k
    return total


def quantile(share: float, degrees: int = P) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < share else (low, mid)
    return high


def consistency(share: float) -> float:
    """What a covariance of the central ``share`` of normal vectors is multiplied by."""
    return share / chi_square(quantile(share), P + 2)


def _factor(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``l`` (row by row) of ``s`` and its log determinant. The floors are added to the diagonal, so it exists."""
    entry: dict[tuple[int, int], Column] = {}
    for at, (i, j) in enumerate(_PAIRS):
        rest = F.col("s")[at] + (F.lit((FLOORS[i] * UNIT) ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        entry[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"_l{j}{j}")
        estimates = estimates.withColumn(f"_l{i}{j}", entry[i, j])
    det = reduce(lambda a, b: a + b, (2 * F.log(F.col(f"_l{i}{i}")) for i in range(P)))
    names = [f"_l{i}{j}" for i, j in _PAIRS]
    return estimates.withColumns({"l": F.array(*names), "det": det}).drop(*names)


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x0``.. from ``m`` by forward substitution in ``l``: a fold over the coordinates."""
    x = [F.col(f"x{i}") - F.col("m")[i] for i in range(P)]
    at = {p: k for k, p in enumerate(_PAIRS)}

    def solve(i: int, y: Column) -> Column:
        if i == P:
            return F.aggregate(y, F.lit(0.0), lambda a, v: a + v * v)
        rest = x[i]
        for k in range(i):
            rest = rest - F.col("l")[at[i, k]] * F.get(y, F.lit(k))
        return bind(F.array_append(y, rest / F.col("l")[at[i, i]]), lambda z: solve(i + 1, z))

    return solve(0, F.array().cast("array<double>"))


def _near(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """Vectors beside their group's estimates. Each estimate is there once for each salt, so that a hot group spreads over as many tasks."""
    return vectors.join(estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["cell", "salt"]).withColumn("d2", _distance())


def _sums(near: DataFrame, keys: list[str]) -> DataFrame:
    return near.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"a{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}{j}") for i, j in _PAIRS))


def _moments(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Mean and covariance, times ``scale``, from sums."""
    names = ["n", *(f"a{i}" for i in range(P)), *(f"b{i}{j}" for i, j in _PAIRS)]
    total = sums.groupBy(*keys).agg(*(F.sum(c).cast("double").alias(c) for c in names))
    n = F.col("n")
    means = F.array(*(F.col(f"a{i}") / n for i in range(P)))
    cov = F.array(*((F.col(f"b{i}{j}") - F.col(f"a{i}") / n * F.col(f"a{j}")) / n * scale for i, j in _PAIRS))
    return _factor(total.select(*keys, means.alias("m"), cov.alias("s")))


def _step(vectors: DataFrame, estimates: DataFrame, coverage: float) -> DataFrame:
    """A concentration step: the estimate of the ``coverage`` of each group nearest to the one before, by whole bins of distance."""
    binned = _near(vectors, estimates).withColumn("bin", F.floor(BINS * F.log2(F.col("d2") + 1 / 64)).cast("int"))
    w = Window.partitionBy("cell", "start")
    before = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    nearest = _sums(binned, ["cell", "start", "bin"]).withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("n").over(w)})
    return _moments(nearest.where(F.col("_before") < coverage * F.col("_all")), ["cell", "start"], consistency(coverage))


def _starts(vectors: DataFrame) -> DataFrame:
    """Three first estimates of each group about its medians: by quartiles alone, and with correlations of flattened
    vectors (hyperbolic tangents) and of spatial signs. Values are whole numbers in a small range, so exact quantiles are cheap."""
    q = vectors.groupBy("cell").agg(*(F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(P)))
    spread = lambda i: F.sqrt(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + (FLOORS[i] * UNIT) ** 2)
    around = stash(q.select("cell", F.array(*(F.col(f"q{i}")[1] for i in range(P))).alias("m"), F.array(*(spread(i) for i in range(P))).alias("d")))
    spreadout = around.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    z = [(F.col(f"x{i}") - F.col("m")[i]) / F.col("d")[i] for i in range(P)]
    near = vectors.join(spreadout, ["cell", "salt"]).withColumn("z", F.array(*z))
    norm = F.sqrt(F.aggregate("z", F.lit(1e-9), lambda a, v: a + v * v))
    flat, sign = F.transform("z", F.tanh), F.transform("z", lambda v: v / norm)
    # whole numbers again, so that the sums don't depend on the order of tasks
    fixed = near.select("cell", *(F.transform(a, lambda v: F.round(v * 10000).cast("long")).alias(c) for c, a in (("t", flat), ("u", sign))))
    summed = fixed.groupBy("cell").agg(F.count("*").alias("n"), *(F.sum(F.col(c)[i] * F.col(c)[j]).cast("double").alias(f"{c}{i}{j}") for c in "tu" for i, j in _PAIRS))
    corr = lambda c, i, j: F.lit(1.0) if i == j else F.coalesce(F.try_divide(F.col(f"{c}{i}{j}"), F.sqrt(F.col(f"{c}{i}{i}") * F.col(f"{c}{j}{j}"))), F.lit(0.0))
    both = summed.join(around, "cell")
    kinds = [F.array(*((F.lit(float(i == j)) if c is None else corr(c, i, j)) * F.col("d")[i] * F.col("d")[j] for i, j in _PAIRS)) for c in (None, "t", "u")]
    return _factor(both.select("cell", "m", F.posexplode(F.array(*kinds)).alias("start", "s")))


def _cells(distinct: DataFrame, least: int) -> DataFrame:
    """``lang, source``, the ``cell`` that judges a group (its own, its language's, that of all, or null), and ``cells``,
    the array of those its vectors count in."""
    sizes = distinct.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("_in_lang"), F.min("n").alias("_least")).withColumnRenamed("lang", "_lang")
    total = langs.agg(F.sum("_in_lang").alias("_in_all"), F.min("_in_lang").alias("_least_lang"))
    null = {c: F.lit(None).cast(sizes.schema[c].dataType) for c in ("lang", "source")}
    own = F.struct(F.lit(0).alias("level"), "lang", "source")
    lang = F.struct(F.lit(1).alias("level"), F.col("lang"), null["source"].alias("source"))
    every = F.struct(F.lit(2).alias("level"), null["lang"].alias("lang"), null["source"].alias("source"))
    # a language's estimate is made if one of its groups is too small, that of all if a language is
    enough = [F.col("n") >= least, (F.col("_in_lang") >= least) & (F.col("_least") < least), (F.col("_in_all") >= least) & (F.col("_least_lang") < least)]
    cell = F.when(enough[0], own).when(F.col("_in_lang") >= least, lang).when(F.col("_in_all") >= least, every)
    cells = F.filter(F.array(*(F.when(e, c) for e, c in zip(enough, (own, lang, every)))), lambda c: c.isNotNull())
    # the total is one row
    return sizes.join(langs, F.expr("lang <=> _lang")).join(F.broadcast(total)).select("lang", "source", cell.alias("cell"), cells.alias("cells"))


def estimates(rows: DataFrame, least: int = LEAST, coverage: float = COVERAGE, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """From ``lang, source`` and the counts of texts that pass the base rules to ``(cells, estimates)``: which cell judges
    each group, and of each cell the mean ``m``, covariance ``s`` and Cholesky factor ``l``.

    Three starts take two concentration steps; of each cell the one of the least determinant goes on until no
    determinant falls, ``steps`` at most. The last estimate is reweighted: all vectors within the 0.975 quantile of it.
    """
    distinct = stash(rows.select("lang", "source", *COUNTS).distinct())
    cells = stash(_cells(distinct, least))
    to = cells.select(F.struct("lang", "source").alias("_g"), F.explode("cells").alias("cell"))
    keyed = distinct.withColumn("_g", F.struct("lang", "source")).join(to, "_g").select("cell", *COUNTS).distinct().select("cell", *transformed())
    vectors = stash(keyed.withColumn("salt", F.pmod(F.xxhash64(*(f"x{i}" for i in range(P))), F.lit(SALTS)).cast("int")))
    now = stash(_starts(vectors))
    for _ in range(2):
        now, old = stash(_step(vectors, now, coverage)), now
        discard(old)
    best = now.groupBy("cell").agg(F.min(F.struct("det", "start", "m", "s", "l")).alias("b")).select("cell", "b.start", "b.m", "b.s", "b.l", "b.det")
    now = stash(best)
    for _ in range(steps):
        new = stash(_step(vectors, now, coverage))
        falling = new.join(now.select("cell", F.col("det").alias("_det")), "cell").where(F.col("det") < F.col("_det") - 1e-6)
        better = stash(new.unionByName(now).groupBy("cell").agg(F.min(F.struct("det", "start", "m", "s", "l")).alias("b")).select("cell", "b.start", "b.m", "b.s", "b.l", "b.det"))
        done = not falling.take(1)
        now = better
        if done:
            break
    central = _near(vectors, now).where(F.col("d2") <= quantile(0.975))
    final = stash(_moments(_sums(central, ["cell", "start"]), ["cell"], consistency(0.975)))
    return cells, final


def judge(docs: DataFrame, text_col: str = "text", carry: list[str] = ["doc_id"], least: int = LEAST, coverage: float = COVERAGE, tail: float = TAIL, steps: int = STEPS) -> DataFrame:  # noqa: B006
    """``carry``, the five counts, ``base_failed``, ``kept`` and ``distance`` (squared; null where nothing is measured) of each row."""
    names = [f"_c{i}" for i in range(len(carry))]
    told = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(text_col).alias("_text"))
    rows = stash(statistics(told, "_text", [*names, "lang", "source"]).withColumn("base_failed", base_failed()))
    cells, final = estimates(rows.where("not base_failed"), least, coverage, steps)
    to = cells.join(final.select("cell", "m", "l"), "cell").select(F.struct("lang", "source").alias("_g"), "m", "l").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    x = rows.withColumns({"_g": F.struct("lang", "source"), "salt": F.pmod(F.xxhash64(*COUNTS, *names), F.lit(SALTS)).cast("int")}).select("*", *transformed())
    measured = x.join(to, ["_g", "salt"], "left").withColumn("distance", F.when(~F.col("base_failed") & F.col("m").isNotNull(), F.round(_distance(), 6)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= quantile(1 - tail), F.lit(True))
    return measured.select(*(F.col(n).alias(c) for c, n in zip(carry, names)), *COUNTS, "base_failed", kept.alias("kept"), "distance")
