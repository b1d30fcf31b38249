import math
import random
import re

import numpy as np

from corpusloom.llm import outliers as o

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """The five statistics, word by word."""
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a " * 8, "a " * 9, "a b " * 9, "#<>|\x0b* x y é\U0001f600", "x\n\nx\n x\ny\r\nx", "one two three four five six seven eight nine\n" * 3]
    texts += ["".join(rng.choice(["a", "b", "c", "dd", "\n", "#"]) + rng.choice([" ", "  ", "\t", "\n"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(30000)) + " " + " ".join(f"k{i}" for i in range(20)) * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in o.COUNTS) for r in o.statistics(df, carry=["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [counts(t) for t in texts]


def vector(c):
    n, chars, symbols, lines, repeats = c
    more = n + 50
    parts = [100 / (n + 100), math.log((chars + 250) / more), math.log1p(100 * symbols / more), math.log1p(100 * lines / more), math.log1p(10 * repeats / more)]
    return [math.floor(abs(1024 * x) + 0.5) * (1 if x >= 0 else -1) for x in parts]


def estimate(x, coverage=o.COVERAGE, steps=o.STEPS):
    """Minimum covariance determinant of the rows of ``x``: the same starts and steps, with matrices."""
    floors = np.diag([(f * 1024) ** 2 for f in o.FLOORS])
    dist = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s + floors), x - m)
    det = lambda s: np.linalg.slogdet(s + floors)[1]
    moments = lambda own, share: (own.mean(0), np.cov(own.T, bias=True).reshape(5, 5) * o.consistency(share))

    def step(m, s):
        bins = np.floor(32 * np.log2(dist(m, s) + 1 / 64))
        order = np.sort(bins)
        return moments(x[bins <= order[math.ceil(coverage * len(x)) - 1]], coverage)

    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    d = np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + np.diag(floors))
    z = (x - q[1]) / d
    unit = z / np.sqrt((z**2).sum(1) + 1e-9)[:, None]
    found = []
    for t in (None, np.tanh(z), unit):
        r = np.eye(5)
        if t is not None:
            g = np.round(t * 10000).T @ np.round(t * 10000)
            size = np.sqrt(np.outer(np.diag(g), np.diag(g)))
            r = np.where(np.eye(5) > 0, 1.0, np.divide(g, size, out=np.zeros((5, 5)), where=size > 0))
        e = (q[1], r * np.outer(d, d))
        for _ in range(2):
            e = step(*e)
        found.append(e)
    m, s = min(found, key=lambda e: det(e[1]))
    for _ in range(steps):
        new = step(m, s)
        if det(new[1]) >= det(s) - 1e-6:
            if det(new[1]) < det(s):
                m, s = new
            break
        m, s = new
    m, s = moments(x[dist(m, s) <= o.quantile(0.975)], 0.975)
    return m, s + floors


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        n = int(math.exp(rng.gauss(5, 0.7))) + 20
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 4, 5, 7, 9]))) for _ in range(n))
        if i % 17 == 0:
            text = text.replace(" ", "### ")
        elif i % 23 == 0:
            text = text.upper().replace(" ", "!!! ")
        elif i % 29 == 0:
            text = text[:100] + "\nthe same line\nthe same line" * 9 + text[100:]
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None])))
    rows += [(1000 + k, rows[5][1], "en", "a") for k in range(400)]  # copies
    rows += [(2000 + k, t, "fr", f"s{k}") for k, t in enumerate([None, "", rows[0][1], rows[1][1], "two words"])]
    return rows


def test_verdicts(spark):
    rows = corpus(11)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, distance string").repartition(5)
    got = {r["doc_id"]: r for r in o.judge(df).collect()}
    assert len(got) == len(rows)
    told = {i: counts(t) for i, t, _, _ in rows}
    failed = {i: c[0] < 20 or 100 * c[4] > 30 * c[0] for i, c in told.items()}
    by = {}
    for i, _, lang, source in rows:
        if not failed[i]:
            by.setdefault((lang, source), set()).add(told[i])
    langs, every = {}, set()
    for (lang, _), own in by.items():
        langs[lang] = langs.get(lang, set()) | own
        every |= own
    in_lang = {lang: sum(len(v) for (x, _), v in by.items() if x == lang) for lang in langs}
    fits = {}
    rejected = 0
    for i, _, lang, source in rows:
        r = got[i]
        assert (tuple(r[c] for c in o.COUNTS), r["base_failed"]) == (told[i], failed[i])
        if failed[i]:
            assert not r["kept"] and r["distance"] is None
            continue
        own = by[lang, source]
        own = own if len(own) >= o.LEAST else langs[lang] if in_lang[lang] >= o.LEAST else every
        m, s = fits.setdefault(frozenset(own), None) or fits.update({frozenset(own): estimate(np.array([vector(c) for c in sorted(own)], float))}) or fits[frozenset(own)]
        v = np.array(vector(told[i])) - m
        d = v @ np.linalg.inv(s) @ v
        assert abs(d - r["distance"]) < 1e-5 * (1 + d), (i, d, r["distance"])
        assert r["kept"] == (d <= o.quantile(1 - o.TAIL))
        rejected += not r["kept"]
    assert rejected > 30 and all(got[i]["kept"] for i in range(1000, 1400))
    junk = [i for i in range(700) if (i % 17 == 0 or i % 23 == 0) and not failed[i]]
    assert sum(not got[i]["kept"] for i in junk) >= 0.95 * len(junk)
    assert sum(not got[i]["kept"] for i in range(700) if i % 17 and i % 23 and i % 29) <= 2


def test_quantiles():
    for share, degrees, want in ((0.95, 5, 11.0705), (0.975, 5, 12.8325), (0.75, 5, 6.62568), (0.95, 7, 14.0671), (0.99, 3, 11.3449)):
        assert abs(o.quantile(share, degrees) - want) < 1e-3


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "word " * 30, "en", "a"), (1, "word " * 30, "en", "a"), (2, " ".join(f"w{i}" for i in range(40)), None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    got = sorted(((r["doc_id"] or 0), r["base_failed"], r["kept"], r["distance"]) for r in o.judge(df).collect())
    assert got == [(0, True, False, None), (1, True, False, None), (1, True, False, None), (2, False, True, None)]
    assert o.judge(df.limit(0)).count() == 0


def test_no_python_on_the_executors(spark):
    rows = corpus(3)[:200]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = o.judge(df)._jdf.queryExecution().toString() + o.statistics(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
