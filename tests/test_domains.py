import difflib
import random
from difflib import SequenceMatcher

import duckdb
import pytest

from corpusloom.operators import domains as dm
from corpusloom.operators.fuzzy import Dictionary
from corpusloom.plans import registry

TERMS = [("mercado", "FINANZAS"), ("machine learning", "TECNOLOGIA"), ("salud", "SALUD"), ("derecho penal", "LEGAL")]


def brute(text):
    ws = (text or "").lower().split()
    votes = {}
    for weight, gs in ((1, ws), (2, [f"{a} {b}" for a, b in zip(ws, ws[1:])])):
        for g in gs:
            best, found = 0, None
            for t, d in TERMS:
                r = SequenceMatcher(None, g, t).ratio()
                if r > best:
                    best, found = r, d
            if best >= 0.6:
                votes[found] = votes.get(found, 0) + weight
    return (max(votes, key=votes.get), max(votes.values())) if votes else ("GENERAL", 0)


def test_fuzzy_votes(spark):
    rng = random.Random(4)
    words = "machin lerning Mercdo salut, derech penall saludd el y zzz q9 learning\tde".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(80)] + ["machin lerning", "salud mercado", "salud salud mercado", "zzz", "", None, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "content_id long, text string")
    got = {r.content_id: (r.nicho, r.votos) for r in dm.fuzzy_votes(df, spark.createDataFrame([(t, d, i) for i, (t, d) in enumerate(TERMS)], "term string, nicho string, place int")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert got[80][0] == "TECNOLOGIA"


def test_bounds_lose_nothing_and_save_ratios():
    rng = random.Random(6)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    terms = [make("abcde ", rng.randrange(1, 12)) for _ in range(25)] + ["x" * 70, "ab" * 40, "\U0001f600é", "abc", "abc"]
    words = list({make("abcdefgh ", rng.randrange(14)) for _ in range(1500)} | {"x" * 60, "ab" * 37, "é", "axbyc", "", "q\0"} | {t[:-1] for t in terms})
    for least in (0.6, 0.75, 0.9):
        got, calls = Dictionary(terms, least).best(words)
        for w, t in zip(words, got):
            rs = [SequenceMatcher(None, w, x).ratio() for x in terms]
            top = max(rs)
            assert t == (rs.index(top) if top >= least else -1), (w, t, least)
        assert calls < len(words) * len(terms) / 10
    assert Dictionary([], 0.6).best(["a"]) == ([-1], 0) and Dictionary(["a"], 0.6).best([]) == ([], 0)


def test_speakers_by_profession_and_anonymous(spark):
    rows = [
        (1, "legal", "Ana: hola\nhabla el Dr. Juan Pérez, y\nla jueza María López. El Testigo calla\nun testigo"),
        (2, "legal", "nadie habla\naqui"),
        (3, "auto", "un testigo\nla Dra. Eva Ruiz."),
    ]
    got = {(r.content_id, r.nombre): r.veces for r in dm.speakers(spark.createDataFrame(rows, "content_id long, modo string, text string")).collect()}
    assert got == {(1, "Ana"): 1, (1, "Dr. Juan Pérez"): 1, (1, "jueza María López"): 1, (1, "testigo"): 2, (2, "persona1"): 1, (2, "persona2"): 1, (3, "Dra. Eva Ruiz"): 1}


@pytest.mark.parametrize("name", ["h8_speaker_mode", "h9_speakers"])
def test_speakers_as_in_sql(spark, tmp_path, name):
    """Professions, witnesses, anonymous speakers, other line ends and equal turns."""
    rows = [
        (1, 0, "user", "habla el Dr. Juan P\u00e9rez y\u00a0la JUEZA\u2003mar\u00eda l\u00f3pez"), (1, 1, "assistant", "un Testigo, testigo_no y \u00e9testigo; testigo testigo"),
        (2, 0, "user", "el fiscal a"), (3, 0, "user", "sin nada\r\nAna: hola\u2028Eva: hola\rLuz: si"), (4, 0, "", "tribunal\nuno"), (4, 1, "", "dos"), (4, 2, "1", None),
        (5, 0, "user", "b: x"), (5, 0, "user", "a cuadra norte"), (5, 0, "system", "c"), (6, 0, "user", None), *((7, i, "user", "x dr uno") for i in range(25)),
    ]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 5


def test_terms_side_by_side_bound_and_match_as_difflib():
    """Terms of one word share a pass, also when they fill it to the last bit; matched characters are counted as difflib counts them."""
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcdé", k=n))
    terms = [make(n) for n in (1, 3, 5, 8, 30, 62, 63, 64, 70, 31, 31, 0, 2)]
    words = [make(rng.randrange(40)) for _ in range(300)] + terms
    known = Dictionary(terms, 0.6)
    assert {k for *_, held in known.packs for k, _ in held} == {k for k, t in enumerate(terms) if len(t) < 63}
    ratio = lambda w, t: difflib.SequenceMatcher(None, w, t).ratio()
    at, term, bound = known.bounds(words)
    bounds = {(w, t): b for w, t, b in zip(at.tolist(), term.tolist(), bound.tolist())}
    for i, w in enumerate(words):
        rs = [ratio(w, t) for t in terms]
        assert all(r < 0.6 or bounds[i, k] >= r - 1e-9 for k, r in enumerate(rs))
        assert known.best([w])[0][0] == (rs.index(max(rs)) if max(rs) >= 0.6 else -1)
