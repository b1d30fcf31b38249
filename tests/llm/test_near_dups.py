import random

import numpy as np

from corpusloom.llm import near_dups as nd


def brute(texts):
    s = nd.Shingler()
    sets = [s(t) for t in texts]
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i]) and nd.similarity(sets[i], sets[j]) >= 0.8:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        x = np.sort(np.concatenate([base, base[:100]]))
        y = np.sort(np.concatenate([base[: int(400 * share)], rng.integers(0, 2**63, 400 - int(400 * share)).astype(np.uint64), base[:50]]))
        sig = nd.signatures([x, y], 3000)
        assert abs((sig[0] == sig[1]).mean() - nd.similarity(x, y)) < 0.04


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    docs = [np.sort(rng.integers(0, 50, n).astype(np.uint64)) for n in (1, 2, 7, 300, 5000)]
    together = nd.signatures(docs, 144)
    for i, d in enumerate(docs):
        assert (nd.signatures([d], 144)[0] == together[i]).all()
    assert (together != 0).all()


def test_classes_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, len(base) // 60, len(base) // 25])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(50)) for _ in range(20)]  # like in part only
    texts += ["same line here again and " * 40, "same line here again and " * 39, "a b", "a b", "A  B", "", "", None, "  ", "one"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: r for r in nd.classes(df).collect()}
    want = brute(texts)
    assert {i: got[i].class_id for i in got} == dict(enumerate(want))
    assert all(r.kept == (r.class_id == r.doc_id) for r in got.values())


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "the same row of words again")] * 4 + [(1, "another text under the same id")], "doc_id long, text string")
    rows = nd.classes(df).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2
    assert nd.classes(df.limit(0)).count() == 0


def test_rows_without_an_id(spark):
    base = " ".join(f"word{i % 97}x{i}" for i in range(200))
    near = base + " tail"
    other = " ".join(f"else{i}" for i in range(80))
    rows = [(None, base), (None, base), (7, near), (8, base), (None, other), (None, other + " end"), (9, "quite another text of some words")]
    got = nd.classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3
    assert sorted(str(r.class_id) for r in got) == ["7", "7", "7", "7", "9", "None", "None"]
    assert {r.doc_id for r in got if r.kept} == {7, 9, None}
