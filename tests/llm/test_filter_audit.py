import random
import re
from itertools import permutations

import numpy as np

from corpusloom.llm import filter_audit as a


def test_bit_counts():
    rng = np.random.default_rng(3)
    for n in [*range(70), 1000, 16384, 16385, 40000]:
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert a.bit_counts(words).tolist() == [int(((words >> k) & 1).sum()) for k in range(32)]


def fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        yield i, part or "", f


def plain(rows, good, toxic):
    told = list(fails(rows))
    out = []
    for part in {p for _, p, _ in told}:
        own = [(i, f) for i, p, f in told if p == part]
        share = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                share[x] += len(gone)
                lines.append(("".join(order), k + 1, len(left), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(part, *x, share[x[0][x[1] - 1]]) for x in lines]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", "A B C", "a # b", " ".join(words[:120]), " ".join(words[:100]), " ".join(words[:99]), "dup " * 150, " ".join(words[:150]).upper(), "x | " * 60, " ".join(words) + "\t\x0b\r$", "É" * 40 + " " + " ".join(words[:110]), "long " * 40000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(400)]
    rows += [(3, rows[3][1], "en"), (None, texts[4], "en"), (None, texts[4], "en")] + [(1000 + k, texts[4], "es") for k in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 400, 3)] + [(0, 1, 0), (None, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, mask string").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = a.audit(docs, lab)
    good, toxic = good - {None}, toxic - {None}
    assert sorted(map(tuple, got.collect())) == plain(rows, good, toxic)
    assert a.audit(docs.limit(0), lab).count() == 0
    assert a.audit(docs.where("doc_id = 5"), lab.limit(0)).count() == 600
