import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import vector_dups as vd


def brute(vectors, ids):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    link = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    link[i].append(j)
                    link[j].append(i)
    comp, out = {}, []
    for i in range(n):
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                for j in link[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least = min(ids[j] for j in seen)
            comp |= dict.fromkeys(seen, least)
        out.append((ids[i], len(link[i]), comp[i]))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(120):
        base = rng.standard_normal(48)
        for _ in range(rng.choice([1, 1, 2, 9])):
            rows.append((base + rng.choice([0, 0.05, 0.1, 0.3]) * rng.standard_normal(48)).tolist())
    big = rng.standard_normal(48)
    rows += [(big + 0.1 * rng.standard_normal(48)).tolist() for _ in range(90)] + [big.tolist()] * 40 + [(big * 3).tolist()]
    rows += [None, [], [0.0] * 48, [None] + [1.0] * 47, [float("nan")] + [1.0] * 47, [float("inf")] + [1.0] * 47, [1.0, 2.0], [1.0, 2.1], [1e-30] * 48, [1e30] * 48]
    ids = list(range(1000, 1000 + len(rows)))
    df = spark.createDataFrame(list(zip(ids, rows, ids)), "vec_id long, embedding array<double>, uid long").repartition(3)
    want = brute(rows, ids)
    got = {r.vec_id: r for r in vd.links(df, block=32).collect()}
    assert len(got) == len(rows)
    same = sum((got[i].n_links, got[i].component_id) == (n, c) for i, n, c in want)
    assert same / len(want) > 0.97
    assert sum(got[i].n_links for i in got) >= 0.97 * sum(n for _, n, _ in want)
    assert all(got[i].n_links <= n for i, n, _ in want)  # none below the threshold
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 for i, v in zip(ids, rows) if v is None or not v or None in v)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.4 * rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor, turned = vd.codes(x)
    est, err = vd.estimates(code, factor, *vd.quantised(turned), 64)
    true = x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs((est - true)[off].mean()) < 0.002
    assert (np.abs(est - true) <= vd.SIGMAS * err).mean() > 0.9999


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0])] * 3 + [(7, None)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vd.links(df).collect()) == [(5, 2, 5, True)] * 3 + [(7, 0, 7, True)]
    assert vd.links(df.limit(0)).count() == 0


def test_plan_grows_slowly():
    assert [vd.plan(n)[0] for n in (10, 10_000, 10**6, 10**9)] == [6, 7, 14, 24]
