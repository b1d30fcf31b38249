import hashlib
import random

import itertools

from corpusloom.operators import cluster as cl
from corpusloom.operators import graph as gr


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [[*p, n] for p in level for n in near[p[-1]] if n not in p]
        return found

    score = dict.fromkeys(near, 0.0)
    for s, t in itertools.combinations(near, 2):
        ps = paths(s, t)
        for n in near:
            if n not in (s, t) and ps:
                score[n] += sum(n in p for p in ps) / len(ps)
    k = max(1, (len(near) - 1) * (len(near) - 2) / 2)
    return {n: round(v / k, 6) for n, v in score.items()}


def test_betweenness_counts_all_shortest_paths(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f")]
    df = spark.createDataFrame([(*e, 1) for e in edges], "src string, dst string, peso long")
    got = {r.node: r.centralidad for r in gr.betweenness(df).collect()}
    assert got == brute(edges)
    assert {r.node: r.rol for r in gr.betweenness(df).collect()}["d"] == "monopolio"


def test_graph_weights(spark):
    c = spark.createDataFrame([(1, "alfa", 9), (1, "beta", 20), (2, "beta", 6), (2, "alfa", 30), (2, "xx", 99)], "content_id long, term string, frequency long")
    assert [tuple(r) for r in gr.count_graph(c).collect()] == [("alfa", "beta", 2)]
    assert {(r.src, r.dst): r.peso for r in gr.frequency_graph(c).collect()} == {("alfa", "beta"): 1.5, ("alfa", "xx"): 3.0}


def test_silhouette_and_kmeans(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [9.0, 0.0]), (4, 2, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    assert 0 < cl.silhouette(df).first().silhouette < 1
    w = spark.createDataFrame([(i, t, 1.0) for i, t in ((1, "a"), (2, "a"), (3, "b"), (4, "b"))], "content_id long, term string, weight double")
    out, inertia = cl.kmeans(cl.sparse_vectors(w), 2)
    assert inertia < 1e-9 and out.select("cluster").distinct().count() == 2


def test_betweenness_by_levels(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)} | {(90, 91)}
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", 1.0) for a, b in pairs], "src string, dst string, peso double")
    held, tables = ({r.node: (r.centralidad, r.rol) for r in gr.betweenness(edges, h).collect()} for h in (1000, 5))
    assert held == tables and len(held) == len({x for p in pairs for x in p}) and max(v for v, _ in held.values()) > 0


def test_all_pairs_of_large_contents(spark):
    names = spark.range(30).selectExpr("1L as content_id", "concat('n', id) as name").unionByName(spark.createDataFrame([(2, "a"), (2, "b"), (2, "a"), (3, "x"), (3, None)], "content_id long, name string"))
    got = [tuple(r) for r in gr.entity_pairs(names, block=4).collect()]
    assert len(got) == len(set(got)) == 30 * 29 // 2 + 1 and all(a < b for _, a, b in got)


def test_term_kmeans(spark):
    rng = random.Random(9)
    topics = [[f"t{k}{i}" for i in range(12)] for k in range(4)]
    rows = [(d, t, round(rng.uniform(0.2, 1), 3)) for d in range(120) for t in rng.sample(topics[d % 4], 5)] + [(7, "zero", 0.0)]
    ids = list(range(123))  # three without terms
    df = spark.createDataFrame(rows, "content_id long, term string, weight double").repartition(4)
    vectors, weights = cl.normed(spark.createDataFrame([(i,) for i in ids], "content_id long"), df)
    x = {i: {t: w for d, t, w in rows if d == i and w} for i in ids}

    def brute(k, rounds):
        with_terms = sorted((i for i in ids if x[i]), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:k]
        c = [dict(x[i]) for i in with_terms]
        dist = lambda a, b: round(sum((a.get(t, 0) - b.get(t, 0)) ** 2 for t in {*a, *b}), 9)
        near = lambda: {i: min((dist(x[i], m), j) for j, m in enumerate(c)) for i in ids}
        found = near()
        for n in range(rounds):
            for j in range(len(c)):
                own = [i for i in ids if found[i][1] == j]
                if own:
                    c[j] = {t: sum(x[i].get(t, 0) for i in own) / len(own) for t in {t for i in own for t in x[i]}}
            new = near()
            still = all(new[i][1] == found[i][1] for i in ids)
            found = new
            if still:
                return found, n + 1
        return found, rounds

    for k, rounds in ((4, 1), (6, 100), (1, 3), (500, 2)):
        want, used = brute(k, rounds)
        got = {r.content_id: (r.distance, r.cluster) for r in cl.term_kmeans(vectors, weights, k, 42, rounds).collect()}
        assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()} and all(abs(got[i][0] - want[i][0]) < 1e-8 for i in ids)
        assert rounds < 100 or used < 100
    none = cl.term_kmeans(*cl.normed(spark.createDataFrame([(1,), (2,)], "content_id long"), df.limit(0)), 3).collect()
    assert [(r.cluster, r.distance) for r in none] == [(0, 0.0)] * 2


def test_silhouette_by_bounds(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 3) for _ in range(4)] for _ in range(7)]
    rows = [(i, i % 7, [rng.gauss(m, 1) for m in centres[i % 7]]) for i in range(260)] + [(999, 50, [9.0, 9.0, 9.0, 9.0])]
    rows += [(300 + i, 3, rows[3][2]) for i in range(40)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    scores = []
    for i, own, v in rows:
        d = {}
        for j, label, u in rows:
            if i != j:
                d.setdefault(label, []).append(dist(v, u))
        a, others = d.get(own), [sum(x) / len(x) for label, x in d.items() if label != own]
        scores.append(0.0 if not a else (min(others) - sum(a) / len(a)) / max(min(others), sum(a) / len(a)))
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").repartition(3)
    counted = {}
    assert abs(cl.silhouette(df, block=50, counted=counted).first().silhouette - sum(scores) / len(scores)) < 2e-6
    assert counted["pairs"] < 0.6 * counted["all"]
    assert cl.silhouette(df.limit(0)).first().silhouette is None


def test_betweenness_with_folded_leaves(spark):
    rng = random.Random(8)
    for seed, (n, m) in enumerate([(9, 8), (9, 11), (8, 5), (2, 1), (7, 6)]):
        pairs = {(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, n)} if seed % 2 == 0 else set()
        while len(pairs) < m:
            a, b = rng.sample(range(n), 2)
            pairs.add((f"n{max(a, b)}", f"n{min(a, b)}"))
        pairs |= {("x", "y"), ("z1", "z2"), ("z2", "z3"), ("z3", "z4")}
        df = spark.createDataFrame([(*p, 1) for p in sorted(pairs)], "src string, dst string, peso long")
        want, counted = brute_over_components(pairs), {}
        for held in (1000, 3):
            got = {r.node: r.centralidad for r in gr.betweenness(df, held, counted).collect()}
            assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 2e-6 for v in want), (held, pairs)
            assert counted["sources"] < counted["nodes"]
    assert gr.betweenness(df.limit(0)).count() == 0


def test_betweenness_searches_once_from_neighbours_that_have_the_same_ones(spark):
    """Cliques of words of one text, as a graph of terms has them, with leaves on some of their nodes; the two ways of finding a level are both taken."""
    pairs = {(f"c{k}w{i}", f"c{k}w{j}") for k in range(3) for i in range(6) for j in range(i)}
    pairs |= {("c0w5", "c1w5"), ("c0w4", "c1w4"), ("c1w5", "c2w5"), ("leaf1", "c0w1"), ("leaf2", "c0w1"), ("leaf3", "c2w2")}
    pairs = {tuple(sorted(p)) for p in pairs}
    df = spark.createDataFrame([(*p, 1) for p in sorted(pairs)], "src string, dst string, peso long")
    want, counted = brute_over_components(pairs), {}
    for held in (1000, 3):
        got = {r.node: r.centralidad for r in gr.betweenness(df, held, counted if held == 1000 else None).collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 2e-6 for v in want), held
    assert counted == {"nodes": 21, "sources": 8}


def test_betweenness_holds_a_graph_of_more_than_100_000_edges(spark):
    """A complete bipartite graph: all paths of a side are shared by the nodes of the other."""
    n, m = 420, 260
    edges = spark.range(n * m).selectExpr(f"concat('a', id % {n}) as src", f"concat('b', cast(floor(id / {n}) as long)) as dst", "2L as peso")
    counted = {}
    got = {r.node: r.centralidad for r in gr.betweenness(edges, counted=counted).collect()}
    pairs = (n + m - 1) * (n + m - 2) / 2
    want = {"a": m * (m - 1) / 2 / n / pairs, "b": n * (n - 1) / 2 / m / pairs}
    assert counted == {"nodes": n + m, "sources": n + m} and len(got) == n + m and all(abs(x - want[v[0]]) < 2e-6 for v, x in got.items())


def brute_over_components(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = dict.fromkeys(near, 0.0)
    for s, t in itertools.combinations(sorted(near), 2):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [[*p, n] for p in level for n in near[p[-1]] if n not in p]
        for n in near:
            if n not in (s, t) and found:
                score[n] += sum(n in p for p in found) / len(found)
    k = max(1, (len(near) - 1) * (len(near) - 2) / 2)
    return {n: v / k for n, v in score.items()}
