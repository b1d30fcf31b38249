import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import vector_codes as v


def brute(parts, book):
    d = ((parts[:, None] - book[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def test_nearest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        d, size = rng.integers(1, 9), rng.integers(1, 40)
        spread = rng.choice([2, 5, 2000])
        book = rng.integers(-spread, spread + 1, (size, d))
        x = rng.integers(-spread, spread + 1, (rng.integers(0, 60), d))
        index, best, looked = v.nearest(x, book)
        want = brute(x, book) if len(x) else (index, best)
        assert (index == want[0]).all() and (best == want[1]).all() and looked <= len(x) * size
    book, x = rng.normal(0, 300, (256, 16)).astype(np.int64), rng.normal(0, 300, (3000, 16)).astype(np.int64)
    assert v.nearest(x + rng.normal(0, 2000, (3000, 1)).astype(np.int64), book)[2] < 0.9 * 3000 * 256  # the bound ends searches early
    most = int(1024 * v.limit(2048)) - 1
    edge = np.array([[most] * 2048, [-most] * 2048])
    assert v.nearest(edge, edge[::-1])[0].tolist() == [1, 0]


def plain(rows, parts=4, entries=256, rounds=4):
    """The contract with plain integers: rows are ``(vec_id, vector, label)``."""
    ok = [(i, [int(np.floor(1024 * float(x))) for x in e], lab) for i, e, lab in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    if not ok:
        return []
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(ok[0][1])
    ok = [r for r in ok if len(r[1]) == length]
    pad = -length % parts
    x = np.array([r[1] + [0] * pad for r in ok]).reshape(len(ok), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for p in range(parts):
            at = brute(x[:, p], books[p])[0]
            for e in set(at.tolist()):
                own = x[at == e, p]
                books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    found = [brute(x[:, p], books[p]) for p in range(parts)]
    error = sum(d for _, d in found)
    sums = {}
    for r, e in zip(ok, error.tolist()):
        sums[r[2]] = sums.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for c in books.ravel().tolist()).encode()).hexdigest()
    return [(r[0], "".join(f"{a[k]:02x}" for a, _ in found), int(error[k]), sums[r[2]], sha) for k, r in enumerate(ok)]


def test_compress(spark):
    rng = random.Random(4)
    vec = lambda n, s=1.0: [float(np.float32(rng.gauss(0, s))) for _ in range(n)]
    rows = [(rng.randrange(10**6), vec(10), rng.choice([0, 1, 2, None])) for _ in range(700)]
    rows += [(10**6 + k, rows[0][1], 5) for k in range(300)]  # copies
    rows += [(10**7, None, 1), (10**7 + 1, [], 1), (10**7 + 2, [1.0, None], 1), (10**7 + 3, [float("nan")] * 10, 1), (10**7 + 4, [float("inf")] * 10, 1), (10**7 + 5, vec(9), 1), (None, vec(10), None), (7, vec(10, 3000.0), 2), (7, vec(10), 2)]
    df = spark.createDataFrame([(*r, "code") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    got = sorted(map(tuple, v.compress(df).collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    few = rows[:5] + [(1, [0.5] * 10, 1)] * 3
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, v.compress(df).collect()), key=str) == sorted(plain(few), key=str)
    assert v.compress(df.limit(0)).collect() == [] and v.compress(df.where("vec_id < 0")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_decode_and_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = v.fit(df)
    back = v.decode(v.encode(df, books), books).collect()
    want = {i: np.floor(1024 * np.array(e)) for i, e, _ in rows}
    assert all(((np.array(r["decoded"]) * 1024 - want[r["vec_id"]]) ** 2).sum() == r["error"] for r in back) and len(back) == 200
    with pytest.raises(Exception, match="component of 370728"):
        v.compress(spark.createDataFrame([(1, [400000.0] * 8, 1)], "vec_id long, embedding array<double>, label int")).collect()
