import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import versions as vs

SLOTS = 8


def put(spark, path, contents, number, stream="s"):
    """A batch of ``{content_id: [values]}``; its hash is its values."""
    rows = spark.createDataFrame([(i, v) for i, xs in contents.items() for v in xs], "content_id long, v string").withColumn("slot", vs.slot_of(F.col("content_id"), SLOTS))
    lines = spark.createDataFrame([(i, "".join(xs)) for i, xs in contents.items()], "content_id long, hash string").withColumn("slot", vs.slot_of(F.col("content_id"), SLOTS))
    vs.append(spark, path, rows, lines, sorted({r.slot for r in lines.collect()}), stream, number)


def table(spark, path):
    got = {}
    for r in vs.current(spark, path).collect():
        got.setdefault(r.content_id, []).append(r.v)
    return {i: sorted(xs) for i, xs in got.items()}


def written(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_latest_version_wins(spark, tmp_path):
    path, want, rng = str(tmp_path / "t"), {}, random.Random(2)
    assert vs.state(spark, path)["version"] == 0 and vs.known(spark, path, [0]) is None and vs.compact(spark, path) == []
    for n in range(6):
        batch = {rng.randrange(40): [f"{n}-{k}" for k in range(rng.randrange(4))] for _ in range(12)}
        put(spark, path, batch, n)
        want |= batch
        assert table(spark, path) == {i: sorted(xs) for i, xs in want.items() if xs}
    assert {r.content_id: r.hash for r in vs.known(spark, path, list(range(SLOTS))).collect()} == {i: "".join(xs) for i, xs in want.items()}
    assert vs.state(spark, path)["streams"] == {"s": 5}


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, {i: ["x" * 50 + str(i * 7919 + k) for k in range(20)] for i in range(3000)}, 0)
    whole = written(path)
    put(spark, path, {i: ["new"] for i in range(3)}, 1)
    small = written(path) - whole
    put(spark, path, {i: ["x" * 50 + str(i * 104729 + k) for k in range(20)] for i in range(300)}, 2)
    tenth = written(path) - whole - small
    assert small < whole / 20 and small < tenth < whole / 4


def test_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, {i: [f"a{i}", f"b{i}"] for i in range(200)}, 0)
    put(spark, path, {i: [f"c{i}"] for i in range(10)} | {11: []}, 1)
    assert vs.compact(spark, path, share=0.5) == []
    for n in range(2, 5):
        put(spark, path, {i: [f"n{n}{i}", f"m{n}{i}"] for i in range(100)}, n)
    before = table(spark, path)
    with monkeypatch.context() as m:
        m.setattr(vs, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            vs.compact(spark, path, share=0.5)
    assert table(spark, path) == before
    assert vs.compact(spark, path, share=0.4) == list(range(SLOTS)) and table(spark, path) == before
    assert all(len(v) == 1 for v in vs.state(spark, path)["live"].values()) and vs.compact(spark, path, share=0.4) == []
    put(spark, path, {5: ["after"]}, 5)
    assert table(spark, path) == before | {5: ["after"]}
    size = written(path)
    assert vs.vacuum(spark, path) > 0 and written(path) < size / 1.5 and table(spark, path) == before | {5: ["after"]}
    assert len(list(Path(path, "log").glob("[0-9]*"))) == 1
    put(spark, path, {6: []}, 6)
    assert table(spark, path) == {i: x for i, x in (before | {5: ["after"]}).items() if i != 6}


def test_many_versions_of_a_slot(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(5):
        put(spark, path, {n: [f"v{n}"]}, n)
    assert vs.compact(spark, path, most=5) == []
    assert all(len(v) <= 2 for v in vs.state(spark, path)["live"].values()) or vs.compact(spark, path, most=2)
    for n in range(5, 9):
        put(spark, path, {1: [f"w{n}"]}, n)
    slot = next(int(k) for k, v in vs.state(spark, path)["live"].items() if len(v) > 3)
    assert slot in vs.compact(spark, path, share=2.0, most=3) and table(spark, path)[1] == ["w8"]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, {1: ["a"]}, 0)
    with pytest.raises(RuntimeError):
        vs.commit(spark, path, vs.state(spark, path))
    put(spark, path, {1: ["b"]}, 0, "other")
    assert table(spark, path) == {1: ["b"]} and vs.state(spark, path)["streams"] == {"s": 0, "other": 0}
