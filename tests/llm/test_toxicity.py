import math
import random
import zlib

import numpy as np
import zstandard

from corpusloom.llm import toxicity

BAD = ["grumblewort", "snarfle", "blatherskite", "nitwit"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([8, 40, 400]))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(BAD))
        docs.append((i, " ".join(t), "x", 1.0))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus(900)
    d = spark.createDataFrame([*docs, (9001, None, "x", 0.0), (9002, "", "x", 0.0), (9003, "ab " * 200_000, "x", 0.0), (9003, "dup", "x", 0.0), (9003, "dup", "x", 0.0)], "doc_id long, text string, toxic string, toxicity_score double")
    lab = spark.createDataFrame([*labels, (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    rows = toxicity.score(d, model).collect()
    assert len(rows) == 905 and "toxicity_score_" in rows[0]
    truth = dict(labels)
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(truth[r.doc_id] == r.toxicity_predicted for r in held) / len(held) > 0.97
    assert all(0 <= r.toxicity_score_ <= 1 for r in rows)
    assert all(r.toxicity_predicted == 0 for r in rows if r.doc_id > 9000)


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n double")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = (toxicity.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a == b


def test_without_labels(spark):
    docs, _ = corpus(20)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n double")
    model = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.toxicity_predicted == 0 for r in toxicity.score(d, model).collect())
    assert toxicity.score(d.limit(0), model).count() == 0


def test_copies_count_once():
    text = " ".join(f"w{i}" for i in range(50))
    assert toxicity.without_copies([text, text + " tail", "other words here", text]) == [text, "other words here"]


def test_margins_lean_to_toxic_windows():
    docs, labels = corpus(600)
    of = lambda k: [t for (_, t, *_), (_, bad) in zip(docs, labels) if bad == k]
    model = toxicity.calibrate(toxicity.train(of(1)[:60], of(0)[:240]), of(1)[60:], of(0)[240:])
    m = toxicity.Meter(model)
    assert m.margins("snarfle blatherskite grumblewort").max() > max(m.margins(t).max() for t in of(0)[:50])
    assert len(m.margins("a b c d e f g")) == 7 and len(m.margins(None)) == 0 and model.ordinary != model.toxic


def test_margins_by_plain_calls():
    """Margins and features against one plain compression call for each window."""
    docs, labels = corpus(400)
    of = lambda k: [t for (_, t, *_), (_, bad) in zip(docs, labels) if bad == k]
    for window in (1, 3):
        model = toxicity.calibrate(toxicity.train(of(1)[:50], of(0)[:150], window), of(1)[50:], of(0)[150:])
        p = zstandard.ZstdCompressionParameters(**toxicity.PARAMETERS)
        size = lambda content, x: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p).compress(x))
        texts = [None, "", *of(1)[:6], *of(0)[:6]]
        meter = toxicity.Meter(model)
        for t in texts:
            words = (t or "").lower().split()
            ws = [" ".join(words[i : i + window]) for i in range(0, len(words), window)]
            want = [size(model.ordinary, b" " + w.encode() + b" " + model.lead) - size(model.toxic, b" " + w.encode() + b" " + model.lead) for w in ws]
            assert meter.margins(t).tolist() == want
            x = model.features(ws, np.array(want, np.int64))
            over = [(sum(m >= k for m in want) - len(want) * s) / math.sqrt(len(want) * s + 1) for k, s in zip(toxicity.MARGINS, model.shares)]
            runs = [max((sum(want[i : i + r]) for i in range(max(1, len(want) - r + 1))), default=0) for r in toxicity.RUNS]
            different = [len({w for w, m in zip(ws, want) if m >= k}) for k in toxicity.MARGINS[1:5]]
            counts = [sum(m >= k for m in want) for k in toxicity.MARGINS]
            assert np.allclose(x, [1, *(math.copysign(math.log1p(abs(v)), v) for v in over), *(math.log1p(max(0, v)) for v in (*counts, *runs, *different))])
            assert abs(meter.score([t])[0] - 1 / (1 + math.exp(-np.clip(np.dot(x, model.weights), -30, 30)))) < 1e-12


def test_spots_are_windows_of_toxic_documents():
    docs, labels = corpus(400)
    of = lambda k: [t for (_, t, *_), (_, bad) in zip(docs, labels) if bad == k]
    found = toxicity.spots(of(1), of(0), 3)
    assert found and all(any(b in w for b in BAD) for w in found) and all(w.strip() in t for w, t in zip(found[:1], of(1)))
