"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on windows of ordinary documents, one on the windows of toxic documents
around toxic spots, the places that hold a character n-gram (6 to 10) leaning to toxic documents by frequency ratio and
log-likelihood. Copies count once. A toxic text is ordinary language and more, so its side holds the ordinary dictionary and the
toxic one behind it; the ordinary side holds the ordinary one at the same distance. The text is cut into windows of ``WINDOW``
words, each led to a fixed passage that both sides hold (a shorter frame would be stored as it is), and the margin of
a window is its compressed length on the ordinary side less that on the toxic side. A window has the same margin
wherever it stands, so each is compressed once for many texts.

The thresholds are calibrated: for each margin of ``MARGINS`` the share of windows that reach it in ordinary documents the dictionaries
haven't seen says how many a text of that length has by chance. A document's score comes from how far its number of
windows exceeds that, how many different ones reach each margin, and the highest sums of margins over longer runs of its windows
(``RUNS``), by a logistic function fitted on the same unseen labelled rows, in which a toxic row counts ``WEIGHT``
times; ``predicted`` is 1 from ``THRESHOLD`` on.

Labels are used only of rows whose crc32(doc_id) mod 3 is not 1: remainder 0 for the dictionaries, 2 for the
calibration. Of each, at most ``TOXIC_ROWS`` toxic and ``ORDINARY_ROWS`` ordinary documents of at most ``ROW_CHARS``
characters are read, in hash order. Scoring reads every whole text. Null text counts as empty; a text without words has
the score of a document without evidence. Null labels are ignored; a document labelled both ways counts as toxic.
Without toxic labels no window has a margin and every score is the base rate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import trimmed

THRESHOLD = 0.7
TOXIC_ROWS = 1500
ORDINARY_ROWS = 3000
ROW_CHARS = 10_000
WINDOW = 1
#: Margins that are counted, lengths of runs of windows, weight of toxic rows, ridge of the logistic fit.
MARGINS, RUNS, WEIGHT, RIDGE = (1, 2, 3, 4, 5, 6, 8), (8, 32, 128), 2.0, 0.3
#: Windows whose margin a worker keeps.
HELD = 100_000
#: Sizes of the trained dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 8 << 10
#: Lengths of the n-grams that find toxic passages; how much more frequent in toxic documents; least log-likelihood.
GRAMS = range(6, 11)
RATIO, LIKELIHOOD = 10, 15
LEAD, TAIL = 64, 32
COVER = dict(d=6, k=16)
#: Windows in a sample that the toxic dictionary is trained on.
JOINED = 4
PARAMETERS = dict(strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=5, target_length=64, write_content_size=False, write_dict_id=False, write_checksum=False)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    lead: bytes
    window: int = WINDOW
    #: Shares of ordinary windows that reach each of MARGINS.
    shares: tuple[float, ...] = (0.0,) * len(MARGINS)
    weights: tuple[float, ...] = ()

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))

    def features(self, ws: list[str], m: np.ndarray) -> list[float]:
        """Of the windows of a text and their margins: excess, number and different windows at each margin, highest sums of runs."""
        n = len(m)
        counts = [int((m >= k).sum()) for k in MARGINS]
        over = [(c - n * p) / math.sqrt(n * p + 1) for c, p in zip(counts, self.shares)]
        different = [len({ws[i] for i in np.flatnonzero(m >= k)}) for k in MARGINS[1:5]]
        total = np.concatenate([[0], np.cumsum(m)])
        runs = [int((total[min(r, n) :] - total[: n + 1 - min(r, n)]).max()) for r in RUNS]
        return [1.0, *(math.copysign(math.log1p(abs(x)), x) for x in over), *(math.log1p(max(0, x)) for x in (*counts, *runs, *different))]


def windows(text: str | None, n: int) -> list[str]:
    words = (text or "").lower().split()
    return words if n == 1 else [" ".join(words[i : i + n]) for i in range(0, len(words), n)]


class Meter:
    """Margins of the windows of a text."""

    def __init__(self, model: Model):
        self.model = model
        self.compressors = [self.compressor(d) for d in (model.ordinary, model.toxic)]
        self.known: dict[str, int] = {}

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        p = zstandard.ZstdCompressionParameters(**PARAMETERS)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def _measure(self, ws: list[str]) -> np.ndarray:
        if not ws or self.model.toxic == self.model.ordinary:
            return np.zeros(len(ws), np.int64)
        framed = [b" " + x.encode() + b" " + self.model.lead for x in ws]
        a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(framed)), np.int64, len(ws)) for c in self.compressors)
        return a - b

    def measured(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The margins of texts given as windows."""
        if len(self.known) > HELD:
            self.known.clear()
        new = list({w for ws in texts for w in ws} - self.known.keys())
        for i in range(0, len(new), 10_000):
            self.known.update(zip(new[i : i + 10_000], self._measure(new[i : i + 10_000]).tolist()))
        return [np.array([self.known[w] for w in ws], np.int64) for ws in texts]

    def margins(self, text: str | None) -> np.ndarray:
        return self.measured([windows(text, self.model.window)])[0]

    def features(self, texts: Iterable[str | None], at_once: int = 100) -> np.ndarray:
        out, texts = [], iter(texts)
        while part := [windows(t, self.model.window) for t in islice(texts, at_once)]:
            out += [self.model.features(ws, m) for ws, m in zip(part, self.measured(part))]
        return np.array(out)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        x = self.features(texts)
        return self.model.score(x) if len(x) else np.zeros(0)


@cache
def meter(model: Model) -> Meter:
    return Meter(model)


def without_copies(texts: Iterable[str]) -> list[str]:
    """The texts of which at most half of the word triples stood in an earlier one."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = t.lower().split()
        triples = {hash(tuple(w[i : i + 3])) for i in range(max(1, len(w) - 2))}
        if 2 * len(triples & seen) <= len(triples):
            seen |= triples
            out.append(t)
    return out


def _grams(word: str, n: int) -> list[str]:
    return [word[i : i + n] for i in range(max(1, len(word) - n + 1))]


def _log_likelihood(k: int, n: int, j: int, m: int) -> float:
    p = (k + j) / (n + m)
    part = lambda k, n: (k * math.log(k / n / p) if k else 0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n - k else 0)
    return 2 * (part(k, n) + part(j, m))


def leaning(toxic: list[set[str]], ordinary: list[set[str]]) -> set[str]:
    """n-grams that lean to toxic documents, given as sets of padded words; one length at a time bounds the tables."""
    n, m, out = max(1, len(toxic)), max(1, len(ordinary)), set()
    for size in GRAMS:
        here: Counter[str] = Counter()
        for words in toxic:
            here.update({g for w in words for g in _grams(w, size)})
        here = Counter({g: k for g, k in here.items() if k > 2})
        there: Counter[str] = Counter()
        met: dict[str, list[str]] = {}
        for words in ordinary:
            found = set()
            for w in words:
                if w not in met:
                    met[w] = [g for g in _grams(w, size) if g in here]
                found.update(met[w])
            there.update(found)
        out |= {g for g, k in here.items() if k / n > RATIO * (there[g] + 0.5) / (m + 1) and _log_likelihood(k, n, there[g], m) >= LIKELIHOOD}
    return out


def spots(toxic: list[str], ordinary: list[str], window: int = WINDOW) -> list[str]:
    """The windows of toxic documents around their toxic spots, in text order."""
    padded = lambda t: {f" {w} " for w in t.lower().split()}
    lean = leaning([padded(t) for t in toxic], [padded(t) for t in ordinary])
    known: dict[str, bool] = {}

    def leans(word: str) -> bool:
        if word not in known:
            known[word] = any(g in lean for n in GRAMS for g in _grams(f" {word} ", n))
        return known[word]

    return [f" {w} " for t in toxic for w in windows(t, window) if any(map(leans, w.split()))]


def dictionary(samples: list[bytes], size: int, **cover: int) -> bytes:
    """A trained dictionary; of samples too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, **cover).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))


def train(toxic: list[str], ordinary: list[str], window: int = WINDOW) -> Model:
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)
    base = dictionary([f" {w} ".encode() for t in ordinary for w in windows(t, 3)], ORDINARY_BYTES).rjust(LEAD + TAIL, b" ")
    found = [s.encode() for s in spots(toxic, ordinary, window)]
    extra = dictionary([b"".join(found[i : i + JOINED]) for i in range(0, len(found), JOINED)], TOXIC_BYTES, **COVER) if found else b""
    tail = base[-TAIL:]  # a dictionary's last bytes can't begin a match
    return Model(base + bytes(len(extra)) + tail, base + extra + tail, base[-LEAD - TAIL : -TAIL], window)


def calibrate(model: Model, toxic: list[str], ordinary: list[str]) -> Model:
    """Shares of ordinary windows at each margin; logistic weights by Newton's method with a small ridge."""
    m = Meter(model)
    plain = np.concatenate([*(m.margins(t) for t in ordinary), np.zeros(1, np.int64)])
    model = m.model = replace(model, shares=tuple(float((plain >= k).mean()) for k in MARGINS))
    x = m.features([*toxic, *ordinary] or [None])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary) or [0.0])
    c = np.where(y > 0, WEIGHT, 1.0)
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (c * (p - y)) + ridge @ w)
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return replace(model, weights=tuple(w.tolist()))


def fold(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3


def fit(docs: DataFrame, labels: DataFrame, window: int = WINDOW) -> Model:
    """Train and calibrate on bounded samples; the driver reads at most 2 * (TOXIC_ROWS + ORDINARY_ROWS) texts."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).withColumn("fold", fold()).where("fold <> 1")
    parts = [known.where(F.col("fold").eqNullSafe(k) & (F.col("toxic") == t)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k in (0, 2) for t, n in ((True, TOXIC_ROWS), (False, ORDINARY_ROWS))]
    ids = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    texts = docs.select("doc_id", "text").where(F.length("text") <= ROW_CHARS).join(F.broadcast(ids), "doc_id").select("fold", "toxic", "text").distinct()  # the ids are few by the bounds above
    rows = sorted(tuple(r) for r in texts.toLocalIterator())
    of = lambda k, t: [r[2] for r in rows if r[0] == k and r[1] == t]
    return calibrate(train(of(0, True), of(0, False), window), of(2, True), of(2, False))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``docs`` columns (or only those in ``carry``), and ``toxicity_score`` double and ``toxicity_predicted`` int. Narrow."""
    names = docs.columns if carry is None else carry
    free = lambda n: n if n not in names else free(n + "_")
    new = [free("toxicity_score"), free("toxicity_predicted")]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = T.StructType([*kept.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.IntegerType())])
    whole = docs.select(F.col("text").cast("string").alias("__text"), *(F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = meter(model)
        for b in trimmed(batches):
            s = m.score(t.as_py() for t in b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], [*b.schema.names[1:], *new])

    return whole.mapInArrow(run, schema)
