"""BPE encoding and decoding with forced boundaries.

A byte pair that stands inside no vocabulary token can never be merged, so a cut between its two bytes is certain. A
text is cut at these places, each fragment is encoded alone, and the ids are put together. Two levels keep this exact:

* A run of white space followed by a run of other characters is one word. A pre-token never reaches over the place
  where white space follows another character, so words are independent and repeat often; they are looked up.
* A word not seen before goes through the pre-tokenizer and is cut at every certain byte pair; the model encodes the
  fragments.

Null text counts as empty; an empty text has no tokens. The literal of an added token in a text is that token, as in
the tokenizers library. Truncation and padding of the file are not applied.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The code points with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words, and fragments, kept in a worker's tables before they are emptied; those of LONG characters or more aren't kept.
TABLE_WORDS = 300_000
LONG = 200
#: Words counted at a time, and lengths of words kept: workers of a pipeline have other tables too.
MANY = 50_000
KNOWN_WORDS = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Words to ids by a table that is filled on demand."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        whole = Tokenizer.from_file(path)
        self.model, self.pre = whole.model, whole.pre_tokenizer
        self.letters = byte_letters()
        byte_of = {c: b for b, c in self.letters.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: bytes(map(byte_of.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
        self.inside = np.zeros((256, 256), bool)
        for t in self.tokens.values():
            for a, b in zip(t, t[1:], strict=False):
                self.inside[a, b] = True
        self.outside = ~self.inside
        self.certain = frozenset(zip(*map(np.ndarray.tolist, np.nonzero(self.outside)), strict=True))
        self.bytes_of = str.maketrans({c: chr(b) for c, b in byte_of.items()})
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        self.digits = {i: str(i) for i in self.tokens}
        self.words = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split if self.added else lambda t: [t]
        #: Line end, Latin letters with the space before them, signs: where they follow each other so, each is one pre-token.
        self.plain = re.compile(r"(\n?)( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)").fullmatch
        self.ids = list(range(max(self.tokens) + 1))  # one object for each id
        self.table: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[str, tuple[int, ...]] = {}
        self.held = KNOWN_WORDS
        self.known: dict[str, int] = {}
        self.known_before: dict[str, int] = {}

    def model_ids(self, fragment: str) -> tuple[int, ...]:
        ids = self.fragments.get(fragment)
        if ids is None:
            ids = tuple([self.ids[t.id] for t in self.model.tokenize(fragment)])
            if len(fragment) < LONG:
                self.fragments[fragment] = ids
        return ids

    def cut(self, piece: bytes) -> list[str]:
        """The fragments of one pre-token."""
        text = piece.decode("latin-1").translate(self.letters)
        if len(piece) > LONG:
            b = np.frombuffer(piece, np.uint8)
            at = (np.flatnonzero(self.outside[b[:-1], b[1:]]) + 1).tolist()
        else:
            at = [i for i, pair in enumerate(zip(piece, piece[1:], strict=False), 1) if pair in self.certain]
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]

    def cut_all(self, words: list[str]) -> tuple[list[tuple[int, ...]], list[int]]:
        """The ids of the fragments of ``words`` in order, and the number of fragments up to the end of each word."""
        if len(words) < 8:
            ids, ends = [], []
            for w in words:
                m = self.plain(w)
                raw = [x.encode() for x in m.groups() if x] if m else [p.translate(self.bytes_of).encode("latin-1") for p, _ in self.pre.pre_tokenize_str(w)]
                ids += map(self.model_ids, chain.from_iterable(map(self.cut, raw)))
                ends.append(len(ids))
            return ids, ends
        raw, pieces = [], []  # all pre-tokens as one run of bytes, cut at every certain pair and between pre-tokens
        for w in words:
            m = self.plain(w)
            own = [x for x in m.groups() if x] if m else [p.translate(self.bytes_of) for p, _ in self.pre.pre_tokenize_str(w)]
            raw += [x.encode() for x in own] if m else [x.encode("latin-1") for x in own]
            pieces.append(len(own))
        data = b"".join(raw)
        ends = np.cumsum([len(b) for b in raw])
        b = np.frombuffer(data, np.uint8)
        cut = self.outside[b[:-1], b[1:]]
        cut[ends[:-1] - 1] = True
        bounds = np.append(np.flatnonzero(cut) + 1, len(b))
        text = data.decode("latin-1").translate(self.letters)
        at = bounds.tolist()
        ids = [self.model_ids(text[i:j]) for i, j in zip([0, *at], at, strict=False)]
        return ids, np.searchsorted(bounds, ends[np.cumsum(pieces) - 1], "right").tolist()

    def learn(self, words: list[str]) -> None:
        """Put the ids of ``words`` into the table."""
        ids, ends = self.cut_all(words)
        for w, p, q in zip(words, [0, *ends], ends, strict=False):
            self.table[w] = ids[p] if q - p == 1 else tuple(chain.from_iterable(ids[p:q]))

    def tuples(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word. The table has two generations, so that frequent words stay when it is full."""
        table, new = self.table, list(set(words).difference(self.table))
        if new:
            if self.older:
                table |= {w: self.older[w] for w in new if w in self.older}
                new = [w for w in new if w not in table]
            if new:
                self.learn(new)
        out = list(map(table.__getitem__, words))
        for w in new:
            if len(w) >= LONG:
                del table[w]
        if len(table) > TABLE_WORDS:
            self.table, self.older = {}, table
        if len(self.fragments) > TABLE_WORDS:
            self.fragments.clear()
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for part in self.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += chain.from_iterable(self.tuples(self.words(part)))
        return out

    def sizes(self, words: list[str]) -> np.ndarray:
        """The number of ids of each word; a table of its own, again of two generations."""
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if self.known_before:
                known |= {w: self.known_before[w] for w in new if w in self.known_before}
                new = [w for w in new if w not in known]
            if new:
                ids, ends = self.cut_all(new)
                upto = np.cumsum([0, *map(len, ids)])[[0, *ends]]
                known.update(zip(new, np.diff(upto).tolist(), strict=True))
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) >= LONG:
                del known[w]
        if len(known) > self.held:
            self.known, self.known_before = {}, known
        if len(self.fragments) > self.held:
            self.fragments.clear()
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text; words new to the table are learnt for many texts at once."""
        out, words, sizes, at = [0] * len(texts), [], [], []

        def settle() -> None:
            if sizes:
                for i, n in zip(at, np.add.reduceat(self.sizes(words), np.cumsum([0, *sizes[:-1]])).tolist(), strict=True):
                    out[i] += n
            words.clear(), sizes.clear(), at.clear()

        for i, t in enumerate(texts):
            for part in self.split(t) if t else ():
                if part in self.added:
                    out[i] += 1
                elif part:
                    own = self.words(part)
                    words.extend(own)
                    sizes.append(len(own))
                    at.append(i)
            if len(words) > MANY:
                settle()
        settle()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode each whole text, then decode its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
