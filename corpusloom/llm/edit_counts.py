"""Token counts that follow edits.

Each document keeps its pre-tokens, here words led by their white space, and the tokens of each, which are independent
of each other (see ``bpe``), in blocks under a binary tree with the sums of characters and tokens. An edit (position, characters to
delete, text to insert; positions are code points of the text as it is then) finds its blocks by descending the tree,
splits and encodes anew only the words it touches and one word of context on either side, puts them in place and adds
the difference to the sums above. Other words are never encoded again: a block that has grown large is split, and the
tree built anew over the stored sums.

Null text counts as empty; null edits are none. A position beyond the end means the end, below 0 the start; a null
position, length or insert counts as the end, 0 and nothing. Edits apply in the order of the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import Codec, codec, default_path

BLOCK = 64


class CountTree:
    def __init__(self, text: str, c: Codec):
        self.codec, self.encoded = c, 0
        words = c.words(text)
        tokens = self.counts(words) if words else []
        self.load([(words[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(words), BLOCK)] or [([], [])])

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each word; the literal of an added token can only be within one of them."""
        text = "".join(words)
        if any(t in text for t in self.codec.added):
            return [len(self.codec.encode(w)) for w in words]
        return list(map(len, self.codec.tuples(words)))

    def load(self, blocks: list[tuple[list[str], list[int]]]) -> None:
        """Build the tree over ``blocks`` of words and their tokens: node 1 is the root, the leaves are at ``size + k``."""
        self.blocks = blocks
        self.size = 1 << max(0, (len(blocks) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(blocks)] = [(len("".join(w)), sum(t)) for w, t in blocks]
        low = self.size
        while low > 1:
            level = self.sums[low : 2 * low]
            low //= 2
            self.sums[low : 2 * low] = level[::2] + level[1::2]

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` and the characters before that block."""
        node, before = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if at - before < left or not self.sums[2 * node + 1, 0]:
                node = 2 * node
            else:
                before, node = before + left, 2 * node + 1
        return node - self.size, before

    def put(self, k: int, words: list[str], tokens: list[int]) -> None:
        self.blocks[k] = words, tokens
        node = self.size + k
        change = np.array([len("".join(words)), sum(tokens)]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, at: int | None, delete: int | None, insert: str | None) -> None:
        at = self.chars if at is None else max(0, min(at, self.chars))
        end, insert = min(self.chars, at + max(0, delete or 0)), insert or ""
        k, start = self.find(max(0, at - 1))
        # words from one before the edit to one after it, as (block, place)
        first_words = self.blocks[k][0]
        i, pos = 0, start
        for w in first_words:
            if pos + len(w) >= at:
                break
            pos += len(w)
            i += 1
        if i:
            i -= 1
            pos -= len(first_words[i])
        elif k:
            k = next(q for q in range(k - 1, -1, -1) if self.blocks[q][0] or not q)
            words = self.blocks[k][0]
            i = max(0, len(words) - 1)
            pos = start - (len(words[i]) if words else 0)
        b, j, upto, old = k, i, pos, []
        while True:
            words = self.blocks[b][0]
            done = False
            while j < len(words):
                old.append(words[j])
                done, upto, j = upto > end, upto + len(words[j]), j + 1
                if done:
                    break
            if done or b + 1 >= len(self.blocks):
                break
            b, j = b + 1, 0
        text = "".join(old)
        new = self.codec.words(text[: at - pos] + insert + text[end - pos :])
        self.encoded += sum(map(len, new))
        tokens = self.counts(new) if new else []
        (head, head_tokens), (tail, tail_tokens) = self.blocks[k], self.blocks[b]
        if b == k:
            self.put(k, head[:i] + new + tail[j:], head_tokens[:i] + tokens + tail_tokens[j:])
        else:
            self.put(k, head[:i] + new, head_tokens[:i] + tokens)
            for q in range(k + 1, b):
                self.put(q, [], [])
            self.put(b, tail[j:], tail_tokens[j:])
        if len(self.blocks[k][0]) > 4 * BLOCK:
            words, tokens = self.blocks[k]
            self.load([*self.blocks[:k], *((words[q : q + BLOCK], tokens[q : q + BLOCK]) for q in range(0, len(words), BLOCK)), *self.blocks[k + 1 :]])

    def text(self) -> str:
        return "".join(w for b, _ in self.blocks for w in b)


def counts(docs: DataFrame, edits_col: str = "edits", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_chars_encoded`` of documents with an
    array of edits ``struct<at: long, del: long, ins: string>``. Narrow; a worker holds one document's tree at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for b in batches:
            rows = []
            for t, es in zip(b.column(1), b.column(2), strict=True):
                tree, es = CountTree(t.as_py() or "", c), [e for e in es.as_py() or [] if e]
                before = tree.tokens
                for e in es:
                    tree.edit(e["at"], e["del"], e["ins"])
                rows.append((before, len(es), tree.tokens, tree.chars, tree.encoded))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in cols)], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_chars_encoded"])

    return docs.select("doc_id", F.col(text_col).cast("string"), F.col(edits_col).cast("array<struct<at:bigint,del:bigint,ins:string>>")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_encoded long"
    )


def with_edits(docs: DataFrame, n: int = 4) -> DataFrame:
    """``n`` edits for each document, from its own id and text: places all over it, up to 40 characters out, a passage of up to 30 in."""
    one = lambda i: F.struct(
        F.pmod(F.xxhash64("doc_id", F.lit(i)), F.coalesce(F.length("text"), F.lit(0)) + 1).alias("at"),
        F.pmod(F.xxhash64("doc_id", F.lit(i + 100)), F.lit(41)).alias("del"),
        F.expr(f"substr(text, cast(1 + pmod(xxhash64(doc_id, {i + 200}), coalesce(length(text), 0) + 1) as int), cast(pmod(xxhash64(doc_id, {i + 300}), 31) as int))").alias("ins"),
    )
    return docs.withColumn("edits", F.array(*(one(i) for i in range(n))))
