import random

from corpusloom.llm import bpe
from corpusloom.llm.edit_counts import CountTree, counts, with_edits


def full(c, t):
    return len(c.encode(t))


def test_random_edits_equal_full_counts():
    c = bpe.codec(bpe.default_path())
    rng = random.Random(5)
    bits = ["word", " ", "  ", "\n", "'s", "don't", "é", "12", "!", "<|endoftext|>", "<|end", "oftext|>", "　", "x" * 50]
    for _ in range(60):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.choice([0, 1, 5, 60, 900])))
        tree = CountTree(text, c)
        assert tree.tokens == full(c, text)
        for _ in range(25):
            at, cut = rng.randint(0, len(text) + 3), rng.choice([0, 1, 3, 30, 600])
            ins = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 4, 300])))
            tree.edit(at, cut, ins)
            text = text[:at] + ins + text[at + cut :]
            assert tree.text() == text and tree.chars == len(text)
            assert tree.tokens == full(c, text), (text, at, cut, ins)


def test_only_the_region_is_encoded():
    c = bpe.codec(bpe.default_path())
    tree = CountTree("many words here " * 5000, c)
    tree.edit(40_000, 3, "new")
    assert tree.encoded < 60


def test_cases(spark):
    rows = [(1, "a b c", [(1, 1, "xx"), (99, 5, " end"), (None, None, None)], 0), (2, None, None, 0), (3, "", [(0, 0, "new text")], 0), (4, "dup", [], 0), (4, "dup", [], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:long,del:long,ins:string>>, n_tokens int")
    got = sorted(tuple(r) for r in counts(df).collect())
    c = bpe.codec(bpe.default_path())
    assert got[0][:5] == (1, 3, 3, full(c, "axxb c end"), 10)
    assert got[1] == (2, 0, 0, 0, 0, 0) and got[2][:5] == (3, 0, 1, 2, 8) and got[3] == got[4]
    assert counts(df.limit(0)).count() == 0


def test_query_equals_full_recount(spark):
    df = with_edits(spark.createDataFrame([(i, f"Some text {i} with words, " * (i + 1)) for i in range(8)], "doc_id long, text string"))
    got = {r.doc_id: r for r in counts(df).collect()}
    c = bpe.codec(bpe.default_path())
    for r in df.collect():
        t = r.text
        for e in r.edits:
            t = t[: e["at"]] + e["ins"] + t[e["at"] + e["del"] :]
        assert got[r.doc_id].n_tokens_after == full(c, t) and got[r.doc_id].n_tokens == full(c, r.text)
