import hashlib

from corpusloom.llm import bpe

TEXTS = [None, "", " ", "  a  b\n\n c ", "don't stop'd ’s", "x<|endoftext|>y <|endoftext|>", "café   naïve 　ß", "\U0001f600\U0001f468‍\U0001f469 emoji", "a" * 5000, "1234567890 12,5% !!\x1c!! \x1f", "trailing   ", "\t\ttabs\r\n", "ab " * 20000, "'tis 're're ''s"]


def test_equals_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    for i, x in enumerate(TEXTS):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids[i] == want, x
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_cuts_are_certain():
    c = bpe.codec(bpe.default_path())
    assert not any(c.inside[b, 32] for b in range(33, 128))
    assert all(c.inside[a, b] for t in c.tokens.values() if t != b"<|endoftext|>" for a, b in zip(t, t[1:]))


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
