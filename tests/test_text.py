from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_accents_keep_tilde_n(spark):
    for a, b in (("año", "año"), ("canción", "cancion"), ("Ñandú", "Ñandu"), ("naïve", "naive"), ("Müller", "Muller"), ("čeština", "cestina"), (None, None), ("", "")):
        assert one(spark, a, tx.strip_accents) == b
    assert one(spark, "ño á", tx.normalize) == "no a"
    assert one(spark, "año", lambda c: tx.strip_accents(c, False)) == "ano"


def test_terms(spark):
    assert one(spark, "El niño corrió 3km por el PARQUE_1, café; sí el parque", tx.terms) == ["corrio", "por", "cafe", "parque"]
    assert one(spark, None, tx.terms) is None and one(spark, "", tx.terms) == []


def test_search_tokens(spark):
    assert one(spark, '¿Los "autos" de las ciudades? a es luces', tx.search_tokens) == ["los", "auto", "de", "las", "ciudad", "es", "luc"]


def test_snippet_and_highlight(spark):
    assert one(spark, "short", tx.snippet) == "short"
    assert one(spark, "a" * 100, tx.snippet) == "a" * 70 + "…"
    assert one(spark, "b" * 60 + " " + "c" * 60, tx.snippet) == "b" * 60 + "…"
    assert one(spark, "The CAT (a cat)", lambda c: tx.highlight(c, "a cat (a")) == "The <<CAT>> (a <<cat>>)"


def test_times(spark):
    assert [one(spark, v, tx.clock, "double") for v in (0.0, 5.9, 3723.0)] == ["00:00:00", "00:00:05", "01:02:03"]
    assert [one(spark, v, tx.short_clock, "double") for v in (None, -1.0, 65.0, 3600.0)] == ["?", "?", "01:05", "01:00:00"]
    assert [one(spark, v, tx.seconds) for v in ("01:05", "1:00:05", "x", "1:2:3:4", None, "5")] == [65, 3605, None, None, None, None]


def test_identity(spark):
    same = ["https://www.youtube.com/watch?v=abcdefghijk&t=4", "https://youtu.be/abcdefghijk?x=1", "http://m.youtube.com/shorts/abcdefghijk"]
    assert {one(spark, u, tx.content_id) for u in same} == {"youtube:abcdefghijk"}
    assert one(spark, "https://github.com/u/r/issues", tx.content_id) == one(spark, "https://www.github.com/u/r.git", tx.content_id) == "github:u/r"
    assert one(spark, " text ", tx.content_id) == one(spark, "text", tx.content_id)
    assert one(spark, "Transcript_abcdefghijk_es.txt", tx.video_id) == "abcdefghijk" and one(spark, "nothing", tx.video_id) is None
    assert one(spark, " A  b\n", tx.text_hash) == one(spark, "a B", tx.text_hash) and one(spark, "  ", tx.text_hash) == ""
    assert one(spark, "a", lambda c: tx.change_hash(c, F.lit(1))) != one(spark, "a", lambda c: tx.change_hash(c, F.lit(2)))


def test_clean(spark):
    assert one(spark, " [note] a &amp; b\n\n\n\nc [x\ny] ", tx.clean) == "a  b\n\nc [x\ny]"
    assert one(spark, None, tx.clean) is None
    assert one(spark, r"\section{Hi} $x_1$", tx.latex_text) == "Hi x 1"
