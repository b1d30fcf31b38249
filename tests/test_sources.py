import json
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusloom.operators import search as se
from corpusloom.operators import tables as tb
from corpusloom.operators import terms as tm
from corpusloom.sources import readers as rd
from corpusloom.streaming import ingest, versions

VTT = "WEBVTT\n\n00:00:00.000 --> 00:00:05.000\nHello <b>there</b>\n\n00:00:05.000 --> 00:00:12.000\nsecond\nline\n\n00:00:12.000 --> 00:00:20.000\n\n"
SRT = "1\n0:00:01,500 --> 0:00:02,000\nuno\n\n2\n00:03,000 --> 00:04,000\ndos"


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/Transcript_abcdefghijk.vtt").write_text(VTT)
    (tmp_path / "t/b.srt").write_text(SRT)
    files = rd.text_folder(spark, str(tmp_path / "t"))
    cues = sorted(tuple(r) for r in rd.subtitles(files).collect())
    assert cues == [("Transcript_abcdefghijk", 0.0, 5.0, "Hello there"), ("Transcript_abcdefghijk", 5.0, 12.0, "second line"), ("b", 1.5, 2.0, "uno"), ("b", 3.0, 4.0, "dos")]
    assert [r.content_id for r in rd.content_files(spark, str(tmp_path / "t")).collect()] == ["youtube:abcdefghijk"]
    assert rd.parse_cues(None) == rd.parse_cues("") == []


def test_records(spark, tmp_path):
    (tmp_path / "r").mkdir()
    rec = {"documento": "./doc_analisis_completo.json", "terminos_clave": [["agentes", 8], [" Agentes", 3], ["de", 9], ["los", 4]], "sentimiento_global": {"polaridad": 0.5, "subjetividad": 0.1}}
    (tmp_path / "r/a.json").write_text(json.dumps(rec, indent=1))
    records = rd.analysis_records(spark, str(tmp_path / "r"))
    row = rd.analysis_table(records).first()
    assert (row.filename, row.nicho, row.total_segmentos, row.sentimiento_polaridad) == ("doc", "GENERAL", 0, 0.5)
    assert [tuple(r)[1:] for r in rd.exploded_terms(records, spark.createDataFrame([("los",)], "term string")).collect()] == [("agentes", 8)]


def test_csv_json_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Keyword,frecuencia\n1,x,5\n")
    (tmp_path / "b.csv").write_text("foo,bar\ny,7\n")
    assert [tuple(rd.term_csv(spark, str(tmp_path / f)).first()) for f in ("a.csv", "b.csv")] == [("x", 5), ("y", 7)]
    (tmp_path / "d.json").write_text(json.dumps({"base": {"es": ["De ", "la"]}, "nichos": {"X": {"es": ["de"]}}, "lex": {"bueno": {"pos": 1}}}))
    assert {(r.term, r.grupo) for r in rd.dictionary_terms(spark, str(tmp_path / "d.json"), "s").collect()} == {("de", "es"), ("la", "es"), ("bueno", "lex")}
    (tmp_path / "s.jsonl").write_text('{"video_id":"v","segment_id":1,"start":0.5,"text":"a"}\n\n{broken\n')
    assert rd.segment_lines(spark, str(tmp_path / "s.jsonl")).count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, x string")
    rd.write_csv(df, str(tmp_path / "c"))
    rd.write_parquet(df, str(tmp_path / "p"), ["x"])
    rd.write_records(df.select(F.struct("id", "x").alias("r")), str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.parquet(str(tmp_path / "p")).count() == spark.read.json(str(tmp_path / "j")).count() == 1


def test_incremental(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "content_id long, text string, arrived timestamp"

    def put(rows):
        spark.createDataFrame([(i, t, a) for i, t, a in rows], "content_id long, text string, a string").select("content_id", "text", F.col("a").cast("timestamp").alias("arrived")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        ingest.consolidate(stream, tm.term_counts, out, str(tmp_path / "ck"), 4).awaitTermination()
        return {(r.content_id, r.term, r.frequency) for r in versions.current(spark, out).collect()}

    assert put([(1, "uno dos", "2026-01-01"), (2, "tres", "2026-01-01"), (1, "viejo", "2025-01-01")]) == {(1, "uno", 1), (1, "dos", 1), (2, "tres", 1)}
    time.sleep(1.1)
    assert put([(1, "cuatro cuatro", "2026-01-02"), (2, "TRES ", "2026-01-02")]) == {(1, "cuatro", 2), (2, "tres", 1)}


def test_incremental_failures(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    asked = []

    def analyse(df):
        asked.extend(r.content_id for r in df.collect())
        return tm.term_counts(df)

    def put(rows, how=analyse):
        if rows:
            spark.createDataFrame(rows, "content_id long, text string, a string").select("content_id", "text", F.col("a").cast("timestamp").alias("arrived")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("content_id long, text string, arrived timestamp").parquet(src)
        ingest.consolidate(stream, how, out, str(tmp_path / "ck"), 2).awaitTermination()
        return {(r.content_id, r.term, r.frequency) for r in versions.current(spark, out).collect()}

    assert put([(1, "uno", "2026-01-01"), (2, "", "2026-01-01"), (3, "tres", "2026-01-01")]) == {(1, "uno", 1), (3, "tres", 1)}
    time.sleep(1.1)

    def broken(df):
        raise RuntimeError("analysis fails")

    with pytest.raises(StreamingQueryException):
        put([(1, "dos", "2026-01-02"), (2, "", "2026-01-02"), (3, "", "2026-01-02")], broken)
    with monkeypatch.context() as m:  # stops when all is written but nothing is there yet
        m.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(StreamingQueryException):
            put([])
    assert {(r.content_id, r.term, r.frequency) for r in versions.current(spark, out).collect()} == {(1, "uno", 1), (3, "tres", 1)}
    assert put([]) == {(1, "dos", 1)}
    with monkeypatch.context() as m:  # stops after the batch is there: it isn't done again
        m.setattr(versions, "compact", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        time.sleep(1.1)
        with pytest.raises(StreamingQueryException):
            put([(4, "mas", "2026-01-02")])
    asked.clear()
    assert put([]) == {(1, "dos", 1), (4, "mas", 1)} and asked == []
    time.sleep(1.1)
    assert put([(2, "", "2026-01-03"), (3, "", "2026-01-03")]) == {(1, "dos", 1), (4, "mas", 1)} and asked == []  # contents without rows are known too


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k long, v string")
    assert {tuple(r) for r in tb.replace_keys(old, new, "k").collect()} == {(1, "a"), (2, "c"), (2, "d"), (3, "e")}
    assert {r.k for r in tb.insert_or_ignore(old, new, ["k"]).collect()} == {1, 2, 3} and tb.insert_or_ignore(old, new, ["k"]).where("k = 2").first().v == "b"


def test_alignment(spark):
    chunks = spark.createDataFrame([("v", 0, "c0", "uno dos tres cuatro cinco seis siete"), ("v", 1, "c1", "Ocho nueve diez once doce trece!"), ("v", 2, "c2", "uno dos"), ("v", 3, "c3", "uno dos tres cuatro cinco seis")], "video_id string, posicion int, chunk_id string, texto string")
    cues = spark.createDataFrame([("v", 0.0, "uno dos tres"), ("v", 5.0, "cuatro cinco seis siete"), ("v", 9.0, "ocho nueve diez once doce"), ("v", 12.0, "trece")], "video_id string, inicio double, texto string")
    got = {r.chunk_id: (r.t_inicio, r.t_fin) for r in se.align(chunks, cues).collect()}
    assert got == {"c0": (0.0, 5.0), "c1": (9.0, 12.0), "c2": (None, None), "c3": (None, None)}


def test_alignment_in_runs(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4)]
    cues, chunks, want = [], [], {}
    for v in range(6):
        said = [[rng.choice(words) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
        cues += [(f"v{v}", 3.0 * k, " ".join(ws)) for k, ws in enumerate(said)]
        stream = [(w, 3.0 * k) for k, ws in enumerate(said) for w in ws]
        at = 1
        for c in range(40):
            k = rng.randrange(len(stream)) if c % 5 == 0 else min(len(stream) - 1, 6 * c)
            text = [w for w, _ in stream[k : k + rng.choice([3, 6, 6, 9])]]
            chunks.append((f"v{v}", c, f"v{v}-{c}", " ".join(text)))
            hit = next((i for i in range(at, len(stream) - 4) if len(text) >= 6 and [w for w, _ in stream[i - 1 : i + 5]] == text[:6]), None)
            want[f"v{v}-{c}"] = (None, None) if hit is None else (stream[hit - 1][1], stream[hit + 4][1])
            at = hit or at
    a = spark.createDataFrame(chunks, "video_id string, posicion int, chunk_id string, texto string")
    b = spark.createDataFrame(cues, "video_id string, inicio double, texto string")
    for run in (50_000, 7):
        assert {r.chunk_id: (r.t_inicio, r.t_fin) for r in se.align(a, b, run=run).collect()} == want
    assert {(r.t_inicio, r.t_fin) for r in se.align(a, b.limit(0)).collect()} == {(None, None)}
    aligned = spark.createDataFrame([("a", 14.0), ("b", None)], "chunk_id string, t_inicio double")
    own = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, video_id string")
    times = spark.createDataFrame([(v, 10.0 * k, 10.0 * k + 10) for v in ("x", "y") for k in range(10)], "video_id string, inicio double, fin double")
    points = se.track_offsets(own, aligned, times)
    assert {r.inicio: (r.offset_seconds, r.validado) for r in points.where("video_id = 'x'").collect()} == {0.0: (14.0, True), 20.0: (-6.0, True), 50.0: (None, False), 70.0: (None, False), 90.0: (None, False)}
    assert {r.video_id: r.status for r in se.sync_status(points).collect()} == {"x": "not_for_navigation", "y": "failed"}
