"""Streams against batches, and files written and read again."""

import json
import struct

import pytest

from pyspark.sql import functions as F

from millrace.operators import analytics as A
from millrace.sources import audio, index_files
from millrace.streaming import requests as S
from millrace.streaming.frames import parse_frames

SCHEMA = "request_id string, created_at string, total_latency_ms double, status string, client string"


def rows(n):
    return [(f"r{i}", f"2025-01-01T{i // 60:02d}:{i % 60:02d}:30+05:30", float(i), "answered" if i % 3 else "blocked", "c") for i in range(n)]


def stream(spark, tmp_path, batches):
    folder = tmp_path / "in"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_hourly_stream_equals_batch_on_closed_hours(spark, tmp_path):
    log = rows(300)
    source = stream(spark, tmp_path, [log + log[:20]])
    got = {r["hour"]: (r["requests"], r["average_ms"]) for r in run(S.hourly(S.with_event_time(source)), "hourly", "append", tmp_path).collect()}
    batch = spark.createDataFrame(log, SCHEMA)
    want = {r["hour"]: (r["requests"], r["average_ms"]) for r in A.hourly_throughput(batch).collect()}
    assert got and all(want[h.strftime("%Y-%m-%dT%H:00")] == v for h, v in got.items())


def test_outcomes_and_sessions(spark, tmp_path):
    source = stream(spark, tmp_path, [rows(90)])
    assert {r["status"]: r["requests"] for r in run(S.outcome_counts(source), "outcomes", "complete", tmp_path).collect()} == {"answered": 60, "blocked": 30}
    assert run(S.minute_counts(S.with_event_time(source), "client"), "minutes", "complete", tmp_path).agg(F.sum("requests")).first()[0] == 90
    assert [r["requests"] for r in run(S.sessions(S.with_event_time(source), "client"), "sessions", "complete", tmp_path).collect()] == [90]


def test_event_reducer(spark, tmp_path):
    schema = "request_id string, seq long, type string, payload string"
    folder = str(tmp_path / "events")
    token = lambda d: json.dumps({"delta": d})
    first = [("a", 2, "token", token("lo")), ("a", 1, "token", token("hel")), ("a", 0, "stage", '{"stage":"fuse","status":"started"}'), ("b", 0, "token", token("x")), ("b", 1, "token", "{broken")]
    second = [("a", 2, "token", token("again")), ("a", 3, "stage", '{"stage":"fuse","status":"completed"}'), ("a", 4, "done", '{"result":{"answer":"final","chunks":[{"id":"c1"}]}}'), ("b", 2, "error", None)]
    second += [("c", n, kind, body) for n, (kind, body) in enumerate((
        ("start", '{"requestId":"c","createdAt":"2025-01-01T00:00:00Z"}'), ("transcript", '{"transcription":{"text":"mill","languageCode":"hin","latencyMs":12}}'),
        ("guardrails", '{"report":{"results":[{"id":"jailbreak","verdict":"pass"},{"id":"off_topic","verdict":"warn"}]}}'), ("stage", '{"stage":"retrieval","status":"completed","durationMs":7}'),
        ("guardrails", '{"report":{"results":[{"id":"off_topic","verdict":"pass"}]}}'), ("chunks", '{"chunks":[{"id":"x"},{"id":"y"}]}'), ("reasoning", '{"delta":"so "}'), ("reasoning", '{"delta":"then"}'), ("token", '{"delta":"A"}'), ("other", "[]"),
    ))]
    for k, b in enumerate((first, second)):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(folder)
    got = {}
    for r in run(S.reduce_events(source, 60_000), "reduced", "update", tmp_path).orderBy("seq").collect():
        got[r["request_id"]] = r
    assert (got["a"]["seq"], got["a"]["answer"], got["a"]["status"], json.loads(got["a"]["stages"])["fuse"]["state"], json.loads(got["a"]["chunks"])) == (4, "final", "done", "done", ["c1"])
    c = got["c"]
    assert (c["status"], c["answer"], c["reasoning"], json.loads(c["chunks"])) == ("running", "A", "so then", ["x", "y"])
    assert json.loads(c["guardrails"]) == {"jailbreak": "pass", "off_topic": "pass"} and json.loads(c["transcription"])["text"] == "mill"
    assert json.loads(c["stages"]) == {"retrieval": {"state": "done", "ms": 7, "detail": None}, "transcription": {"state": "done", "ms": 12, "detail": "hin"}}
    assert (got["b"]["answer"], got["b"]["status"]) == ("x", "error")


def test_upsert_sink_is_idempotent(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "id string, v int, n int"
    write = S.upsert_sink(path, "id", "v")
    one, two = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema), spark.createDataFrame([("a", 2, 2), ("c", 1, 3)], schema)
    for number, batch in ((0, one), (1, two), (1, two)):
        write(batch, number)
    table = spark.read.parquet(index_files.current_version(spark, path))
    assert sorted(map(tuple, table.collect())) == [("a", 2, 2), ("b", 1, 1), ("c", 1, 3)]
    index_files.reset(spark, path)
    assert index_files.current_version(spark, path) is None


def test_frames(spark):
    from millrace.fixtures import FIXTURES

    schema, data = FIXTURES["sse"]
    got = [(r["stream_id"], r["frame"], r["type"]) for r in parse_frames(spark.createDataFrame(data, schema), "stream_id", "body").orderBy("stream_id", "frame").collect()]
    assert got == [(1, 0, "start"), (1, 1, "token"), (1, 2, "done"), (2, 2, "token")]


def test_index_lines(spark, tmp_path):
    path = tmp_path / "index"
    path.mkdir()
    (path / "part.json").write_text('{"id":"a","vector":[0.123456,1],"text":"x"}\n{"id":"b","vec\n{"text":"no id"}\n')
    df = index_files.read_index(spark, str(path))
    assert [r["id"] for r in df.collect()] == ["a"]
    index_files.write_index(df, str(tmp_path / "out"))
    assert index_files.read_index(spark, str(tmp_path / "out")).first()["vector"] == [0.1235, 1.0]


def test_snapshots(spark, tmp_path):
    terms, stats = spark.createDataFrame([("mill", 1, 3)], "term string, term_id int, frequency long"), spark.createDataFrame([(5, 2.0)], "documents long, average_length double")
    path, rebuilt = str(tmp_path / "snap"), []
    again = lambda: (rebuilt.append(1), (terms, stats))[1]
    index_files.load_snapshot(spark, path, again)
    index_files.write_snapshot(terms, stats, path)
    t, s = index_files.load_snapshot(spark, path, again)
    assert rebuilt == [1] and t.collect() == terms.collect() and s.collect() == stats.collect()


def test_staleness_and_languages(spark, tmp_path):
    kind = "struct<repository:string,split:string,english:boolean,languages:array<string>,rows:int>"
    have = ("r", "dev", True, ["b", "a"], 300)
    wants = [(have, ("r", "dev", True, ["a", "b"], 200)), (have, ("x", "dev", True, ["a", "b"], 1)), (have, ("r", "dev", False, ["a", "b"], 1)), (have, ("r", "dev", True, ["a"], 1)), (have, ("r", "dev", True, ["a", "b"], 400)), (None, have)]
    df = spark.createDataFrame(wants, f"b {kind}, w {kind}")
    assert [r[0] for r in df.select(index_files.stale_reason(F.col("b"), F.col("w"))).collect()] == [None, "repository", "english", "languages", "rows", "repository"]
    spark.range(3).write.parquet(str(tmp_path / "hin"))
    df, failed = index_files.read_languages(spark, {"hin_Deva": str(tmp_path / "hin"), "tam_Taml": str(tmp_path / "missing")}, 2)
    assert df.count() == 2 and set(failed) == {"tam_Taml"}
    names = spark.createDataFrame([("/x/hin_Deva-train.parquet",), ("/x/other.parquet",)], "p string")
    assert [r[0] for r in names.select(index_files.language_of_file(F.col("p"))).collect()] == ["hin_Deva", None]


def test_wav(spark, tmp_path):
    one, two = audio.encode_wav(b"\x01\x00" * 8000, 1, 8000, 16), audio.encode_wav(b"\x02\x00" * 4000, 1, 8000, 16)
    listed = one[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + one[12:]
    assert audio.parse_wav(listed)["samples"] == audio.parse_wav(one)["samples"] and audio.parse_wav(b"RIFF") is None
    assert len(audio.parse_wav(audio.join_wav([one, two]))["samples"]) == 24_000 and audio.join_wav([]) is None and audio.join_wav([one, b"x"]) is None
    (tmp_path / "a.wav").write_bytes(one)
    (tmp_path / "b.wav").write_bytes(b"none")
    got = audio.read_audio(spark, str(tmp_path)).select(F.regexp_extract("path", "[^/]+$", 0).alias("f"), audio.wav_info("content").alias("i")).select("f", "i.*").orderBy("f").collect()
    assert tuple(got[0]) == ("a.wav", 1, 8000, 16, 1.0) and got[1]["rate"] is None
    kinds = spark.createDataFrame([("audio/webm;codecs=opus", 5), ("text/plain", 5), (None, 5), ("audio/wav", 0), ("Audio/X-M4A", 5), ("video/webm", 5), ("audio/mp3", 5)], "k string, n int")
    assert [r[0] for r in kinds.select(audio.accepted(F.col("k"), F.col("n"))).collect()] == [True, False, False, False, True, True, True]


def test_guardrail_counts_and_log_sink(spark, tmp_path):
    schema = "request_id string, query string, total double, dense_retrieval double, guardrails array<struct<id:string,verdict:string>>"
    folder = str(tmp_path / "log")
    spark.createDataFrame([("a", "q" * 400, 12.4, 1.25, [("jailbreak", "block"), ("off_topic", "pass")]), ("b", None, None, None, [("jailbreak", "warn")]), ("c", "", 0.5, -1.0, None)], schema).write.json(folder)
    source = spark.readStream.schema(schema).json(folder)
    assert [tuple(r) for r in run(S.guardrail_counts(source), "guards", "complete", tmp_path).collect()] == [("jailbreak", 2)]
    rows = spark.read.schema(schema).json(folder)
    for stage in ("guardrails_pre", "embedding", "dense_retrieval", "sparse_retrieval", "fusion", "diversity", "reranking", "expansion"):
        rows = rows if stage in rows.columns else rows.withColumn(stage, F.lit(0.0))
    write = S.log_sink(str(tmp_path / "entries"))
    write(rows, 3)
    write(rows, 3)  # the same batch again
    got = {r["request_id"]: r for r in spark.read.parquet(str(tmp_path / "entries")).collect()}
    assert len(got) == 3 and len(got["a"]["query"]) == 300 and got["a"]["total_latency_ms"] == 12 and got["b"]["total_latency_ms"] is None


def test_retries_and_timeouts(spark, tmp_path):
    import time

    from millrace.sources import index_files as I

    waits, calls = [], []

    def fails(n):
        def call(attempt):
            calls.append(attempt)
            if attempt < n:
                raise OSError(str(attempt))
            return "done"

        return call

    assert I.with_retries(fails(2), 3, base=0.5, most=0.8, sleep=waits.append) == "done" and calls == [0, 1, 2]
    assert len(waits) == 2 and waits[0] <= 0.5 and waits[1] <= 0.8
    with pytest.raises(OSError, match="1"):
        I.with_retries(fails(9), 1, sleep=waits.append)
    with pytest.raises(OSError, match="0"):
        I.with_retries(fails(9), 5, again=lambda error, attempt: False, sleep=waits.append)
    with pytest.raises(I.TimedOut):
        I.with_timeout(lambda: time.sleep(5), 0.05)
    assert I.with_timeout(lambda: 7, 5) == 7
    (tmp_path / "rows.json").write_text('{"a":1}\n{broken\n{"a":2}\n')
    assert [r["a"] for r in I.read_json_rows(spark, str(tmp_path / "rows.json"), "a int").collect()] == [1, 2]
    assert I.read_json_rows(spark, str(tmp_path / "rows.json"), "a int", 1).count() == 1


def test_stores(spark, tmp_path):
    from millrace.sources.stores import FileStore, MemoryStore, known_languages, open_store

    schema = "id string, vector array<double>, language string, strategy string, upserted_at long"
    first = spark.createDataFrame([("a", [1.0, 0.0], "eng_Latn", "overlap", 1), ("b", [0.0, 1.0], "hin_Deva", "overlap", 1)], schema)
    second = spark.createDataFrame([("a", [0.6, 0.8], "eng_Latn", "overlap", 2), ("c", [0.8, 0.6], "hin_Deva", "parent", 2)], schema)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<double>")
    for store in (open_store(spark, "auto", str(tmp_path / "store")), open_store(spark, "auto")):
        assert store.count() == 0
        store.upsert(first)
        store.upsert(second)
        assert store.count() == 3 and [r["id"] for r in store.search(asked, 2).orderBy("rank").collect()] == ["c", "a"]
        assert [r["id"] for r in store.search(asked, 2, F.col("language") == "hin_Deva").orderBy("rank").collect()] == ["c", "b"]
        store.reset()
        assert store.count() == 0
        with pytest.raises(ValueError):
            store.search(asked, 1) if store.rows() is None else None
    assert isinstance(open_store(spark, "memory"), MemoryStore) and isinstance(open_store(spark, "files", "x"), FileStore)
    with pytest.raises(ValueError):
        open_store(spark, "other")
    assert known_languages(first, ["hin_Deva"]).count() == 1 and known_languages(first, []).count() == 2
    with pytest.raises(ValueError):
        known_languages(first, ["tam_Taml"])
