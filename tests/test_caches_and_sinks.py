import json
import pathlib

import pytest

from millrace.sources import index_files
from millrace.streaming.caches import cache_hits
from millrace.streaming.frames import format_frames, frame_sink, parse_frames

SCHEMA = "options_key string, request_id string, form string, at_ms long"


def test_cache_expires_by_age_and_by_use(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("o", "r1", "a", 0), ("o", "r2", "a", 10), ("o", "r3", "b", 20), ("o", "r4", "a", 30), ("o", "r5", "c", 40), ("o", "r6", "b", 50), ("o", "r7", "c", 60), ("o", "r8", "c", 1040), ("p", "r9", "a", 5)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(folder)
    source = spark.readStream.schema(SCHEMA).json(folder)
    q = cache_hits(source, entries=2, ttl_ms=1000).writeStream.format("memory").queryName("cache").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r["request_id"]: r["hit"] for r in spark.table("cache").collect()}
    # r5 drops b, the least recently used, so r6 misses; r8 is 1000 after r5 stored c
    assert got == {"r1": False, "r2": True, "r3": False, "r4": True, "r5": False, "r6": False, "r7": True, "r8": False, "r9": False}


def test_frames_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([(0, "token", '{"type":"token",\n"delta":"a"}'), (1, "done", '{"type":"done"}')], "seq int, type string, payload string")
    bodies = spark.createDataFrame([(1, "".join(r["frame"] for r in format_frames(df).orderBy("seq").collect()))], "stream_id int, body string")
    assert [r["type"] for r in parse_frames(bodies, "stream_id", "body").orderBy("frame").collect()] == ["token", "done"]
    write = frame_sink(str(tmp_path / "out"))
    write(df, 0)
    write(df, 0)
    text = "".join(p.read_text() for p in sorted(pathlib.Path(tmp_path / "out").rglob("part-*.txt")))
    assert text == "".join(r["frame"] for r in format_frames(df).orderBy("seq").collect())


def test_reports_counts_and_batches(spark, tmp_path):
    df = spark.range(10)
    target = index_files.write_report(df, str(tmp_path), "2025-01-01T10:00")
    assert target.endswith("report-2025-01-01T10-00") and spark.read.json(target).count() == 10
    df.write.parquet(str(tmp_path / "t"))
    assert index_files.count_rows(spark, str(tmp_path / "t")) == 10 and index_files.count_rows(spark, str(tmp_path / "none")) == 0
    out, flag = tmp_path / "sent", str(tmp_path / "flag")
    out.mkdir()

    def sender(out=str(out), flag=flag):
        import os
        import uuid

        def put(rows):
            if not os.path.exists(flag):
                open(flag, "w").close()
                raise OSError("first try")
            with open(f"{out}/{uuid.uuid4()}", "w") as f:
                json.dump(rows, f)

        return put

    assert index_files.send_batches(df, sender, size=4) == 10
    assert sorted(r["id"] for p in out.iterdir() for r in json.loads(p.read_text())) == list(range(10))

    def broken():
        def put(rows):
            raise OSError("down")

        return put

    with pytest.raises(Exception, match="down"):
        index_files.send_batches(df, broken)
