"""Streaming counterparts of the request analytics, and a reducer of per-request event streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATENESS = "2 hours"


def with_event_time(log: DataFrame, created_at: str = "created_at", lateness: str = LATENESS) -> DataFrame:
    """``log`` with at, the instant of its ISO time, and a watermark on it. Rows without a valid time are left out."""
    return log.withColumn("at", F.try_to_timestamp(F.col(created_at))).filter(F.col("at").isNotNull()).withWatermark("at", lateness)


def hourly(log: DataFrame, key: str = "request_id") -> DataFrame:
    """hour, requests, average_ms in tumbling hours, each request once: repeated rows fall within the watermark of the first."""
    once = log.dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.avg("total_latency_ms").alias("average_ms")).select(F.col("w.start").alias("hour"), "requests", "average_ms")


def minute_counts(log: DataFrame, client: str) -> DataFrame:
    """client, minute, requests in fixed one-minute windows."""
    return log.groupBy(F.col(client).alias("client"), F.window("at", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("requests")).select("client", F.col("w.start").alias("minute"), "requests")


def sessions(log: DataFrame, client: str, gap: str = "30 minutes") -> DataFrame:
    """client, start, end, requests of runs of requests with no gap as long as ``gap``."""
    return log.groupBy(F.col(client).alias("client"), F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("requests")).select("client", "w.start", "w.end", "requests")


def guardrail_counts(log: DataFrame, results: str = "guardrails") -> DataFrame:
    """guard, events since the stream began: of ``results`` (array of id, verdict) those that did not pass. For the update or complete mode."""
    tripped = log.select(F.explode(results).alias("r")).filter("r.verdict <> 'pass'")
    return tripped.groupBy(F.col("r.id").alias("guard")).agg(F.count(F.lit(1)).alias("events"))


def log_sink(path: str):
    """For foreachBatch: appends the requests' log entries (``log_entries``) to the table at ``path``, a folder a batch, so that a batch run again replaces itself."""
    from millrace.operators.analytics import log_entries

    def write(batch: DataFrame, number: int) -> None:
        log_entries(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def outcome_counts(log: DataFrame) -> DataFrame:
    """status, requests since the stream began: for the update or complete mode."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("requests"))


def upsert_sink(path: str, key: str, version: str):
    """For foreachBatch: merges a batch into the Parquet table at ``path``, the greater version winning.

    The new table is written beside the old one under the batch's number and a pointer file is moved over
    the old pointer, so that a batch that is run again, or a writer that is lost, leaves a whole table.
    """
    from millrace.operators.records import upsert
    from millrace.sources.index_files import current_version, publish_version

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current_version(spark, path)
        target = f"{path}/v{number}"
        if old == target:
            return  # this batch is in already
        merged = upsert(spark.read.parquet(old) if old else batch.limit(0), batch, key, version)
        merged.write.mode("overwrite").parquet(target)
        publish_version(spark, path, target)

    return write


class EventReducer(StatefulProcessor):
    """The state of each request from its events (seq, type, payload as JSON).

    Stage events set a stage's state, duration and detail, a transcript event those of transcription; guardrails
    reports merge, the later result of a guard winning; token and reasoning events add to their texts; a done event's
    result is authoritative; an error ends the request. Events may come in any order within a batch: they are
    applied by seq, and ones at or before the last applied are dropped as repeats. State expires with the time to live.
    """

    def __init__(self, ttl_ms: int = 300_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("request", "seq long, body string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        kept = self.held.get()
        seq, state = (kept[0], json.loads(kept[1])) if kept else (-1, dict(START))
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for n, kind, payload in zip(frame["seq"], frame["type"], frame["payload"]):
            if n > seq:
                seq, state = int(n), applied(kind, payload, state)
        self.held.update((seq, json.dumps(state, sort_keys=True)))
        text = lambda x: None if x is None else json.dumps(x, sort_keys=True, ensure_ascii=False)
        row = {"request_id": key[0], "seq": seq} | {c: state[c] for c in ("answer", "status", "reasoning")} | {c: text(state[c]) for c in ("stages", "guardrails", "chunks", "transcription")}
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


START = {"answer": "", "reasoning": "", "status": "running", "stages": {}, "guardrails": {}, "chunks": None, "transcription": None, "created_at": None, "error": None}


def applied(kind: str, payload: str | None, state: dict) -> dict:
    """The state after an event. A malformed one changes nothing."""
    try:
        body = json.loads(payload or "{}")
        if not isinstance(body, dict):
            return state
    except ValueError:
        return state
    if kind == "start":
        return state | {"created_at": body.get("createdAt")}
    if kind == "token":
        return state | {"answer": state["answer"] + str(body.get("delta", ""))}
    if kind == "reasoning":
        return state | {"reasoning": state["reasoning"] + str(body.get("delta", ""))}
    if kind == "stage":
        return state | {"stages": state["stages"] | {str(body.get("stage")): _stage(state, body)}}
    if kind == "transcript":
        heard = body.get("transcription") or {}
        done = {"state": "done", "ms": heard.get("latencyMs"), "detail": heard.get("languageCode")}
        return state | {"transcription": heard, "stages": state["stages"] | {"transcription": done}}
    if kind == "guardrails":
        return state | {"guardrails": state["guardrails"] | _verdicts(body.get("report"))}
    if kind == "chunks":
        return state | {"chunks": [c.get("id") for c in body.get("chunks") or []]}
    if kind == "done":
        result = body.get("result") or {}
        new = {"status": "done", "answer": str(result.get("answer", state["answer"]))}
        if "chunks" in result:
            new["chunks"] = [c.get("id") for c in result["chunks"] or []]
        if result.get("guardrails"):
            new["guardrails"] = _verdicts(result["guardrails"])
        if "transcription" in result:
            new["transcription"] = result["transcription"]
        return state | new
    if kind == "error":
        return state | {"status": "error", "error": body.get("error")}
    return state


def _stage(state: dict, body: dict) -> dict:
    before = state["stages"].get(str(body.get("stage")), {})
    value = lambda new, old: body[new] if body.get(new) is not None else before.get(old)
    return {"state": "done" if body.get("status") == "completed" else "running", "ms": value("durationMs", "ms"), "detail": value("detail", "detail")}


def _verdicts(report: dict | None) -> dict:
    return {str(r.get("id")): r.get("verdict") for r in (report or {}).get("results") or []}


def reduce_events(events: DataFrame, ttl_ms: int = 300_000) -> DataFrame:
    """request_id, seq, answer, status, reasoning, stages, guardrails, chunks, transcription (the last four as JSON) after each batch
    of a stream of events (request_id, seq, type, payload).

    Needs the RocksDB state store and the update mode.
    """
    columns = "request_id string, seq long, answer string, status string, reasoning string, stages string, guardrails string, chunks string, transcription string"
    return events.groupBy("request_id").transformWithStateInPandas(EventReducer(ttl_ms), columns, "Update", "ProcessingTime")
