"""Event-stream bodies to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_frames(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, frame (from 0), type, payload (the JSON text) of each complete frame of a body.

    Frames end with a blank line, what follows the last one is not complete; their data lines are joined;
    frames without data and malformed ones are left out.
    """
    frames = F.split(F.col(body), "\n\n")
    whole = F.slice(frames, F.lit(1), F.greatest(F.lit(0), F.size(frames) - 1))
    rows = df.select(key, F.posexplode(whole).alias("frame", "f"))
    data = F.transform(F.filter(F.split("f", "\n"), lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substring(x, F.lit(6), F.length(x))))
    text = rows.select(key, "frame", F.size(data).alias("n"), F.array_join(data, "\n").alias("payload")).filter("n > 0")
    return text.filter(F.try_parse_json("payload").isNotNull()).select(key, "frame", F.get_json_object("payload", "$.type").alias("type"), "payload")


def format_frames(events: DataFrame, type_column: str = "type", payload: str = "payload") -> DataFrame:
    """``events`` with frame: the event's name and its JSON as one frame of an event stream, each line of it a data line."""
    data = F.concat(F.lit("data: "), F.regexp_replace(F.coalesce(payload, F.lit("{}")), "\n", "\ndata: "))
    return events.withColumn("frame", F.concat(F.lit("event: "), type_column, F.lit("\n"), data, F.lit("\n\n")))


def frame_sink(path: str, order: str = "seq"):
    """For foreachBatch: writes each batch's frames as text in order, a folder a batch, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        # the writer ends each row with a line feed, which is the second of the frame's own
        lines = format_frames(batch).repartitionByRange(order).sortWithinPartitions(order).select(F.substring("frame", F.lit(1), F.length("frame") - 1).alias("frame"))
        lines.write.mode("overwrite").text(f"{path}/batch={number}")

    return write
