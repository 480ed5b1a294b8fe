"""A retrieval cache as keyed state: entries expire by age and, when there are too many, by last use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Entries of one cache, and milliseconds an entry serves.
ENTRIES, TTL_MS = 256, 300_000


class ExactCache(StatefulProcessor):
    """Of each request, in the order of at_ms and request_id, whether an entry of its form serves it; a miss stores one.

    Keyed by the options, of which the entries are bounded: the least recently used goes first.
    """

    def __init__(self, entries: int = ENTRIES, ttl_ms: int = TTL_MS):
        self.entries, self.ttl_ms = entries, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("entries", "form string", "stored_ms long, used long")
        self.clock = handle.getValueState("clock", "used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = {form[0]: tuple(v) for form, v in self.held.iterator()} if self.held.exists() else {}
        before = set(held)
        used = self.clock.get()[0] if self.clock.exists() else 0
        out = []
        for request, form, at in pd.concat(list(rows)).sort_values(["at_ms", "request_id"])[["request_id", "form", "at_ms"]].itertuples(index=False):
            used += 1
            entry = held.get(form)
            hit = entry is not None and at - entry[0] < self.ttl_ms
            held[form] = (entry[0] if hit else int(at), used)
            while len(held) > self.entries:
                held.pop(min(held, key=lambda f: held[f][1]))
            out.append((key[0], request, bool(hit)))
        for form in before - set(held):
            self.held.removeKey((form,))
        for form, value in held.items():
            self.held.updateValue((form,), value)
        self.clock.update((used,))
        yield pd.DataFrame(out, columns=["options_key", "request_id", "hit"])

    def close(self) -> None:
        pass


def cache_hits(requests: DataFrame, entries: int = ENTRIES, ttl_ms: int = TTL_MS) -> DataFrame:
    """options_key, request_id, hit of a stream of requests (options_key, request_id, form, at_ms). Needs the RocksDB state store."""
    return requests.groupBy("options_key").transformWithStateInPandas(ExactCache(entries, ttl_ms), "options_key string, request_id string, hit boolean", "Append", "None")
