"""Passages to chunks: structural and topical splitting, overlap, parents, sliding windows.

Every step after normalisation depends on what the step before chose, passage by passage, so a passage
is one call of a Python function inside a map over Arrow batches: nothing is shuffled, and a passage's
chunks never leave its row before they are done.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import CHARS_PER_TOKEN, DENSE_LOSS, DENSE_SCRIPTS, STOPWORDS, metadata_header, normalize_whitespace, topic_of, with_header


@dataclass(frozen=True)
class Options:
    """Sizes in estimated tokens."""

    target: int = 220
    least: int = 48
    overlap: int = 48
    parent: int = 700
    percentile: int = 88
    window: int = 160
    stride: int = 80


@dataclass
class Span:
    text: str
    start: int
    end: int
    units: list[int] = field(default_factory=list)

    @property
    def tokens(self) -> int:
        return estimate(self.text)


_DENSE = regex.compile("[" + "".join(rf"\p{{{s}}}" for s in DENSE_SCRIPTS) + "]")
_TERMINATED = regex.compile(r"[^.!?。！？…॥।؟۔]*[.!?。！？…॥।؟۔]+[.!?。！？…॥।؟۔\"'”’)\]]*|[^.!?。！？…॥।؟۔]+$", regex.S)
_WORDS = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_STOP = frozenset(STOPWORDS)
# Separators from coarse to fine: paragraphs, lines, sentences, clauses, phrases, words.
SEPARATORS = tuple(map(regex.compile, (r"\n{2,}", r"\n", r"(?<=[.!?।॥۔؟…])\s+", r"(?<=[;:])\s+", r"(?<=,)\s+", r"\s+")))
# How far two small neighbours may exceed the target, a span may before it is split again; the shares of
# itself and of its neighbour that an overlap may take; the characters within which it is moved to a space.
MERGED, OVERSIZED, OWN_SHARE, NEIGHBOUR_SHARE, SNAP = 1.35, 1.5, 0.35, 0.5, 24


@lru_cache(maxsize=1 << 12)
def estimate(text: str) -> int:
    if not text:
        return 0
    return max(1, math.ceil(len(text) / (CHARS_PER_TOKEN - DENSE_LOSS * len(_DENSE.findall(text)) / len(text))))


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def sentence_spans(text: str) -> list[Span]:
    """Terminated runs, those of fewer than four tokens with the one before. Offsets tile the text."""
    out: list[Span] = []
    for m in _TERMINATED.finditer(text):
        piece = m.group().strip()
        if not piece:
            continue
        if out and estimate(piece) < 4:
            out[-1] = Span(f"{out[-1].text} {piece}".strip(), out[-1].start, m.end())
        else:
            out.append(Span(piece, m.start(), m.end()))
    return out


def _joined(units: list[Span], chosen: list[int]) -> Span:
    return Span(" ".join(units[i].text for i in chosen).strip(), units[chosen[0]].start, units[chosen[-1]].end, list(chosen))


def merge_small(spans: list[Span], o: Options) -> list[Span]:
    """Neighbours of which one is below the least size become one, while they stay near the target."""
    out: list[Span] = []
    for s in spans:
        p = out[-1] if out else None
        if p and min(p.tokens, s.tokens) < o.least and p.tokens + s.tokens <= o.target * MERGED:
            out[-1] = Span(f"{p.text} {s.text}".strip(), p.start, s.end, p.units + s.units)
        else:
            out.append(s)
    return out


def structural(text: str, o: Options) -> list[Span]:
    """Split by the coarsest separator that divides, each part again by finer ones until it is within the target."""
    done: list[Span] = []
    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        part = text[a:b]
        if level == len(SEPARATORS) or estimate(part) <= o.target:
            if body := part.strip():
                lead = a + len(part) - len(part.lstrip())
                done.append(Span(body, lead, lead + len(body)))
            continue
        edges = [(m.start(), m.end()) for m in SEPARATORS[level].finditer(part)]
        starts, ends = [0, *(e for _, e in edges)], [*(s for s, _ in edges), len(part)]
        parts = [(a + s, a + e) for s, e in zip(starts, ends) if part[s:e].strip()]
        # a separator that does not divide: the whole goes on to the next one
        todo += [(s, e, level + 1) for s, e in reversed(parts)] if len(parts) > 1 else [(a, b, level + 1)]
    return merge_small(done, o)


def topical(text: str, o: Options) -> list[Span]:
    """Cut where the words of neighbouring sentences differ most, or the target is reached."""
    units = sentence_spans(text)
    if not units:
        return []
    words = [frozenset(w for w in _WORDS.findall(u.text.lower()) if len(w) > 1 and w not in _STOP) for u in units]
    n = len(units)
    distance = []
    for i in range(n - 1):
        a = words[i] | (words[i - 1] if i else frozenset())
        b = words[i + 1] | (words[i + 2] if i + 2 < n else frozenset())
        distance.append(1 - (len(a & b) / len(a | b) if a and b else 0.0))
    ordered = sorted(distance)
    break_at = ordered[max(0, math.ceil(o.percentile / 100 * len(ordered)) - 1)] if ordered else 1.0
    spans, open_, size = [], [], 0
    for i, u in enumerate(units):
        open_.append(i)
        size += u.tokens
        due = size >= o.target or (i < n - 1 and distance[i] >= break_at)
        if i == n - 1 or (due and size >= o.least):
            spans.append(_joined(units, open_))
            open_, size = [], 0
    return merge_small(spans, o) if n > 1 else spans


def with_overlap(spans: list[Span], text: str, o: Options) -> list[Span]:
    """Each span but the first begins with the end of the one before: the wanted overlap, but no more than a share of either."""
    if o.overlap <= 0 or len(spans) < 2:
        return spans
    wanted = _half_up(o.overlap * len(text) / (estimate(text) or 1))
    out = [replace(spans[0])]
    for p, s in zip(spans, spans[1:]):
        reach = min(wanted, _half_up((s.end - s.start) * OWN_SHARE), _half_up((p.end - p.start) * NEIGHBOUR_SHARE))
        if reach <= 0:
            out.append(replace(s))
            continue
        at = max(p.start, s.start - reach)
        stop = at - SNAP
        while 0 < at < len(text) and at > stop and not text[at].isspace():
            at -= 1
        body = text[at : s.end].strip() or s.text
        out.append(Span(body, at, s.end, s.units))
    return out


def grouped(spans: list[Span], text: str, o: Options) -> tuple[list[Span], list[int]]:
    """Parents: runs of spans up to the parent size; and of each span its parent."""
    parents: list[list[Span]] = []
    of, size = [], 0
    for s in spans:
        if not parents or (size and size + s.tokens > o.parent):
            parents.append([])
            size = 0
        parents[-1].append(s)
        size += s.tokens
        of.append(len(parents) - 1)
    return [Span(text[g[0].start : g[-1].end].strip(), g[0].start, g[-1].end) for g in parents], of


def sliding(text: str, o: Options) -> list[Span]:
    """Windows over sentences, each a stride on (a sentence at least), until one holds the last sentence."""
    units = sentence_spans(text)
    sizes = [u.tokens for u in units]
    out, first = [], 0
    while first < len(units):
        last, size = first, sizes[first]
        while last + 1 < len(units) and size + sizes[last + 1] <= o.window:
            last += 1
            size += sizes[last]
        out.append(_joined(units, list(range(first, last + 1))))
        step, gone = first, 0
        while step < len(units) and gone < o.stride:
            gone += sizes[step]
            step += 1
        first = max(first + 1, step)
        if last == len(units) - 1:
            break
    return out


def uuid_from(key: str) -> str:
    h = hashlib.sha1(key.encode()).hexdigest()[:32]
    h = f"{h[:12]}5{h[13:16]}{'89ab'[int(h[16], 16) % 4]}{h[17:]}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def chunk_passage(text: str, prefix: str, o: Options) -> Iterator[dict]:
    """The chunks of one normalised passage: parents of two children or more, children, windows of other texts."""
    if not text:
        return
    if len(sentence_spans(text)) < 3:
        base, spans = "recursive", structural(text, o)
    else:
        base, spans = "semantic", []
        for s in topical(text, o):
            if s.tokens > o.target * OVERSIZED:
                spans += [Span(p.text, s.start + p.start, min(s.end, s.start + p.end)) for p in structural(s.text, o)]
            else:
                spans.append(s)
    if not spans:
        return
    children = with_overlap(spans, text, o)
    parents, of = grouped(children, text, o)
    label = "overlap" if o.overlap > 0 and len(spans) > 1 else base

    def row(s: Span, strategy: str, index: int, parent: str | None) -> dict:
        key = f"{prefix}::{strategy}::{index}"
        return {"id": uuid_from(key), "chunk_key": key, "text": s.text, "strategy": strategy, "chunk_index": index, "parent_chunk": parent, "token_count": s.tokens, "char_start": s.start, "char_end": s.end}

    sizes = Counter(of)
    kept = {k: row(p, "parent", k, None) for k, p in enumerate(parents) if sizes[k] > 1}
    yield from kept.values()
    texts = {r["text"] for r in kept.values()}
    for i, s in enumerate(children):
        texts.add(s.text)
        yield row(s, label, i, kept[of[i]]["id"] if of[i] in kept else None)
    if estimate(text) > 2 * o.window:
        for i, s in enumerate(sliding(text, o)):
            if s.text not in texts:
                yield row(s, "sliding_window", i, None)


_CHUNK = "array<struct<id:string,chunk_key:string,text:string,strategy:string,chunk_index:int,parent_chunk:string,token_count:int,char_start:int,char_end:int>>"


def chunk_documents(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Chunks of documents (document_id, passage_id, text, language, source, topic, query_text), with topic, header and embed_text.

    Blank texts have no chunks. Ids depend on document, passage, strategy and index alone; of chunks of one
    id (repeated documents) one is kept.
    """

    @F.pandas_udf(_CHUNK)
    def chunks_of(texts: pd.Series, prefixes: pd.Series) -> pd.Series:
        return pd.Series([list(chunk_passage(t or "", p, options)) for t, p in zip(texts, prefixes)], dtype=object)

    plain = normalize_whitespace(F.coalesce("text", F.lit("")))
    rows = docs.select("document_id", "passage_id", "language", "source", topic_of(F.col("query_text"), F.col("topic"), F.col("text")).alias("topic"), plain.alias("_text"))
    made = rows.select("*", F.explode(chunks_of("_text", F.concat_ws("::", "document_id", "passage_id"))).alias("c")).drop("_text").select("*", "c.*").drop("c")
    header = metadata_header(F.col("topic"), F.col("language"), F.col("source"))
    once = made.withColumn("_nth", F.row_number().over(W.partitionBy("id").orderBy("topic", "source"))).filter("_nth = 1").drop("_nth")
    return once.withColumn("embed_text", with_header(header, F.col("text")))


def spans_by(docs: DataFrame, key: str, text: str, method: str, options: Options = Options()) -> DataFrame:
    """key, span (from 0), char_start, char_end, token_count of one step alone: sentences, structural, topical, sliding, overlap or parents."""
    steps = {
        "sentences": lambda t: sentence_spans(t),
        "structural": lambda t: structural(t, options),
        "topical": lambda t: topical(t, options),
        "sliding": lambda t: sliding(t, options),
        "overlap": lambda t: with_overlap(topical(t, options), t, options),
        "parents": lambda t: grouped(with_overlap(topical(t, options), t, options), t, options)[0],
    }
    step = steps[method]

    @F.pandas_udf("array<struct<span:int,char_start:int,char_end:int,token_count:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"span": i, "char_start": s.start, "char_end": s.end, "token_count": s.tokens} for i, s in enumerate(step(t or ""))] for t in texts], dtype=object)

    plain = normalize_whitespace(F.coalesce(F.col(text), F.lit("")))
    return docs.select(key, F.explode(spans(plain)).alias("s")).select(key, "s.*")


def speech_chunks(text: str, limit: int = 480) -> list[str]:
    """Pieces of at most ``limit`` characters at sentence ends; longer sentences are cut at spaces, or where the limit falls."""
    if len(text) <= limit:
        return [text] if text else []
    out, held = [], ""
    for m in regex.finditer(r"[^.!?।]+[.!?।]+\s*|[^.!?।]+$", text):
        s = m.group()
        if held and len(held) + len(s) > limit:
            out.append(held.strip())
            held = ""
        if len(s) > limit:
            if held:
                out.append(held.strip())
            rest = s.strip()
            while len(rest) > limit:
                at = rest.rfind(" ", 0, limit + 1)
                at = at if at > limit * 0.5 else limit
                out.append(rest[:at].strip())
                rest = rest[at:].strip()
            held = rest
        else:
            held += s
    if not out and not held:
        held = text
    return [x for x in (*out, held.strip()) if x]
