"""Long spans that stand word for word in more than one record.

Candidates come from content-defined anchors: of every window of consecutive GRAM-character grams the
one of least hash is an anchor, so any two records that share ``least`` characters share an anchor in
them. Anchors that recur are confirmed on the texts around them: every window of ``least`` characters that holds
the anchor and stands in two documents, neighbouring windows of the same contexts as one passage. Passages are
compiled into sharded Aho-Corasick automata, and every occurrence in every document that has one is located: documents
are spread over parts, and an automaton of a part holds the passages whose anchors its documents have.

Shuffled are anchors (a few per cent of the characters), the surroundings of recurring ones, and the texts of documents
with a recurring anchor. No group of records is ever in one task: contexts are grouped by their own text, and those of
an anchor that has many are compared in a shuffle by the hashes of their windows, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import cut

LEAST, GRAM = 200, 100
#: Anchors with more different contexts than one task compares: theirs are compared in a shuffle.
CONTEXTS = 400
#: Characters of passages that one automaton holds.
SHARD_CHARS = 1_500_000
#: Characters hashed at a time, and characters of the documents of a part.
BLOCK_CHARS, PART_CHARS = 1_000_000, 4_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` characters, from prefix sums modulo 2**64 that doubling aligns."""
    h = (codes.astype("u8") + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    # runs of 1, 2, 4, ... characters combine to runs of any length: multiplicative, then mixed
    out, width, done, power = None, 1, 0, _BASE
    run = h
    rest = gram
    while rest:
        if rest & 1:
            out = run if out is None else out[: len(run) - done] * power + run[done:]
            done += width
        rest >>= 1
        if rest:
            run = run[:-width] * power + run[width:]
            width, power = 2 * width, np.uint64((int(power) * int(power)) & 0xFFFFFFFFFFFFFFFF)
    n = len(codes) - gram + 1
    out = out[:n]
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(28))


def _sliding(least: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least (or most) of every ``width`` values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = least(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(texts: list[str], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of each gram that is least in some window of ``least`` characters of its text."""
    sizes = np.array([len(t) for t in texts], dtype="i8")
    codes = _codes("".join(texts))
    if len(codes) < least:
        return (np.empty(0, dtype="i8"),) * 3
    h = gram_hashes(codes, gram)
    width = least - gram + 1
    low = _sliding(np.minimum, h, width)
    ends = np.cumsum(sizes)
    for start, end in zip((ends - sizes).tolist(), ends.tolist()):
        low[max(start, end - least + 1) : end] = 0  # windows that run over the text's end
    pad = np.zeros(width - 1, dtype="u8")
    # no window that a gram is in has a greater least than the gram itself: it is least in one if they are equal
    at = np.flatnonzero((_sliding(np.maximum, np.concatenate([pad, low, pad]), width) == h) & (h != 0))
    which = np.searchsorted(ends, at, side="right")
    return which, at - (ends - sizes)[which], h[at].view("i8")


def _anchor_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """anchor, doc, at."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, texts = frame["doc"].to_numpy(), frame["text"].tolist()
            block = np.cumsum([len(t) for t in texts]) // BLOCK_CHARS
            for k in np.unique(block):
                rows = np.flatnonzero(block == k)
                which, at, h = anchors([texts[i] for i in rows], least, gram)
                yield pd.DataFrame({"anchor": h, "doc": ids[rows][which], "at": at.astype("i4")})

    return docs.mapInPandas(find, "anchor long, doc long, at int")


def _recurring(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """doc, places: the anchors of each document that other documents have too. Documents without any are not in it."""
    found = cut(_anchor_rows(docs, least, gram))
    recurring = found.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("anchor")
    # at most as many as the document is long; a hot anchor's rows are on the left, where the engine splits them
    return cut(found.join(recurring, "anchor", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("anchor", "at")).alias("places")))


def _windows(left: int, size: int, least: int, gram: int) -> range:
    """Where the windows of a context start that hold its anchor, from the anchor's place."""
    return range(max(-left, gram - least), min(0, size - left - least) + 1)


def recurring_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """anchor, passage: texts of at least ``least`` characters, each with an anchor it holds, such that any
    two documents that share a run of that length share one of them. docs: doc, text, places.

    A passage is a longest run of windows around an anchor that the same contexts hold, of two documents at least.
    """
    around = least - gram

    @F.pandas_udf("array<struct<anchor:long,left:int,context:string>>")
    def contexts_of(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, marks in zip(texts, found):
            rows = []
            for m in marks:
                start = max(0, m["at"] - around)
                rows.append({"anchor": m["anchor"], "left": m["at"] - start, "context": text[start : m["at"] + gram + around]})
            out.append(rows)
        return pd.Series(out, dtype=object)

    contexts = docs.select("doc", F.explode(contexts_of("text", "places")).alias("c")).select("doc", "c.*")
    # copies of a context count once: combined before the shuffle
    classes = cut(contexts.groupBy("anchor", "context", "left").agg(F.min("doc").alias("a"), F.max("doc").alias("b")))
    counted = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.min("a").alias("first"), F.max("b").alias("last"))
    # hot anchors are on the left, where the engine splits them
    sized = classes.join(counted.filter(F.col("first") < F.col("last")).select("anchor", "contexts"), "anchor")

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Anchor by anchor, as they come sorted; one may run over from frame to frame."""
        held: list[tuple] = []

        def give() -> pd.DataFrame:
            members: dict[tuple, list[int]] = {}
            for i, (_, x, left, _, _) in enumerate(held):
                for w in _windows(left, len(x), least, gram):
                    members.setdefault((w, x[left + w : left + w + least]), []).append(i)
            runs: dict[tuple, list[int]] = {}  # windows of each set of contexts
            for (w, _), who in members.items():
                if min(held[i][3] for i in who) < max(held[i][4] for i in who):
                    runs.setdefault(tuple(who), []).append(w)
            out = []
            for who, at in runs.items():
                anchor, x, left, _, _ = held[who[0]]
                at = np.sort(np.array(at))
                for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                    out.append((anchor, x[left + run[0] : left + run[-1] + least]))
            return pd.DataFrame(out, columns=["anchor", "passage"])

        for frame in frames:
            for row in zip(frame["anchor"], frame["context"], frame["left"], frame["a"], frame["b"]):
                if held and held[0][0] != row[0]:
                    yield give()
                    held = []
                held.append(row)
        if held:
            yield give()

    few = sized.filter(F.col("contexts") <= CONTEXTS).drop("contexts").repartition("anchor").sortWithinPartitions("anchor", "context", "left")
    confirmed = few.select("anchor", "context", "left", "a", "b").mapInPandas(confirm, "anchor long, passage string")

    # many contexts: windows are grouped by hash, then those of one set of contexts to runs; no task holds an anchor's contexts
    start, stop = F.greatest(-F.col("left"), F.lit(gram - least)), F.least(F.lit(0), F.length("context") - F.col("left") - F.lit(least))
    many = sized.filter((F.col("contexts") > CONTEXTS) & (stop >= start)).withColumn("id", F.xxhash64("anchor", "context", "left"))
    window = F.expr(f"substring(context, left + w + 1, {least})")
    each = many.select("anchor", "id", "a", "b", "context", "left", F.explode(F.sequence(start, stop)).alias("w")).select("anchor", "id", "a", "b", "w", F.xxhash64(window).alias("h"), F.hash(window).alias("g"))
    who = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"), F.min("id").alias("id"), F.min("a").alias("a"), F.max("b").alias("b"))
    shared = each.groupBy("anchor", "w", "h", "g").agg(*who).filter("a < b")
    # windows of a set: as many as a context has at most
    sets = shared.groupBy("anchor", "id", "n", "who").agg(F.array_sort(F.collect_list("w")).alias("at"))
    firsts, lasts = F.filter("at", lambda w: ~F.array_contains("at", w - 1)), F.filter("at", lambda w: ~F.array_contains("at", w + 1))
    runs = sets.select("anchor", "id", F.explode(F.arrays_zip(firsts.alias("s"), lasts.alias("e"))).alias("r"))
    passage = F.expr(f"substring(context, left + r.s + 1, r.e - r.s + {least})")
    windowed = runs.join(many.select("id", "context", "left"), "id").select("anchor", passage.alias("passage"))
    return confirmed.unionByName(windowed)


def locate_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """passage_id, doc, char_start, char_end of every occurrence of every passage in every document. docs: doc, text, places.

    Documents are spread over parts of about PART_CHARS characters. A part gets the passages of the anchors its documents
    have (without an anchor of a passage a document cannot hold it), each once, in automata of about SHARD_CHARS characters.
    """
    ids = cut(passages.distinct().withColumn("passage_id", F.xxhash64("passage")))
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()["chars"]
    parted = docs.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-int(total) // PART_CHARS)))).cast("int"))
    routed = parted.select("part", F.explode("places.anchor").alias("anchor")).distinct()
    wanted = routed.join(ids, "anchor").groupBy("part", "passage_id").agg(F.first("passage").alias("passage"))

    def stream(words: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        found = []
        words = words.sort_values("passage_id")
        for _, own in words.groupby(words["passage"].str.len().cumsum() // SHARD_CHARS):
            machine = ahocorasick.Automaton()
            for pid, passage in zip(own["passage_id"].tolist(), own["passage"].tolist()):
                machine.add_word(passage, (pid, len(passage)))
            machine.make_automaton()
            for doc, text in zip(frame["doc"].tolist(), frame["text"].tolist()):
                found += [(pid, doc, end + 1 - n, end + 1) for end, (pid, n) in machine.iter(text)]
        return pd.DataFrame(found, columns=["passage_id", "doc", "char_start", "char_end"])

    texts = parted.select(F.col("part").alias("of_part"), "doc", "text")
    return wanted.groupBy("part").cogroup(texts.groupBy("of_part")).applyInPandas(stream, "passage_id long, doc long, char_start int, char_end int")


def shared_occurrences(df: DataFrame, key: str, text: str = "text", least: int = LEAST) -> DataFrame:
    """passage_id, doc, char_start, char_end of every passage of ``least`` characters or more that
    stands in more than one document.

    ``key`` is a whole number; rows of one key are one document. Null keys and texts, and texts shorter
    than ``least``, have no occurrences; an empty table gives none.
    """
    gram = least // 2
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= least))
    marked = cut(docs.join(_recurring(docs, least, gram), "doc"))
    located = cut(locate_passages(marked, recurring_passages(marked, least, gram)))
    shared = located.groupBy("passage_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("passage_id")
    return located.join(shared, "passage_id", "left_semi")


def passage_members(occurrences: DataFrame) -> DataFrame:
    """passage_id, doc, documents: what ``sharing_pairs`` says without writing out pairs. A row a passage and document, with the number
    of documents that have the passage; however many they are, none meets the others in a task."""
    members = occurrences.select("passage_id", "doc").distinct()
    counts = members.groupBy("passage_id").agg(F.count(F.lit(1)).alias("documents"))
    return members.join(counts, "passage_id").select("passage_id", "doc", "documents")


def sharing_pairs(occurrences: DataFrame) -> DataFrame:
    """doc_a < doc_b for all documents that share a passage. Of passages that stand in the same documents one is enough."""
    members = occurrences.select("passage_id", "doc").distinct()
    sets = members.groupBy("passage_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("who"), F.bit_xor(F.xxhash64("doc")).alias("also"))
    kept = members.join(sets.groupBy("n", "who", "also").agg(F.min("passage_id").alias("passage_id")).select("passage_id"), "passage_id", "left_semi")
    a, b = (kept.select("passage_id", F.col("doc").alias(x)) for x in ("doc_a", "doc_b"))
    return a.join(b, "passage_id").filter("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def shared_share(df: DataFrame, occurrences: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Of each document: key, n_chars, shared_chars, shared_share, spans (maximal, in order: char_start, char_end)."""
    spans = occurrences.select("doc", "char_start", "char_end").distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("found"))  # bounded by the document
    merged = F.expr("""aggregate(found, cast(array() as array<struct<char_start:int,char_end:int>>), (done, x) ->
        if(size(done) > 0 and x.char_start <= element_at(done, -1).char_end,
           concat(slice(done, 1, size(done) - 1), array(named_struct('char_start', element_at(done, -1).char_start, 'char_end', greatest(element_at(done, -1).char_end, x.char_end)))),
           concat(done, array(x))))""")
    spans = spans.select("doc", merged.alias("spans")).withColumn("shared_chars", F.expr("aggregate(spans, 0, (n, x) -> n + x.char_end - x.char_start)"))
    all_docs = df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    out = all_docs.join(spans, "doc", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    share = F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0)
    return out.select(F.col("doc").alias(key), "n_chars", "shared_chars", share.alias("shared_share"), "spans")
