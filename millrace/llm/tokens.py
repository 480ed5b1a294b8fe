"""Token counts of texts under a byte-level BPE vocabulary, and totals by slice.

Texts fall into pieces by the tokenizer's pattern (in the JVM). Distinct pieces are partitioned by
their first characters and sorted, which makes every partition a prefix trie walked depth first: the
exact tokenization state of a shared prefix (the last token and the number of tokens at each byte) is
carried on, and only what a piece adds is computed. The terminal counts are joined to the documents: those of the
commonest pieces, of which the number is bounded, are broadcast and summed where the text lies, so that no piece is
hot in a shuffle; of the others each text sends every distinct piece once.

State: of a prefix, the one token that can end its encoding. Token b may follow token a if encoding
their bytes together gives them back; an encoding is right if all its neighbours may follow each
other, so the encoding of a longer prefix follows from those of the shorter ones.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import DENSE_SCRIPTS, estimate_from
from millrace.plans.lineage import cut

TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern of pieces, with white space by its Unicode property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Characters of a piece by which pieces are partitioned.
PREFIX = 4
#: The most pieces, the commonest, of which the counts are broadcast, with some 60 bytes each.
COMMON_PIECES = 500_000


class Bpe:
    """Incremental exact BPE over one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tails: dict[bytes, set[int]] = {}
        for token in ranks:
            tails.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the tokens that end in three given bytes, the longest first.
        self.tails = {t: sorted(n, reverse=True) for t, n in tails.items() if len(t) == 3}
        self.bytes = {r: b for b, r in ranks.items()}
        self.merges: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merge_below(token, rank)
            if len(parts) == 2:
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.halves[rank], self.merges[pair] = pair, rank
            else:
                self.halves[rank] = None
        self._follows: dict[tuple[int, int], bool] = {}

    def _merge_below(self, token: bytes, rank: int) -> list[bytes]:
        """What BPE makes of the token's bytes with the merges before its own."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a: no merge across them comes before one inside them."""
        known = self._follows.get((a, b))
        if known is None:
            known = self._follows[a, b] = self._may_follow(a, b)
            if len(self._follows) > 4_000_000:
                self._follows.clear()
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        # Merges are undone latest first. `before` is the rank a merge across must beat to be chosen:
        # that of the last merge undone; at equal rank the left of two merges comes first.
        before = float("inf")
        while True:
            across = self.merges.get((a, b))
            if across is not None and across < before:
                return False
            undo_left = self.halves[a] is not None and (self.halves[b] is None or a > b)
            if undo_left:
                before, a = a, self.halves[a][1]
            elif self.halves[b] is not None:
                before, b = b + 0.5, self.halves[b][0]
            else:
                return True

    def extend(self, piece: bytes, shared: int, last: list[int], count: list[int]) -> None:
        """Fills the states of the piece's prefixes longer than ``shared`` bytes; last[i], count[i] are those of i bytes."""
        del last[shared + 1 :], count[shared + 1 :]
        get, follows, tails = self.ranks.get, self.follows, self.tails
        for end in range(shared + 1, len(piece) + 1):
            for n in (*tails.get(piece[end - 3 : end], ()), 2, 1) if end > 2 else (2, 1)[2 - end :]:
                if n > end:
                    continue
                start = end - n
                token = get(piece[start:end])
                if token is not None and (not start or (last[start] >= 0 and follows(last[start], token))):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:  # inside what no token of the vocabulary covers
                last.append(-1)
                count.append(0)


@lru_cache(maxsize=2)
def load_bpe(path: str) -> Bpe:
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


@lru_cache(maxsize=1 << 16)
def _dense(c: str) -> bool:
    return bool(_dense_pattern().match(c))


@lru_cache
def _dense_pattern():
    import regex

    return regex.compile("[" + "".join(rf"\p{{{s}}}" for s in DENSE_SCRIPTS) + "]")


def piece_column(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def _keys(column: str, first: str, second: str) -> list[Column]:
    """96 bits that stand for a value where it is joined."""
    return [F.xxhash64(column).alias(first), F.hash(column).alias(second)]


def trie_counts(pieces: DataFrame, vocabulary: str | None) -> DataFrame:
    """h, g, n, tokens, chars, dense of each distinct ``piece`` (with n, h, g). Tokens is null without a vocabulary."""
    spread = pieces.repartition(F.substring("piece", 1, PREFIX)).sortWithinPartitions("piece")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load_bpe(vocabulary) if vocabulary else None
        before, before_bytes = "", b""
        last, count = [-1], [0]  # states of the bytes so far
        dense = [0]  # dense characters of each prefix, in characters
        for frame in frames:
            tokens, denses, chars = [], [], []
            for piece in frame["piece"].tolist():
                same = len(os.path.commonprefix((before, piece)))
                del dense[same + 1 :]
                for c in piece[same:]:
                    dense.append(dense[-1] + _dense(c))
                if bpe:
                    coded = piece.encode()
                    shared = len(os.path.commonprefix((before_bytes, coded)))
                    bpe.extend(coded, shared, last, count)
                    tokens.append(count[-1])
                    before_bytes = coded
                chars.append(len(piece))
                denses.append(dense[-1])
                before = piece
            yield pd.DataFrame({"h": frame["h"], "g": frame["g"], "n": frame["n"], "tokens": pd.array(tokens if bpe else [None] * len(frame), dtype="Int32"), "chars": chars, "dense": denses})

    return spread.mapInPandas(walk, "h long, g int, n long, tokens int, chars int, dense int")


def _common_from(counts: DataFrame) -> int:
    """The least number of occurrences, a power of two, that no more than COMMON_PIECES pieces have."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = {r["power"]: r["pieces"] for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("pieces")).collect()}  # 63 rows at most
    taken, least = 0, 1 << (max(sizes, default=0) + 1)
    for p in sorted(sizes, reverse=True):
        taken += sizes[p]
        if taken > COMMON_PIECES:
            break
        least = 1 << p
    return least


def count_tokens(df: DataFrame, key: str, text: str = "text", vocabulary: str | None = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Of each key: tokens, chars, dense_chars, estimate.

    Keys are unique (drop repeated rows before). Null and empty texts count 0; a null key is one key.
    Without a vocabulary tokens are null, and the estimate alone is of use.
    """
    texts = df.select(F.col(key).alias("key"), *_keys(key, "a", "b"), F.col(text).alias("text"))
    occurring = texts.select("a", "b", F.explode(piece_column(F.col("text"))).alias("piece"))
    distinct = occurring.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).select("piece", "n", *_keys("piece", "h", "g"))
    counts = cut(trie_counts(distinct, vocabulary))
    least = _common_from(counts)
    measures = ("tokens", "chars", "dense")
    common = counts.filter(F.col("n") >= least).select("h", "g", *measures, F.lit(True).alias("common"))
    # keys and pieces travel as 96 bits each; a text's common pieces are one row, each of its other pieces another
    terms = occurring.select("a", "b", *_keys("piece", "h", "g")).join(F.broadcast(common), ["h", "g"], "left")
    # the row of common pieces has no piece: it goes by its text, and finds no count
    piece = [F.when(F.col("common"), F.col("a")).otherwise(F.col("h")).alias("h"), F.when(F.col("common").isNull(), F.col("g")).alias("g")]
    held = terms.select("a", "b", *piece, *measures).groupBy("a", "b", "h", "g").agg(F.count(F.lit(1)).alias("times"), *(F.sum(c).alias(f"_{c}") for c in measures))
    rare = counts.filter(F.col("n") < least).select("h", "g", *measures)
    joined = held.join(rare, ["h", "g"], "left")
    summed = joined.groupBy("a", "b").agg(*(F.sum(F.coalesce(F.col(c) * F.col("times"), F.col(f"_{c}"))).alias(c) for c in measures))
    filled = texts.select("key", "a", "b").join(summed, ["a", "b"], "left").select(
        "key", (F.coalesce("tokens", F.lit(0)) if vocabulary else F.col("tokens")).cast("long").alias("tokens"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("dense", F.lit(0)).alias("dense_chars")
    )
    return filled.select(F.col("key").alias(key), "tokens", "chars", "dense_chars", estimate_from(F.col("chars"), F.col("dense_chars")).alias("estimate"))


def token_totals(counted: DataFrame, slices: list[list[str]]) -> DataFrame:
    """slice (the columns' names), value (theirs, joined by |), texts, tokens, chars, for each of ``slices``; [] is the total.

    Null values are written as (none).
    """
    structs = []
    for columns in slices:
        values = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in columns]
        structs.append(F.struct(F.lit("|".join(columns) or "all").alias("slice"), (F.concat_ws("|", *values) if values else F.lit("all")).alias("value")))
    # combined on the map side, so that a slice of a third of all rows is no hot key
    return counted.select("tokens", "chars", F.inline(F.array(*structs))).groupBy("slice", "value").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))
