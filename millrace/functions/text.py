"""Text expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts whose text makes more tokens a character.
DENSE_SCRIPTS = ("Devanagari", "Bengali", "Tamil", "Telugu", "Kannada", "Malayalam", "Gujarati", "Gurmukhi", "Oriya", "Arabic", "Han", "Hiragana", "Katakana")
# Characters a token in text without and with dense scripts.
CHARS_PER_TOKEN, DENSE_LOSS = 4.0, 1.4
# The scripts that are told apart, the first winning a tie.
SCRIPTS = ("Latin", "Devanagari", "Bengali", "Tamil", "Telugu", "Kannada", "Malayalam", "Gujarati", "Gurmukhi", "Oriya", "Arabic")
# English words without content.
STOPWORDS = (
    "a an the and or but if then than so because as of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further once here there when where why how all any both each few more most other some such no nor "
    "not only own same too very can will just should now is are was were be been being have has had having do does did doing would could shall "
    "may might must i you he she it we they me him her them my your his its our their this that these those what which who whom whose"
).split()
# Display names of language tags.
LANGUAGE_NAMES = {
    "eng_Latn": "English", "asm_Beng": "Assamese", "ben_Beng": "Bengali", "brx_Deva": "Bodo", "doi_Deva": "Dogri", "gom_Deva": "Konkani", "guj_Gujr": "Gujarati", "hin_Deva": "Hindi",
    "kan_Knda": "Kannada", "kas_Arab": "Kashmiri", "mai_Deva": "Maithili", "mal_Mlym": "Malayalam", "mar_Deva": "Marathi", "mni_Beng": "Manipuri", "npi_Deva": "Nepali", "ory_Orya": "Odia",
    "pan_Guru": "Punjabi", "san_Deva": "Sanskrit", "sat_Olck": "Santali", "snd_Arab": "Sindhi", "tam_Taml": "Tamil", "tel_Telu": "Telugu", "urd_Arab": "Urdu",
}

_DENSE = "[" + "".join(rf"\p{{Is{s}}}" for s in DENSE_SCRIPTS) + "]+"
#: White space as Unicode has it; Java's \s is ASCII only.
SPACE = r"[\p{IsWhite_Space}\x{FEFF}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row: inside the functions of arrays an expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dense_length(text: Column) -> Column:
    """Characters of dense scripts in ``text``."""
    return F.length(text) - F.length(F.regexp_replace(text, _DENSE, ""))


def estimate_from(chars: Column, dense: Column) -> Column:
    """The token estimate of a text with so many characters, of which so many are of dense scripts."""
    per = F.lit(CHARS_PER_TOKEN) - dense.cast("double") / chars.cast("double") * F.lit(DENSE_LOSS)
    return F.when(F.coalesce(chars, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(chars.cast("double") / per).cast("int"))).cast("int")


def estimate_tokens(text: Column) -> Column:
    """The token estimate of a text; null or empty: 0."""
    return estimate_from(F.length(text), dense_length(text))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(text: Column) -> Column:
    """Zero-width characters out, line ends to line feeds, runs of spaces and tabs to one, three or more line feeds to two, ends stripped."""
    steps = ((r"[\x{200B}-\x{200D}\x{FEFF}]", ""), (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
    return strip(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text))


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, digits and marks, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), lambda t: t != "")


def content_tokens(text: Column) -> Column:
    """Tokens of more than one character that are no stopwords; repeated ones stay."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokenize(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def coverage(needles: Column, haystack: Column) -> Column:
    """Share of the needles, repeated ones counted, that are in the haystack; 0 without needles."""
    return let(F.struct(needles.alias("n"), haystack.alias("h")), lambda x: F.when(F.size(x["n"]) == 0, 0.0).otherwise(F.size(F.filter(x["n"], lambda t: F.array_contains(x["h"], t))) / F.size(x["n"])))


def cut_at_word(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, ended at the last space if that is beyond three fifths of them."""
    head = F.substring(text, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))  # place of the last space, from 0
    return F.when((F.locate(" ", head) > 0) & (space > limit * 0.6), F.substring(head, F.lit(1), space)).otherwise(head)


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word where there is one, with an ellipsis if cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut_at_word(text, limit), f"{SPACE}+$", ""), F.lit("…")))


def clamp_query(query: Column, limit: int = 512) -> Column:
    """A stripped query of at most ``limit`` characters."""
    whole = strip(query)
    return F.when(F.length(whole) <= limit, whole).otherwise(cut_at_word(whole, limit))


def trigrams(text: Column) -> Column:
    """The set of runs of three characters, lower case, white space collapsed."""
    plain = strip(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))
    grams = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - 2)), lambda i: F.substring(p, i, F.lit(3)))
    return let(plain, lambda p: F.when(F.length(p) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(grams(p))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, else the Jaccard share of their trigrams; 0 if one is empty."""
    empty = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    shared = let(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")), lambda x: jaccard(x["a"], x["b"]))
    return F.when(empty, 0.0).when(a == b, 1.0).otherwise(shared)


def script_of(text: Column) -> Column:
    """The script that most characters are of; Unknown if none is of a known one."""
    counts = [F.length(text) - F.length(F.regexp_replace(text, rf"\p{{Is{s}}}+", "")) for s in SCRIPTS]
    best = F.greatest(*counts)
    at = F.array_position(F.array(*counts), best).cast("int")
    return F.when(F.coalesce(best, F.lit(0)) == 0, "Unknown").otherwise(F.element_at(F.array(*map(F.lit, SCRIPTS)), at))


def nfkc(text: Column) -> Column:
    """The compatibility composition of a text, by the Unicode library that Spark brings along: in the JVM."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.isNotNull(), composed)


def cache_form(query: Column) -> Column:
    """A query as caches identify it: compatibility forms made one (NFKC), lower case, white space collapsed, closing marks off."""
    plain = strip(F.regexp_replace(F.lower(nfkc(query)), f"{SPACE}+", " "))
    return strip(F.regexp_replace(plain, "[?!.।]+$", ""))


def metadata_header(topic: Column, language: Column, source: Column) -> Column:
    """[topic: … | language: … | source: …], without empty parts; empty if all are."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    joined = F.concat_ws(" | ", part("topic", topic), part("language", language), part("source", source))
    return F.when(joined == "", "").otherwise(F.concat(F.lit("["), joined, F.lit("]")))


def with_header(header: Column, text: Column) -> Column:
    return F.when(header == "", text).otherwise(F.concat(header, F.lit("\n"), text))


def topic_of(query: Column, topic: Column, text: Column) -> Column:
    """The query, else the topic, without leading dots and blanks, in 90 characters; without either the text's first 60."""
    given = strip(F.coalesce(query, topic, F.lit("")))
    return F.when(given != "", truncate(F.regexp_replace(given, rf"^(?:\.|{SPACE})+", ""), 90)).otherwise(truncate(strip(text), 60))


def uuid_of(key: Column) -> Column:
    """A name-based UUID (version 5 layout) from the SHA-1 of ``key``."""
    h = F.sha1(key)
    part = lambda at, n: F.substring(h, at, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def language_name(tag: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, tag), tag)


def strip_html(html: Column) -> Column:
    """Tags to spaces, six entities to their characters, white space collapsed."""
    entities = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&nbsp;", " "))
    plain = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), entities, F.regexp_replace(html, "<[^>]+>", " "))
    return strip(F.regexp_replace(plain, f"{SPACE}{{2,}}", " "))


def snippet_of(html: Column, limit: int = 800) -> Column:
    """Stripped text of at most ``limit`` characters, cut at the last space, with an ellipsis."""
    text = strip_html(html)
    head = F.substring(text, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    # without a space all but the last character stays
    cut = F.when(F.locate(" ", head) > 0, F.substring(head, F.lit(1), space)).otherwise(F.substring(head, 1, limit - 1))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def speech_text(text: Column, limit: int | None = 2500) -> Column:
    """What is read aloud: no code blocks, citation marks, link targets and markup. Without a limit the whole of it."""
    steps = ((r"```[\s\S]*?```", " "), (r"\[\d+\](\[\d+\])*", " "), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_~`>#|]", " "), (f"{SPACE}+", " "))
    spoken = strip(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text))
    return spoken if limit is None else F.substring(spoken, 1, limit)


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+\]", " ")


def sentences(text: Column) -> Column:
    """Rough sentence spans for chunking: array of (text, start, end), end exclusive.

    A run of terminators with the quotes and brackets after it ends a span; offsets tile the text
    from its start to the last span's end. Spans of fewer than four estimated tokens are added to the
    one before. A blank text has none.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?。！？…॥।؟۔]*[.!?。！？…॥।؟۔]+[.!?。！？…॥।؟۔\"'”’)\]]*|[^.!?。！？…॥।؟۔]+$"), F.lit(0))
    span = "struct<text:string,start:int,end:int>"
    # positions by a running length, then blank pieces out
    placed = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.when(strip(p) == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(strip(p).alias("text"), s["at"].alias("start"), (s["at"] + F.length(p)).alias("end"))))).alias("out"),
        ),
        lambda s: s["out"],
    )
    last = lambda out: F.try_element_at(out, F.lit(-1))
    merged = F.aggregate(
        placed,
        F.array().cast(f"array<{span}>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (estimate_tokens(s["text"]) < 4),
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.concat_ws(" ", last(out)["text"], s["text"]).alias("text"), last(out)["start"].alias("start"), s["end"].alias("end")))),
        ).otherwise(F.concat(out, F.array(s))),
    )
    return F.when(strip(text) == "", F.array().cast(f"array<{span}>")).otherwise(merged)
