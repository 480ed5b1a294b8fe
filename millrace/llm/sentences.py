"""Sentence units of texts in any script.

The boundary rules are those of the standard sentence-break properties (STerm,
ATerm, Close, Sp, Lower of UAX #29, taken from the ``regex`` module's character
database, so that every script's terminators are covered), tailored by

* abbreviations per language, after which a full stop does not end a unit,
* quotations: one that opens a unit runs on, one after other words that holds
  the closing mark ends the unit,
* brackets: a bracket inside a unit never ends it, a unit wholly in brackets is one,
* ellipses, list items, blank lines, and Thai and Lao, which have spaces for terminators and are told by
  their letters, whatever the language tag says.

The operator is a narrow map: no shuffle but the removal of repeated rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import free_name
from millrace.llm.lookalikes import LOOKALIKES

# Abbreviations that do not end a unit, by language tag.
ABBREVIATIONS = {
    "eng_Latn": "Mr Mrs Ms Dr Prof Capt Col Gen Lt Sgt Maj Rev Hon Gov Sen Rep Pres Supt St Mt Ft Ave Blvd Rd Jr Sr "
    "vs etc approx e.g i.e cf viz ca al ed eds est dept univ No Nos Vol Fig Figs Sec Ch pp p Eq Art "
    "Inc Ltd Co Corp Bros Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec a.m p.m",
    "hin_Deva": "डॉ रु क्र श्री सं प्रो पं",
    "mar_Deva": "डॉ रु क्र श्री सं प्रो पं",
    "ben_Beng": "ড ডা মো অধ্যা নং প্রো শ্রী",
    "tel_Telu": "డా నం రూ ప్రొ శ్రీ",
    "tam_Taml": "திரு ரூ எண் டாக் பேரா",
    "guj_Gujr": "પ્રો રૂ ડૉ નં શ્રી",
    "urd_Arab": "ص ج ڈاکٹر",
    "kan_Knda": "ಡಾ ಶ್ರೀ ಪ್ರೊ ಸಂ ರೂ",
    "pan_Guru": "ਡਾ ਸ਼੍ਰੀ ਪ੍ਰੋ ਨੰ ਰੁ",
    "mal_Mlym": "ഡോ ശ്രീ പ്രൊ നം രൂ",
    "ory_Orya": "ଡା ଶ୍ରୀ ପ୍ରୋ ନଂ",
    "rus_Cyrl": "ул пр пл г гг т тт руб коп стр рис см им обл проф акад напр",
}
# Languages whose abbreviations are those of the public locale data, by the first part of their tags.
LOCALES = {"deu": "de", "spa": "es", "fra": "fr", "ita": "it", "por": "pt", "rus": "ru"}
# Abbreviations that end a unit unless a lower-case letter follows.
MAY_END = frozenset("etc a.m p.m".split())
_ABBREVIATIONS = {tag: frozenset(words.split()) for tag, words in ABBREVIATIONS.items()}
_ALL_ABBREVIATIONS = frozenset().union(*_ABBREVIATIONS.values())

# The languages written with a danda, where a vertical bar stands for one.
BAR_IS_DANDA = frozenset({"hin_Deva", "mar_Deva", "ben_Beng"})
# Paired marks. A straight double quote opens and closes.
PAIRS = {
    "“": "”", "‘": "’", "«": "»", "‹": "›", "„": "“", "「": "」", "『": "』", "(": ")", "[": "]", "{": "}",
    "（": "）", "［": "］", "【": "】", "《": "》", "〈": "〉", "〔": "〕",
}
QUOTES = frozenset("“‘«‹„「『《〈\"")
_CLOSERS = frozenset(PAIRS.values()) | {'"'}
_OPENERS = {c: "".join(a for a, b in PAIRS.items() if b == c) for c in PAIRS.values()} | {'"': '"'}

_INVISIBLE = r"\p{Cf}­"
_BLANK = regex.compile(r"(?:\r\n|[\n\r\x85 ])[^\S\n\r\x85  ]*(?:(?:\r\n|[\n\r\x85 ])[^\S\n\r\x85  ]*)+| \s*")
_ITEM = regex.compile(
    r"(?:\r\n|[\n\r\x85 ])(?=[^\S\n\r]*(?:[-*+•‣◦▪·–—]|\(?(?:\p{Nd}{1,3}|\p{L}|[ivxlcdm]{1,5})[.)．）]|[①-⑳]|\p{Nd}{1,3}、)[^\S\n\r]+\S|[^\S\n\r]*(?:#{1,6}[^\S\n\r]+\S|[•‣◦▪]\S))"
)
_MARKER = regex.compile(r"\s*(?:[-*+•‣◦▪·–—]|\(?(?:\p{Nd}{1,3}|\p{L}|[ivxlcdm]{1,5})[.)．）])[^\S\n\r]+")
#: Terminators (STerm and ATerm) with ellipses, and the marks that open and close.
_EVENT = regex.compile(
    r"(?P<term>[\p{SB=STerm}\p{SB=ATerm}…‥\|](?:[%s]*[\p{SB=STerm}\p{SB=ATerm}…‥\|])*)|(?P<mark>[“”‘’«»‹›„「」『』\"()\[\]{}（）［］【】《》〈〉〔〕])" % _INVISIBLE
)
_ELLIPSIS = regex.compile(r"^[.．…‥%s]*$" % _INVISIBLE)
_WORD = regex.compile(r"(?r)[\p{L}\p{M}\p{N}%s](?:[\p{L}\p{M}\p{N}.'’%s]*[\p{L}\p{M}\p{N}%s])?" % ((_INVISIBLE,) * 3))
_INITIAL = regex.compile(r"(?:\p{Lu}\.)*\p{Lu}")
#: Terminators that need no space after them.
_WIDE = regex.compile(r"[^\x00-\x7f\p{SB=ATerm}…‥]")
_NEXT = regex.compile(r"[\s%s\p{Ps}\p{Pi}\p{Pf}\p{Pe}\"'*_-]*" % _INVISIBLE)
_THAI_GAP = regex.compile(r"[^\S\n\r]+|(?:\r\n|[\n\r])[^\S\n\r]*")
_VISIBLE = regex.compile(r"[^\s%s]" % _INVISIBLE)
_STRIP = regex.compile(r"[%s]" % _INVISIBLE)


def _pairs(text: str, start: int, end: int) -> dict[int, int]:
    """Where each opening mark of the paragraph closes; marks without a partner are left out."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # of each opening mark, where it lies in the stack

    def close(marks: str, at: int) -> bool:
        opened = max((places[m][-1] for m in marks if places.get(m)), default=-1)
        if opened < 0:
            return False
        found[stack[opened][1]] = at
        while len(stack) > opened:  # marks inside it that did not close have no partner
            places[stack.pop()[0]].pop()
        return True

    for m in _EVENT.finditer(text, start, end):
        if m.lastgroup != "mark":
            continue
        c, at = m.group(), m.start()
        if c == "’" and 0 < at < end - 1 and text[at - 1].isalnum() and text[at + 1].isalnum():
            continue  # an apostrophe
        if close(_OPENERS.get(c, ""), at):
            continue
        if c in PAIRS or c == '"':
            places.setdefault(c, []).append(len(stack))
            stack.append((c, at))
    return found


_FOLD = str.maketrans(LOOKALIKES)


def _plain(word: str) -> str:
    """Without invisible characters and, in Latin script, look-alikes."""
    word = unicodedata.normalize("NFKC", _STRIP.sub("", word))
    return word.translate(_FOLD) if any(c.isascii() and c.isalpha() for c in word) else word


@lru_cache(maxsize=2)
def locale_abbreviations(spark: SparkSession) -> dict[str, list[str]]:
    """Of each of LOCALES the abbreviations that end no sentence, from the locale data of the library that Spark brings along."""
    bundles = spark.sparkContext._jvm.com.ibm.icu.util.UResourceBundle
    out = {}
    for language, locale in LOCALES.items():
        words = bundles.getBundleInstance("com/ibm/icu/impl/data/icudata/brkitr", locale).get("exceptions").get("SentenceBreak")
        out[language] = sorted(words.getString(i).rstrip(".") for i in range(words.getSize()))
    return out


def _abbreviated(text: str, start: int, at: int, language: str | None, more: frozenset[str]) -> bool:
    """Whether the word that ends before ``at`` is an abbreviation or an initial."""
    m = _WORD.search(text, start, at)
    if not m or m.end() != at:
        return False
    word = _plain(m.group())
    if word in more or word in _ABBREVIATIONS.get(language or "", _ALL_ABBREVIATIONS):
        return True
    return bool(_INITIAL.fullmatch(word))


def _paragraph(text: str, start: int, end: int, language: str | None, latin: bool, more: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Units of text[start:end], which holds no blank line and no list item but at its start."""
    pairs = _pairs(text, start, end)
    closing = set(pairs.values())
    unit = start
    m = _MARKER.match(text, start, end)
    skip = m.end() if m else start
    first = _VISIBLE.search(text, skip, end)
    opener = first.start() if first else start
    last = start
    for m in _EVENT.finditer(text, start, end):
        at = m.start()
        if at < skip or at < last:
            continue
        if m.lastgroup == "mark":
            # nothing inside a pair ends a unit; what its closing mark does is decided at its end
            if at in pairs:
                close = pairs[at]
                last = close + 1
                inside = close - 1
                while inside > at and (text[inside] in _CLOSERS or not _VISIBLE.match(text[inside])):
                    inside -= 1
                held = _EVENT.match(text[inside])
                if not held or held.lastgroup != "term" or text[inside] in "…‥" or (text[inside] in ".．" and text[inside - 1] in ".．"):
                    continue
                if at == opener:
                    if text[at] in QUOTES or not _alone(text, close + 1, end):
                        continue
                elif text[at] not in QUOTES:
                    continue
                stop = close + 1
            else:
                continue
        else:
            term = m.group()
            stop = m.end()
            if "|" in term and (language not in BAR_IS_DANDA or not _gap(text, stop, end)):
                continue
            if not _gap(text, stop, end) and _joined(text, at, stop, term):
                continue
        # closing marks belong to the unit
        while stop < end and ((text[stop] in _CLOSERS and text[stop] != '"' and stop not in pairs) or (text[stop] == '"' and stop in closing)):
            stop += 1
        following = _VISIBLE.search(text, stop, end)
        if following is None:
            break
        if m.lastgroup == "term":
            term = m.group()
            if _ELLIPSIS.match(term) and len(_STRIP.sub("", term)) >= (1 if term[0] in "…‥" else 2):
                n = following.start()
                if not latin or text[n].islower():
                    continue
            elif set(term) <= set(".．۔") or _STRIP.sub("", term) in (".", "۔", "．"):
                n = _NEXT.match(text, stop, end).end()
                if _abbreviated(text, unit, at, language, more) and not (n < end and _may_end(text, unit, at) and _starts(text, n, end)):
                    continue
                if n < end and text[n].islower() and not text[n + 1 : n + 2].isupper():
                    continue
            if _continues(text, following.start()):
                continue
        yield unit, stop
        last = stop
        unit = following.start()
        opener = unit
    yield unit, end


def _joined(text: str, at: int, stop: int, term: str) -> bool:
    """Whether a terminator without space after it stands inside a word or number (SB6, SB7, SB8)."""
    if _WIDE.search(term):
        return False
    before, after = text[at - 1 : at], text[stop : stop + 1]
    if set(term) & set("!?"):
        return not (before.isalnum() or _MARK.match(before)) or not after.isalpha() and after not in PAIRS and after != '"' or bool(_ASCII_LOWER.match(after))
    if len(term) > 1 or not after.isalpha() or after.islower():
        return True
    if before.isupper() or not (before.isalpha() or _MARK.match(before)):
        return True
    # SB7 is tailored: texts that lack the space after a full stop are usual, so only parts of one abbreviation (z.B., Ph.D.) are joined
    return before.islower() and (not text[at - 2 : at - 1].isalpha() or (not text[at - 3 : at - 2].isalpha() and bool(_SHORT.match(text, stop))))


_MARK = regex.compile(r"\p{M}")
_SHORT = regex.compile(r"\p{L}\.")
_ASCII_LOWER = regex.compile(r"[a-z]")


def _may_end(text: str, start: int, at: int) -> bool:
    m = _WORD.search(text, start, at)
    return bool(m) and _plain(m.group()) in MAY_END


def _starts(text: str, at: int, end: int) -> bool:
    """Whether a new sentence may start there: anything but a lower-case letter, or a brand like xY."""
    return not text[at].islower() or text[at + 1 : at + 2].isupper()


def _continues(text: str, at: int) -> bool:
    """A comma, colon, semicolon or dash-free continuation after a terminator (SContinue)."""
    return text[at] in ",;:，、；："


def _alone(text: str, at: int, end: int) -> bool:
    """Whether a bracket that opened the unit ends there: what follows is a new sentence."""
    n = _VISIBLE.search(text, at, end)
    return n is None or _starts(text, n.start(), end)


_GAP = regex.compile(r"[%s]*(?:[\p{SB=Close}\p{Pe}\p{Pf}\"'][%s]*)*(?:\s|\Z)" % ((_INVISIBLE,) * 2))


def _gap(text: str, at: int, end: int) -> bool:
    return bool(_GAP.match(text, at, end)) or at >= end


_WESTERN = regex.compile(r"[\p{N}\p{Latin}\p{Greek}\p{Cyrillic}]")


def _thai(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spaces end units, but for those beside numbers and words of Latin script."""
    pairs = _pairs(text, start, end)
    unit, shut = start, start
    opened = iter(sorted(pairs))
    upcoming = next(opened, end)
    m = _MARKER.match(text, start, end)
    for g in _THAI_GAP.finditer(text, m.end() if m else start, end):
        while upcoming < g.start():  # the furthest that a pair opened before the gap reaches
            shut = max(shut, pairs[upcoming])
            upcoming = next(opened, end)
        if g.start() < shut or text[g.start()] in "\n\r":
            continue
        before, after = _VISIBLE_BACK.search(text, start, g.start()), _VISIBLE.search(text, g.end(), end)
        if not before or not after or _WESTERN.match(before.group()) or _WESTERN.match(after.group()):
            continue
        yield unit, g.start()
        unit = g.end()
    yield unit, end


_VISIBLE_BACK = regex.compile(r"(?r)[^\s%s]" % _INVISIBLE)


_THAI_LAO = regex.compile(r"[\p{Thai}\p{Lao}]+")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def _unspaced(text: str, start: int, end: int) -> bool:
    """Whether most letters of the paragraph are of scripts that have no terminators."""
    if not _THAI_LAO.search(text, start, end):
        return False
    size = lambda p: sum(m.end() - m.start() for m in p.finditer(text, start, end))
    return 2 * size(_THAI_LAO) > size(_LETTERS)


def sentence_units(text: str | None, language: str | None, more: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """(start, end) of each unit in characters, without outer white space. Null or blank text: none. ``more``: further abbreviations."""
    if not text or not text.strip():
        return []
    cuts = sorted({(m.start(), m.end()) for m in _BLANK.finditer(text)} | {(m.start(), m.end()) for m in _ITEM.finditer(text)})
    out: list[tuple[int, int]] = []
    at = 0
    latin = (language or "").endswith("_Latn") or not language
    for a, b in [*cuts, (len(text), len(text))]:
        if a >= at and text[at:a].strip():
            spaced = language == "tha_Thai" or _unspaced(text, at, a)
            for s, e in _thai(text, at, a) if spaced else _paragraph(text, at, a, language, latin, more):
                piece = text[s:e]
                s += len(piece) - len(piece.lstrip())
                e -= len(piece) - len(piece.rstrip())
                if s < e:
                    out.append((s, e))
        at = max(at, b)
    return out


def split_sentences(df: DataFrame, text: str = "text", language: str = "language", keep: list[str] | None = None) -> DataFrame:
    """One row per sentence unit of each row of ``df``.

    Output: the columns of ``keep`` (all but ``text`` if None), sentence_no (from 0), text,
    char_start, char_end (characters, end exclusive). Null and blank texts have no units; a null
    language uses every language's abbreviations; repeated rows give repeated units. A kept column
    whose name clashes with an output column is left out.
    """
    made = ("sentence_no", "text", "char_start", "char_end")
    kept = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c not in made]
    col, tag, units = (free_name(df, x) for x in ("_text", "_language", "_units"))

    more = locale_abbreviations(df.sparkSession)

    @F.pandas_udf("array<struct<sentence_no:int,text:string,char_start:int,char_end:int>>")
    def units_of(texts: pd.Series, tags: pd.Series) -> pd.Series:
        known = {language: frozenset(words) for language, words in more.items()}
        return pd.Series(
            [[{"sentence_no": i, "text": t[s:e], "char_start": s, "char_end": e} for i, (s, e) in enumerate(sentence_units(t, g, known.get((g or "")[:3], frozenset())))] for t, g in zip(texts, tags)],
            dtype=object,
        )

    rows = df.select(*kept, F.col(text).alias(col), F.col(language).alias(tag)).filter(F.col(col).isNotNull())
    return rows.select(*kept, F.explode(units_of(F.col(col), F.col(tag))).alias(units)).select(*kept, f"{units}.*")
