"""Letters and marks of different characters that are drawn alike: fixed ones, and those of the public confusables data."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import SparkSession

# Letters of other scripts, and marks, drawn like those beside them.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "ϲ": "c", "ϳ": "j", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "Ⅰ": "I",
    "ک": "ك", "ی": "ي", "ى": "ي",
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "﹘": "-", "ʼ": "’", "＇": "'", "∶": ":", "։": ":", "׃": ":", "꞉": ":", "٫": ",", "‚": ",", "⁄": "/", "∕": "/",
}
# Blocks of the scripts whose letters the confusables data may make Latin: Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu.
BLOCKS = ((0x370, 0x530), (0x531, 0x588), (0x13A0, 0x13FE), (0x1C80, 0x1C89), (0x2C80, 0x2CF4), (0xA4D0, 0xA4F8), (0xA640, 0xA698), (0xAB70, 0xABC0))
# Letters that the data calls alike but that are drawn otherwise: without the dot, rounder, with another stroke.
UNLIKE = frozenset("ιυγσϒϜϱгҽӏꙇꭵⲅ")


@lru_cache(maxsize=2)
def _skeletons(spark: SparkSession, text: str) -> tuple[str, ...]:
    """The skeleton (UTS #39) of each character of ``text``, by the library that Spark brings along."""
    package = spark.sparkContext._jvm.com.ibm.icu.text
    checker = getattr(package, "SpoofChecker$Builder")().setChecks(package.SpoofChecker.CONFUSABLE).build()
    return tuple(checker.getSkeleton("\n".join(text)).split("\n"))


def lookalikes(spark: SparkSession) -> dict[str, str]:
    """Characters and the plain one that is drawn alike.

    A letter of the blocks becomes the Latin letter of its own case that has the same skeleton; letters of
    scripts without case the capital. Mathematical and other styled letters become plain ones by their decomposition.
    """
    latin = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    others = "".join(chr(c) for a, b in BLOCKS for c in range(a, b) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo"))
    skeletons = _skeletons(spark, latin + others)
    plain = {(s, c.islower()): c for c, s in zip(latin, skeletons)}
    found = {c: plain.get((s, c.islower())) for c, s in zip(others, skeletons[len(latin) :]) if c not in UNLIKE}
    styled = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x2100, 0x2150), *range(0x1D400, 0x1D800)) if unicodedata.decomposition(chr(c)).startswith("<font>")}
    alike = {c: p for c, p in found.items() if p} | LOOKALIKES
    return {c: alike.get(p, p) for c, p in styled.items() if len(p) == 1} | alike
