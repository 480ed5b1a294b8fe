"""Numbers as they are shown. Null, NaN and infinite ones are a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import SPACE, strip

DASH = "—"


def _shown(x: Column, text: Column) -> Column:
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, text).otherwise(F.lit(DASH))


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint").cast("string")


def milliseconds(x: Column) -> Column:
    seconds = F.when(x < 10_000, F.format_string("%.2fs", x / 1000)).otherwise(F.format_string("%.1fs", x / 1000))
    minutes_ = F.concat(F.floor(x / 60_000).cast("string"), F.lit("m "), _whole((x - F.floor(x / 60_000) * 60_000) / 1000), F.lit("s"))
    return _shown(x, F.when(x < 1, "<1ms").when(x < 1000, F.concat(_whole(x), F.lit("ms"))).when(x < 60_000, seconds).otherwise(minutes_))


def percent(x: Column, digits: int = 0) -> Column:
    return _shown(x, F.format_string(f"%.{digits}f%%", x * 100))


def grouped_number(x: Column) -> Column:
    return _shown(x, F.format_number(F.floor(x + 0.5), 0))


def compact(x: Column) -> Column:
    """12.4K, 3.1M and so on; below a thousand the number with all its digits."""
    size = F.abs(x)
    unit = F.when(size >= 1e9, F.lit(1e9)).when(size >= 1e6, F.lit(1e6)).otherwise(F.lit(1e3))
    name = F.when(size >= 1e9, "B").when(size >= 1e6, "M").otherwise("K")
    return _shown(x, F.when(size < 1000, F.regexp_replace(x.cast("string"), r"\.0$", "")).otherwise(F.concat(F.regexp_replace(F.format_string("%.1f", x / unit), r"\.0$", ""), name)))


def size_in_bytes(x: Column) -> Column:
    unit = F.least(F.lit(3), F.floor(F.log(2.0, F.greatest(x, F.lit(1.0))) / 10)).cast("int")
    scaled = x / F.pow(F.lit(1024.0), unit)
    text = F.when(unit == 0, F.format_string("%.0f B", scaled)).otherwise(F.concat(F.format_string("%.1f ", scaled), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)))
    return F.when(x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf")), F.lit("0 B")).otherwise(text)


def relative(then: Column, now: Column) -> Column:
    """How long ago an instant was, in the largest whole unit; less than a minute, or to come: just now. Null: a dash."""
    ms = F.unix_millis(now) - F.unix_millis(then)
    ago = lambda size, unit: F.concat(F.floor(ms / size).cast("string"), F.lit(f"{unit} ago"))
    text = F.when(ms < 60_000, "just now").when(ms < 3_600_000, ago(60_000, "m")).when(ms < 86_400_000, ago(3_600_000, "h")).otherwise(ago(86_400_000, "d"))
    return F.when(then.isNull() | now.isNull(), F.lit(DASH)).otherwise(text)


def first_words(text: Column, words: int) -> Column:
    """A text of at most so many words; the rest is cut off, with an ellipsis."""
    parts = F.split(strip(text), f"{SPACE}+")
    return F.when(F.size(parts) <= words, text).otherwise(F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("…")))


def minutes(x: Column) -> Column:
    """mm:ss of seconds; negative and missing ones are 00:00."""
    s = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(x)))
    return F.concat(F.format_string("%02d", F.floor(s / 60)), F.lit(":"), F.format_string("%02d", s - F.floor(s / 60) * 60))
