"""Text helpers with one whitespace definition for Spark, regexes and Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters the log format treats as white space.
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as the inside of a regex character class.
SPACE_CLASS = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = f"[{SPACE_CLASS}]"
# Complements, spelled as ranges: a negated class is about ten times slower in Java.
NOT_SPACE = (
    r"[\x21-\x9F\x00-\x08\x0E-\x1F\xA1-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}"
    r"\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{FEFE}\x{FF00}-\x{10FFFF}]"
)
# Any character that does not end a line.
ANY = r"[\x0E-\x{2027}\x00-\x09\x0B\x0C\x{202A}-\x{10FFFF}]"


def trimmed(text: Column) -> Column:
    """Strip white space from both ends, tabs and non-breaking spaces included."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return trimmed(text) == ""


def or_default(value: Column, default) -> Column:
    """Replace null and empty text, as the reports do."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def keywords(query: str) -> list[str]:
    """Lower-cased search words; an empty query has none."""
    return [w for w in re.split(f"[{re.escape(SPACE_CHARS)}]+", query.lower()) if w]


def contains_all(text: Column, query: str) -> Column:
    """Every word of ``query`` occurs in ``text``, ignoring case."""
    lowered = F.lower(text)
    match = F.lit(True)
    for word in keywords(query):
        match = match & lowered.contains(word)
    return match


def contains_all_of(text: Column, query: Column) -> Column:
    """Like :func:`contains_all` with the words taken from a column."""
    words = F.filter(F.split(F.lower(query), f"{SPACE}+"), lambda w: w != "")
    return F.forall(words, lambda w: F.lower(text).contains(w))


def log_id(line_number: Column) -> Column:
    """``log_00001``; longer numbers are kept whole."""
    digits = line_number.cast("string")
    padded = F.when(line_number < 100000, F.lpad(digits, 5, "0")).otherwise(digits)
    return F.concat(F.lit("log_"), padded)


def _one_decimal(millis: Column, unit: int) -> Column:
    """``millis / unit`` to one decimal, ties decided by the double's exact value."""
    tenth = unit // 10
    rest = millis % tenth
    value = millis / F.lit(float(unit))
    above = (value - F.floor(value)) >= (millis % unit) / F.lit(float(unit))
    up = (rest * 2 > tenth) | ((rest * 2 == tenth) & above)
    tenths = F.floor(millis / tenth) + up.cast("long")
    return F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string"))


def duration_text(millis: Column) -> Column:
    """``950ms``, ``1.5s``, ``2.0m``."""
    return (
        F.when(millis < 1000, F.concat(millis.cast("string"), F.lit("ms")))
        .when(millis < 60000, F.concat(_one_decimal(millis, 1000), F.lit("s")))
        .otherwise(F.concat(_one_decimal(millis, 60000), F.lit("m")))
    )
