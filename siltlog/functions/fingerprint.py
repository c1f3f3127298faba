"""Pattern fingerprints: variable parts masked, then hashed."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from siltlog.functions.text import SPACE, trimmed

# Masks in the order they apply. Word edges are spelled out
# because Java's \b is not ASCII-only; the look-ahead skips other text quickly.
LONG_NUMBER = (r"(?=\d{3})(?<!\w)\d{3,}+(?!\w)", "N")
NUMBERED_WORDS = ("slot", "child", "state")
PATH = (r"/[A-Za-z0-9_/.\-]+", "PATH")


def mask(message: Column) -> Column:
    """Long numbers, then numbered words, then paths.

    A plain substring test spares most lines the later regexes.
    """
    text = F.regexp_replace(message, *LONG_NUMBER)
    has_word = reduce(or_, [text.contains(word) for word in NUMBERED_WORDS])
    numbered = rf"({'|'.join(NUMBERED_WORDS)}){SPACE}+\d+"
    text = F.when(has_word, F.regexp_replace(text, numbered, "$1 N")).otherwise(text)
    text = F.when(text.contains("/"), F.regexp_replace(text, *PATH)).otherwise(text)
    return trimmed(text)


def fingerprint(level: Column, message: Column) -> Column:
    """First 12 hex digits of SHA-256 over ``level:masked message``."""
    return F.substring(F.sha2(F.concat(level, F.lit(":"), mask(message)), 256), 1, 12)
