"""Personal data, also where it is disguised.

Plain identifiers are found in the text as it stands. Two transducers then
rewrite the text: one turns lookalike letters into the ASCII letter they imitate,
one for one; the other turns spelled digits and spelled or bracketed at-signs and
dots, in four languages, into the signs they stand for, keeping for every piece
where it came from.
Identifiers found in the rewritten text are mapped back, so all spans are
positions in the source.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siltlog.llm.words import bounded_batches

KINDS = ("email", "ip", "card", "phone")

# The identifiers a plain search finds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits, as the run's start would have matched.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i",
    "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ⅼ": "l", "ո": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u",
    "․": ".", "。": ".", "．": ".", "·": ".", "﹒": ".", "＠": "@", "﹫": "@", "＋": "+", "﹢": "+",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "－": "-", "﹣": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
# Digits, signs and ends of domains as words, in English, German, French and Spanish.
_DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4",
    "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4",
    "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4",
    "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT_WORDS = "at|ät|klammeraffe|arobase|arroba"
_DOT_WORDS = "dot|punkt|point|punto"
_PLUS_WORDS = "plus|más"
_ENDS = frozenset(
    "com org net edu gov mil int info biz name pro io ai co app dev me tv xyz online site tech museum "
    "uk de fr es eu us ca au nz ch nl se dk fi pl pt cz hu ro gr ie br mx ar cl pe jp cn kr ru ua tr za".split()
)
# First characters of runs of ten digits in other scripts and styles.
_DIGIT_RUNS = (0x0660, 0x06F0, 0x0966, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)

_FOLD = {ord(k): v for k, v in _LOOKALIKES.items()}
_FOLD |= {first + d: chr(48 + d) for first in _DIGIT_RUNS for d in range(10)}
_FOLD |= {0xFF21 + k: chr(65 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}

_WORDS = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPELLED_RUN = re.compile(
    rf"(?<![^\W_])(?:{_WORDS}|[0-9]+)(?:[ \t.,-]{{1,3}}(?:{_WORDS}|[0-9]+))+(?![^\W_])", re.IGNORECASE
)
_SPELLED = re.compile(rf"(?<![^\W\d_])({_WORDS})(?![^\W\d_])", re.IGNORECASE)
_PLUS = re.compile(rf"(?<![^\W\d_])(?:{_PLUS_WORDS})(?=[ \t]{{0,2}}(?:[0-9]|{_WORDS}))[ \t]{{0,2}}", re.IGNORECASE)


def _in_brackets(sign: str) -> str:
    return "(?:" + "|".join(rf"\{a}[ \t]?(?:{sign})[ \t]?\{b}" for a, b in ("()", "[]", "{}", "<>")) + ")"


_BRACKETED_AT = re.compile(rf"[ \t]{{0,2}}{_in_brackets(f'{_AT_WORDS}|@')}[ \t]{{0,2}}", re.IGNORECASE)
_BRACKETED_DOT = re.compile(rf"[ \t]{{0,2}}{_in_brackets(rf'{_DOT_WORDS}|\.')}[ \t]{{0,2}}", re.IGNORECASE)
# A whole address with signs as words, in brackets or as they are. Bare words count
# nowhere else, and a bare dot only on the way to a known end.
_BARE_AT = rf"[ \t]{{1,2}}(?:{_AT_WORDS})[ \t]{{1,2}}"
_BARE_DOT = rf"[ \t]{{1,2}}(?:{_DOT_WORDS})[ \t]{{1,2}}"
_DOT = rf"(?:\.|{_BRACKETED_DOT.pattern}|{_BARE_DOT})"
_PART, _LABEL = r"[A-Za-z0-9_%+-]{1,64}", r"[A-Za-z0-9-]{1,63}"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_%+.-])(?P<local>{_PART}(?:{_DOT}{_PART}){{0,8}})"
    rf"(?P<at>@|{_BRACKETED_AT.pattern}|{_BARE_AT})(?P<domain>{_LABEL}(?:{_DOT}{_LABEL}){{1,8}})(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
_ONE_DOT, _ONE_BARE_DOT, _ONE_BARE_AT = (re.compile(p, re.IGNORECASE) for p in (_DOT, _BARE_DOT, _BARE_AT))

# What a text must hold for either search to find anything: a sign, a digit, a
# character that may be folded, or a spelled disguise. Folded characters are not listed
# one by one, which would make the class many times dearer than the search itself.
_FIRST_FOLDED = min(c for c in _FOLD if c > 0xFF)
_BELOW = "".join(f"\\x{{{c:X}}}" for c in sorted(_FOLD) if c <= 0xFF)
TRIGGER = (
    f"[@0-9{_BELOW}\\x{{{_FIRST_FOLDED:X}}}-\\x{{10FFFF}}]"
    rf"|(?iu:[(\[{{<][ \t]?(?:{_AT_WORDS})[ \t]?[)\]}}>])"
    rf"|(?iu:[ \t](?:{_AT_WORDS})[ \t]{{1,2}}[A-Za-z0-9.-]{{1,64}}[ \t]{{0,2}}(?:(?:{_DOT_WORDS})[ \t]|[(\[{{<]))"
    rf"|(?iu:[ \t.,-](?:{_WORDS})[ \t.,-]{{1,3}}(?:{_WORDS})[ \t.,-]{{1,3}}(?:{_WORDS}))"
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its at-sign: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            yield m.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in a text as it stands."""
    return {kind: list(find(text)) for kind, find in _FINDERS.items()}


class Rewritten:
    """A text with some pieces replaced, and the way back to the source."""

    def __init__(self, source: str, changes: list[tuple[int, int, str]]):
        self.starts, self.origin, parts = [], [], []
        at = length = 0
        for start, end, new in [*changes, (len(source), len(source), "")]:
            for piece, low, high, copied in ((source[at:start], at, start, True), (new, start, end, False)):
                if piece:
                    self.starts.append(length)
                    self.origin.append((low, high, copied))
                    parts.append(piece)
                    length += len(piece)
            at = end
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the rewritten text."""
        first = bisect.bisect_right(self.starts, start) - 1
        last = bisect.bisect_right(self.starts, end - 1) - 1
        low, _, same = self.origin[first]
        low = low + start - self.starts[first] if same else low
        begin, high, same = self.origin[last]
        return low, begin + end - self.starts[last] if same else high


def _worded(text: str, address: re.Match) -> list[tuple[int, int, str]]:
    """The replacements for bare words of one address; none if it lacks a known end or a disguise."""
    dots = [m.span() for m in _ONE_DOT.finditer(text, *address.span("domain"))]
    ends = [start for start, _ in dots[1:]] + [address.end("domain")]
    known = [k for k, (d, end) in enumerate(zip(dots, ends)) if text[d[1] : end].lower() in _ENDS]
    if not known:
        return []
    dots = dots[: known[-1] + 1]
    while dots and text[slice(*dots[-1])] == ".":
        dots.pop()  # a plain dot needs no help, and none behind it was bare
    bare_at = _ONE_BARE_AT.fullmatch(address["at"]) is not None
    if bare_at and not dots:
        return []
    local = [m.span() for m in _ONE_DOT.finditer(text, *address.span("local"))]
    bare = [span for span in local + dots if _ONE_BARE_DOT.fullmatch(text[slice(*span)])]
    return [(*span, ".") for span in bare] + ([(*address.span("at"), "@")] if bare_at else [])


def _changes(text: str) -> list[tuple[int, int, str]]:
    """The replacements for a folded text, in order and without overlap."""
    found: list[tuple[int, int, str]] = []
    for m in _BRACKETED_AT.finditer(text):
        found.append((*m.span(), "@"))
    for m in _BRACKETED_DOT.finditer(text):
        found.append((*m.span(), "."))
    for m in _ADDRESS.finditer(text):
        found += _worded(text, m)
    for m in _PLUS.finditer(text):
        found.append((*m.span(), "+"))
    for run in _SPELLED_RUN.finditer(text):
        before = None
        for m in _SPELLED.finditer(text, *run.span()):
            # Spaces and commas between two spelled digits go with the second.
            gap = text[before:m.start()] if before is not None else None
            start = before if gap is not None and not gap.strip(" \t,") else m.start()
            found.append((start, m.end(), _DIGIT_WORDS[m[1].lower()]))
            before = m.end()
    out: list[tuple[int, int, str]] = []
    for change in sorted(found):
        if not out or change[0] >= out[-1][1]:
            out.append(change)
    return out


def hidden_spans(text: str, plain: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the rewritten text shows, as source positions.

    A span inside a plain one of its kind is left out.
    """
    folded = text if text.isascii() else text.translate(_FOLD)
    changes = _changes(folded)
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if folded is text and not changes:
        return out
    rewritten = Rewritten(folded, changes)
    for kind, find in _FINDERS.items():
        own = plain[kind]
        starts = [s for s, _ in own]
        for low, high in find(rewritten.text):
            low, high = rewritten.back(low, high)
            k = bisect.bisect_right(starts, low) - 1
            if k < 0 or own[k][1] < high:
                out[kind].append((low, high))
    return out


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    rows = sorted((low, KINDS.index(kind), high) for kind, own in spans.items() for low, high in own)
    return ",".join(f"{KINDS[k]}:{low}:{high}" for low, k, high in rows)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_hidden long"


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        if text is None:
            rows.append((0, 0, 0, 0, "", "", 0))
            continue
        plain = plain_spans(text)
        hidden = hidden_spans(text, plain)
        both = {kind: plain[kind] + hidden[kind] for kind in KINDS}
        rows.append((*(len(plain[k]) for k in KINDS), _joined(plain), _joined(both), sum(map(len, hidden.values()))))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_hidden"])


def scanned(text: Column) -> Column:
    """Struct of counts and spans for one text column.

    Only texts that hold a sign, a digit or a disguise travel to Python.
    """
    return F.pandas_udf(_scan, FOUND)(F.when(text.rlike(TRIGGER), text))


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: counts of the plain spans of each kind, ``base`` (the plain
    spans) and ``spans`` (all), each ``kind:start:end`` in code points, by start.

    Null and empty texts have none. An input column named ``pii`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn("pii", scanned(F.col(text)))
