"""Secrets in texts, by fixed patterns and by character Markov models.

Two first-order models, one of random strings and one of ordinary identifiers,
are counted from labelled samples. A long token whose log-likelihood ratio
between the two is high enough is a secret, whatever it looks like. Everything is
column expressions; the model is a constant array of 67 * 67 weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from siltlog.llm.rows import pack, unpack

KINDS = ("assign", "access", "hex", "markov")

# The patterns of the base search. Runs of a class are written with
# their least length where that finds the same matches.
_ANY_CASE = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = _ANY_CASE + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_CLASSES = len(ALPHABET) + 1  # the last is any other character
PAIRS = _CLASSES**2
_OTHER = "."
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{5,}"
THRESHOLD = 10.0
_BLOCK = 128
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(steps: Column) -> Column:
    """Running sums of an int array, block by block so that it stays near linear."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))
    )
    empty = F.array().cast("array<int>")
    sums = F.transform(
        blocks,
        lambda block: F.aggregate(
            block, empty, lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x))
        ),
    )
    with_base = F.aggregate(
        sums,
        F.struct(F.lit(0).alias("base"), empty.alias("out"), F.array().cast("array<array<int>>").alias("blocks")),
        lambda s, block: F.struct(
            (s["base"] + F.element_at(block, -1)).alias("base"),
            s["out"].alias("out"),
            F.concat(s["blocks"], F.array(F.transform(block, lambda x: x + s["base"]))).alias("blocks"),
        ),
    )
    return F.when(F.size(steps) > 0, F.flatten(with_base["blocks"])).otherwise(empty)


def located(df: DataFrame, text: str, pattern: str, kind: int, name: str, keep=None) -> DataFrame:
    """Add ``name``: the spans of all leftmost matches that pass ``keep(match)``.

    The pieces between matches give the positions; texts without a match cost
    one search.
    """
    hit = F.col(text).rlike(pattern)
    empty = F.array().cast(_SPAN)
    steps = df.withColumn("_found", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).withColumn(
        "_steps",
        F.when(
            F.col("_found").isNotNull(),
            F.zip_with(
                F.slice(F.split(text, pattern, -1), F.lit(1), F.size("_found")),
                "_found",
                lambda gap, match: F.length(gap) + F.length(match),
            ),
        ),
    )
    ended = steps.withColumn("_ends", F.when(F.col("_found").isNotNull(), _running(F.col("_steps"))))
    spans = F.zip_with(
        "_ends",
        "_found",
        lambda end, match: F.struct(
            (end - F.length(match)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), match.alias("match")
        ),
    )
    kept = spans if keep is None else F.filter(spans, lambda s: keep(s["match"]))
    bare = kept if name == "_tokens" else F.transform(kept, lambda s: s.dropFields("match"))
    return ended.withColumn(name, F.when(F.col("_found").isNotNull(), bare) if name == "_tokens" else F.coalesce(bare, empty)).drop(
        "_found", "_steps", "_ends"
    )


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_assign``, ``_access`` and ``_hex``: spans of the fixed patterns."""
    enough = lambda match: F.length(F.regexp_extract(match, ASSIGN, 1)) >= LEAST_VALUE
    df = located(df, text, ASSIGN, 0, "_assign", enough)
    df = located(df, text, ACCESS, 1, "_access")
    return located(df, text, HEX, 2, "_hex")


def labelled_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """``sample, random``: the values that the fixed patterns find and the other
    identifiers, of all texts and at full length, each once a label."""
    values = []
    for pattern, group in ((ASSIGN, 1), (ACCESS, 0), (HEX, 0)):
        found = F.when(F.col(text).rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
        values.append(docs.select(F.explode(F.array_distinct(found)).alias("sample")).where(F.length("sample") >= 20))
    random = values[0].unionByName(values[1]).unionByName(values[2])
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)))).alias("sample"))
    ordinary = words.where(~F.col("sample").rlike(f"^({ACCESS}|{HEX})"))
    return random.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False))).distinct()


def train(samples: DataFrame) -> list[float]:
    """Weights ``[previous * 67 + next]`` of the log-likelihood ratio, from labelled
    strings ``sample, random``.

    Pairs of characters are counted by grouped aggregation, all other characters as
    one; the driver sees at most 67 * 67 counts of each label. Half a count is added
    to each pair. Without samples of either label the models are the same and every
    weight is zero.
    """
    # Split once: substring would look for its place from the start of the string every time.
    chars = samples.where(F.length("sample") >= 2).select(
        "random", F.split(F.regexp_replace("sample", "[^A-Za-z0-9+/_-]", _OTHER), "").alias("chars")
    )
    pairs = F.zip_with(
        F.slice("chars", F.lit(1), F.size("chars") - 1),
        F.slice("chars", F.lit(2), F.size("chars") - 1),
        lambda a, b: F.concat(a, b),
    )
    counts = chars.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    place = {c: k for k, c in enumerate(ALPHABET)}
    seen = {label: [[0.5] * _CLASSES for _ in range(_CLASSES)] for label in (True, False)}
    labels = set()
    for random, pair, n in counts:
        seen[random][place.get(pair[0], _CLASSES - 1)][place.get(pair[1], _CLASSES - 1)] += n
        labels.add(random)
    if len(labels) < 2:
        return [0.0] * PAIRS
    weights = []
    for a in range(_CLASSES):
        yes, no = seen[True][a], seen[False][a]
        weights += [math.log(yes[b] / sum(yes)) - math.log(no[b] / sum(no)) for b in range(_CLASSES)]
    return weights


def log_ratio(token: Column, weights: list[float]) -> Column:
    """How much likelier ``token`` is a random string than an identifier, in nats."""
    table = F.lit(weights)
    # instr is 0 for other characters; they share the last class.
    classes = F.transform(
        F.split(token, ""), lambda c: F.pmod(F.instr(F.lit(ALPHABET), c) - 1, F.lit(_CLASSES)).cast("int")
    )
    both = F.zip_with(
        F.slice(classes, F.lit(1), F.size(classes) - 1),
        F.slice(classes, F.lit(2), F.size(classes) - 1),
        lambda a, b: F.element_at(table, a * _CLASSES + b + 1),
    )
    return F.aggregate(both, F.lit(0.0), lambda s, w: s + w)


def _listed(spans: str) -> Column:
    names = F.lit(list(KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find_secrets(docs: DataFrame, weights: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``n_assign, n_access, n_hex, n_markov long``, ``base string`` (spans of
    the fixed patterns) and ``spans string`` (all), each ``kind:start:end`` by
    start, in code points.

    A token of 20 characters or more is added when its log-likelihood ratio
    reaches ``threshold`` and it lies outside all base spans. Null and empty
    texts have none. Input columns of these names come back as ``input_<name>``.
    """
    df = pack(docs, _text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = base_spans(df, "_text").withColumn("_base", F.concat("_assign", "_access", "_hex"))
    df = located(df, "_text", TOKEN, 3, "_tokens", lambda match: log_ratio(match, weights) >= threshold)
    free = F.filter(
        "_tokens", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"]))
    )
    df = df.withColumn("_markov", F.coalesce(F.transform(free, lambda s: s.dropFields("match")), F.array().cast(_SPAN)))
    df = df.withColumn("_all", F.concat("_base", "_markov"))
    counts = {f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS}
    added = counts | {"base": _listed("_base"), "spans": _listed("_all")}
    return unpack(df.select("row", *[c.alias(n) for n, c in added.items()]), list(added))
