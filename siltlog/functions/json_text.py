"""JSON out of free text, as variants, and the record shapes read from it.

Model answers arrive as plain JSON, fenced, inside prose or slightly broken.
Missing, empty, zero and false values fall back to the next name or a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltlog.functions.text import trimmed

# How JSON is looked for.
FENCED = r"```(?:json)?\s*\n?([\s\S]*?)\n?\s*```"
OUTER_OBJECT = r"(\{[\s\S]*\})"
OUTER_ARRAY = r"(\[[\s\S]*\])"
TRAILING_COMMA = r",\s*([\]}])"


def strict_json(text: Column) -> Column:
    """Variant for text that is one JSON value and nothing else, otherwise null.

    A lone parse would accept trailing text; as an item and as a member it cannot.
    """
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when(as_item.isNotNull(), F.try_variant_get(as_member, "$.x", "variant"))


def json_in_text(text: Column) -> Column:
    """First of: the whole text, a fenced block, the outer object, the outer array, a repair.

    The later candidates are only tried when the whole text is not JSON.
    """
    whole = trimmed(text)
    repaired = F.replace(F.regexp_replace(whole, TRAILING_COMMA, "$1"), F.lit("'"), F.lit('"'))
    candidates = F.array(
        trimmed(F.regexp_extract(whole, FENCED, 1)),
        F.regexp_extract(whole, OUTER_OBJECT, 1),
        F.regexp_extract(whole, OUTER_ARRAY, 1),
        repaired,
    )
    readable = F.filter(F.transform(candidates, strict_json), lambda v: v.isNotNull())
    return F.coalesce(strict_json(whole), F.get(readable, F.lit(0)))


def without_fence(text: Column) -> Column:
    """Drop a surrounding code fence, for the audit record."""
    body = trimmed(text)
    return F.when(
        body.startswith("```"), F.regexp_replace(body, r"^```(?:json)?\n?|\n?```\z", "")
    ).otherwise(text)


# What a text must start with to be false or a number that is zero.
_DOUBTFUL = ("f", "0", "-", "+", ".", " ")


def decoded(item: Column, *names: str) -> Column:
    """The members of an item as texts, all read at once: a struct of ``names``, null where absent."""
    return F.try_variant_get(item, "$", f"struct<{', '.join(f'`{n}` string' for n in names)}>")


def _usable(item: Column, text: Column, name: str) -> Column:
    """A member's ``text``; null if the member is missing, empty, zero or false.

    The type matters for the words ``0`` and ``false`` only, so it is looked up for
    texts that begin like one of them.
    """
    unset = (text == "false") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
    quoted = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING"
    doubtful = F.substring(text, 1, 1).isin(*_DOUBTFUL)
    return F.when(text.isNull() | (text == ""), None).when(doubtful & unset & ~quoted, None).otherwise(text)


def _held(item: Column, name: str) -> Column:
    """Whether a member that is no array is usable. An array always is, and is never
    written out as text to find that out: callers look for one first."""
    return _usable(item, F.try_variant_get(item, f"$.{name}", "string"), name).isNotNull()


def _array(item: Column, name: str, of: str = "variant") -> Column:
    return F.try_variant_get(item, f"$.{name}", f"array<{of}>")


def text_of(item: Column, names: tuple[str, ...], default: str | None = None, texts: Column | None = None) -> Column:
    """The first usable of some members; ``texts`` are the item's :func:`decoded` ones."""
    texts = decoded(item, *names) if texts is None else texts
    found = [_usable(item, texts[n], n) for n in names]
    return F.coalesce(*found, F.lit(default)) if default is not None else F.coalesce(*found)


def _first_array(item: Column, names: tuple[str, ...], of: str, other: Column) -> Column:
    """The first usable member if it is an array, else ``other``."""
    tries = [c for n in names for c in (_array(item, n, of), F.when(_held(item, n), other))]
    return F.coalesce(*tries, other)


def items_of(item: Column, *names: str) -> Column:
    """Array members of an item; an absent or non-array member is an empty array."""
    return _first_array(item, names, "variant", F.array().cast("array<variant>"))


def texts_of(item: Column, *names: str) -> Column:
    return _first_array(item, names, "string", F.array().cast("array<string>"))


def each(items: Column, names: tuple[str, ...], make) -> Column:
    """``make(item, texts)`` for every item, its members decoded once."""
    read = F.transform(items, lambda v: F.struct(v.alias("item"), decoded(v, *names).alias("texts")))
    return F.transform(read, lambda r: make(r["item"], r["texts"]))


def whole_number(text: Column) -> Column:
    """Leading integer of a text, as a lenient parser reads it."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def confidence_of(item: Column, texts: Column) -> Column:
    text = texts["confidence"]
    type_name = F.schema_of_variant(F.try_variant_get(item, "$.confidence", "variant"))
    is_number = type_name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.when(is_number, text.try_cast("double")).otherwise(whole_number(text).cast("double"))
    return F.coalesce(value, F.lit(0.0))


def as_items(value: Column, *wrappers: str) -> Column:
    """An array as it is, the array under one of the wrapper names, else the value alone."""
    direct = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(direct, _first_array(value, wrappers, "variant", F.array(value)))


def _readable(responses: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """Readable answers as variant ``_json``, and the columns carried along.

    The filter is on a generated column: on the parse itself it would be pushed
    below and every text parsed twice.
    """
    keep = [c for c in responses.columns if c != text]
    parsed = responses.select(*keep, json_in_text(F.col(text)).alias("_parsed"))
    usable = F.when(~F.is_variant_null("_parsed"), F.array("_parsed"))
    rows = parsed.select(*keep, F.explode_outer(usable).alias("_json"))
    return rows.where(F.col("_json").isNotNull()), keep


_CLASSIFIED = (
    "id", "logId", "category", "classification", "confidence", "severity", "explanation", "reason", "description", "insight",
)


def classification_rows(responses: DataFrame, text: str = "text") -> DataFrame:
    """One row per classified item: ``item_ord`` and the normalised fields.

    Other columns of ``responses`` are carried along; unreadable answers give no rows.
    """
    parsed, keep = _readable(responses, text)
    # An answer is at least one item, or an empty array, which the filter leaves out.
    items = parsed.select(
        *keep,
        F.posexplode_outer(as_items(F.col("_json"), "classifications", "results")).alias("item_ord", "_item"),
    ).where("item_ord IS NOT NULL")
    items = items.select(*keep, "item_ord", "_item", decoded(F.col("_item"), *_CLASSIFIED).alias("_texts"))
    item, texts = F.col("_item"), F.col("_texts")
    return items.select(
        *keep,
        "item_ord",
        text_of(item, ("id", "logId"), "unknown", texts).alias("result_id"),
        text_of(item, ("category", "classification"), "Unknown", texts).alias("category"),
        confidence_of(item, texts).alias("confidence"),
        text_of(item, ("severity",), "medium", texts).alias("severity"),
        text_of(item, ("explanation", "reason", "description"), "No explanation provided", texts).alias(
            "explanation"
        ),
        text_of(item, ("insight",), "", texts).alias("insight"),
    )


_STEP = ("level", "description", "message", "summary", "timestamp", "time")


def _step(step: Column, texts: Column) -> Column:
    return F.struct(
        text_of(step, ("level",), "info", texts).alias("level"),
        text_of(step, ("description", "message", "summary"), "", texts).alias("description"),
        text_of(step, ("timestamp", "time"), "", texts).alias("timestamp"),
    )


_EVENT = ("timestamp", "time", "eventTitle", "title", "event", "severity", "level", "summary", "description")


def timeline_rows(responses: DataFrame, text: str = "text") -> DataFrame:
    """One row per timeline event with ``item_ord``; ``overall_summary`` repeats per answer."""
    parsed, keep = _readable(responses, text)
    answer = F.col("_json")
    listed = [
        c
        for n in ("timeline", "events")
        for c in (_array(answer, n), F.when(_held(answer, n), F.array(F.try_variant_get(answer, f"$.{n}", "variant"))))
    ]
    events = F.coalesce(F.try_variant_get(answer, "$", "array<variant>"), *listed, F.array(answer))
    told = parsed.select(*keep, "_json", decoded(answer, "overallSummary", "summary").alias("_texts"))
    rows = told.select(
        *keep,
        text_of(answer, ("overallSummary", "summary"), "Timeline generated from log data", F.col("_texts")).alias(
            "overall_summary"
        ),
        F.posexplode_outer(events).alias("item_ord", "_event"),
    )
    rows = rows.select(*keep, "overall_summary", "item_ord", "_event", decoded(F.col("_event"), *_EVENT).alias("_texts"))
    event, texts = F.col("_event"), F.col("_texts")
    return rows.select(
        *keep,
        "overall_summary",
        "item_ord",
        text_of(event, ("timestamp", "time"), "Unknown", texts).alias("timestamp"),
        text_of(event, ("eventTitle", "title", "event"), "Unnamed Event", texts).alias("event_title"),
        text_of(event, ("severity", "level"), "info", texts).alias("severity"),
        text_of(event, ("summary", "description"), "No summary", texts).alias("summary"),
        each(items_of(event, "escalationPath", "escalation_path"), _STEP, _step).alias("escalation_path"),
        texts_of(event, "supportingEvidence", "evidence", "logs").alias("supporting_evidence"),
        texts_of(event, "affectedComponents", "components").alias("affected_components"),
    )


_FINDING = ("finding", "observation", "logPattern", "pattern", "log", "occurrences", "count", "significance", "importance")


def _finding(e: Column, texts: Column) -> Column:
    counted = [(_usable(e, texts[n], n).isNotNull(), F.try_variant_get(e, f"$.{n}", "long")) for n in ("occurrences", "count")]
    (first, one), (second, two) = counted
    return F.struct(
        text_of(e, ("finding", "observation"), "N/A", texts).alias("finding"),
        text_of(e, ("logPattern", "pattern", "log"), "N/A", texts).alias("log_pattern"),
        F.coalesce(F.when(first, one).when(second, two), F.lit(0)).alias("occurrences"),
        text_of(e, ("significance", "importance"), "N/A", texts).alias("significance"),
    )


_ADVICE = ("action", "recommendation", "priority", "rationale", "reason")


def _recommendation(r: Column, texts: Column) -> Column:
    return F.struct(
        text_of(r, ("action", "recommendation"), "N/A", texts).alias("action"),
        text_of(r, ("priority",), "medium", texts).alias("priority"),
        text_of(r, ("rationale", "reason"), "N/A", texts).alias("rationale"),
    )


_REPORT = ("rootCause", "root_cause", "impact", "confidence", "analysisNotes", "notes")


def root_cause_rows(responses: DataFrame, text: str = "text") -> DataFrame:
    """One normalised root-cause report per readable answer."""
    parsed, keep = _readable(responses, text)
    read = parsed.select(*keep, "_json", decoded(F.col("_json"), *_REPORT).alias("_texts"))
    report, texts = F.col("_json"), F.col("_texts")
    return read.select(
        *keep,
        text_of(report, ("rootCause", "root_cause"), "Unable to determine root cause", texts).alias("root_cause"),
        each(items_of(report, "evidence"), _FINDING, _finding).alias("evidence"),
        texts_of(report, "causalChain", "causal_chain", "chain").alias("causal_chain"),
        text_of(report, ("impact",), "Impact not assessed", texts).alias("impact"),
        each(items_of(report, "recommendations"), _ADVICE, _recommendation).alias("recommendations"),
        confidence_of(report, texts).alias("confidence"),
        text_of(report, ("analysisNotes", "notes"), texts=texts).alias("analysis_notes"),
    )
