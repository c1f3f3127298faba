"""Text contexts built from aggregated rows.

Every builder returns one row per batch of patterns with a ``context`` text.
A batch is at most 1000 patterns, so its text is put together in one group;
:func:`context_lines` gives the same report as numbered rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltlog.functions.times import hour_label, iso_text
from siltlog.operators.chains import chain_rows
from siltlog.operators.context import context_groups, narrative, pattern_context
from siltlog.operators.order import dense_index
from siltlog.operators.patterns import group_in_order
from siltlog.operators.sampling import (
    cap_by_count,
    cap_by_tier,
    first_ids_text,
    sample_small_groups,
    supplementary,
    systematic_sample,
)
from siltlog.operators.select import by_time_range
from siltlog.operators.signals import pattern_signals
from siltlog.schema import NAMED_LEVELS, ROOT_CAUSE_PATTERN_CAP, ROOT_CAUSE_SAMPLE
from siltlog.session import materialize
from siltlog.sources.store import LogStore

# The section titles below are fixed values.
SIGNALS_PER_BATCH = 1000
CONTEXT_COLUMNS = ("pos", "id", "ts", "level", "message", "fingerprint")


@dataclass(frozen=True)
class DatasetFacts:
    """Header values of a report; one small row of the store."""

    total_logs: int
    unique_patterns: int
    range_start: str | None
    range_end: str | None
    levels_json: str

    @classmethod
    def of(cls, store: LogStore) -> DatasetFacts:
        """Levels are whatever a line names, so only those of ``NAMED_LEVELS`` are listed;
        the others are counted together."""
        levels = store.logs.groupBy("level").agg(
            F.count("*").alias("n"),
            F.min("pos").alias("first_pos"),
            F.min("ts").alias("lo"),
            F.max("ts").alias("hi"),
        )
        shown = F.when(F.col("level").isin(*NAMED_LEVELS), F.col("level"))
        rows = levels.groupBy(shown.alias("name")).agg(
            F.count("*").alias("kinds"),
            F.sum("n").alias("n"),
            F.min("first_pos").alias("first_pos"),
            iso_text(F.min("lo")).alias("lo"),
            iso_text(F.max("hi")).alias("hi"),
        )
        rows = sorted(rows.collect(), key=lambda r: r["first_pos"])
        text = json.dumps({r["name"]: r["n"] for r in rows if r["name"]}, separators=(",", ":"))
        for r in rows:
            if not r["name"]:
                text += f" (other levels: {r['kinds']} kinds, {r['n']} rows)"
        return cls(
            sum(r["n"] for r in rows),
            store.patterns.count(),
            min((r["lo"] for r in rows if r["lo"]), default=None),
            max((r["hi"] for r in rows if r["hi"]), default=None),
            text,
        )

    def span(self, missing: str) -> str:
        return f"{self.range_start or missing} to {self.range_end or missing}"


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _stacked(order: str, line: str, separator: str = "\n") -> Column:
    """Aggregate: lines of a bounded group joined in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, line)))
    return F.array_join(F.transform(listed, lambda x: x[line]), separator)


def _time_or(ts: Column | str, missing: str) -> Column:
    return F.coalesce(iso_text(F.col(ts) if isinstance(ts, str) else ts), F.lit(missing))


def _tag(level: Column | str = "level") -> Column:
    return _text("[", F.upper(level), "]")


def context_lines(contexts: DataFrame) -> DataFrame:
    """A report as rows: ``batch_id``, ``line_no``, ``line``."""
    return contexts.select("batch_id", F.posexplode(F.split("context", "\n")).alias("line_no", "line"))


def context_reduction(store: LogStore, contexts: DataFrame) -> DataFrame:
    """Share of the raw text a report leaves out."""
    raw = store.logs.agg(F.sum(F.octet_length("raw"))).scalar()
    return contexts.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0)).alias("context_bytes")).select(
        "context_bytes",
        raw.alias("raw_bytes"),
        (1 - F.col("context_bytes") / raw).alias("reduction"),
    )


def classification_contexts(batches: DataFrame, facts: DatasetFacts) -> DataFrame:
    """Patterns of each batch with counts and times. ``batches`` is from ``in_batches``."""
    entry = _lines(
        _text("[ID: ", F.col("id"), "]"),
        _text("  Level: ", F.col("level")),
        _text("  Message: ", F.col("message")),
        _text("  Occurrences: ", F.col("occurrence_count").cast("string")),
        _text("  First seen: ", _time_or("first_seen", "N/A")),
        _text("  Last seen: ", _time_or("last_seen", "N/A")),
        _text("  Raw: ", F.col("raw")),
        "",
    )
    return (
        batches.select("batch_id", "batch_ord", entry.alias("entry"))
        .groupBy("batch_id")
        .agg(_stacked("batch_ord", "entry").alias("entries"), F.count("*").alias("n"))
        .select(
            "batch_id",
            _lines(
                "=== LOG DATASET SUMMARY ===",
                f"Total logs in dataset: {facts.total_logs}",
                _text("Unique patterns to classify: ", F.col("n").cast("string")),
                f"Time range: {facts.span('N/A')}",
                f"Level distribution: {facts.levels_json}",
                "",
                "=== DEDUPLICATED LOG PATTERNS ===",
                F.col("entries"),
            ).alias("context"),
        )
    )


def patterns_by_hour(patterns: DataFrame) -> DataFrame:
    """Patterns and logs per hour label of their first row, first-seen order kept."""
    return group_in_order(
        patterns, hour_label(F.col("ts")), F.sum("occurrence_count").alias("logs")
    )


def _hour_sections(batches: DataFrame) -> DataFrame:
    entry = _text(
        _tag(),
        " ",
        F.col("message"),
        " | x",
        F.col("occurrence_count").cast("string"),
        " | First: ",
        _time_or("first_seen", "N/A"),
        " | Last: ",
        _time_or("last_seen", "N/A"),
    )
    hours = (
        batches.select("batch_id", "batch_ord", hour_label(F.col("ts")).alias("hour"), entry.alias("entry"))
        .groupBy("batch_id", "hour")
        .agg(
            F.min("batch_ord").alias("hour_ord"),
            F.count("*").alias("n"),
            _stacked("batch_ord", "entry").alias("entries"),
        )
        .withColumn("section", _lines(_text("\n--- ", F.col("hour"), " ---"), F.col("entries")))
    )
    return hours.groupBy("batch_id").agg(
        F.sum("n").alias("n"), _stacked("hour_ord", "section").alias("sections")
    )


def _signal_sections(store: LogStore, per_batch: int) -> DataFrame:
    """``batch_id, signals``: the lines of all signals in order, ``per_batch`` to a batch.

    Each signal is reported once, whatever their number.
    """
    title = "\n=== SECURITY SIGNALS (Critical Context) ==="
    line = _text(
        "[", F.col("type"), "] ", _tag(), " ", F.col("message"), " | x", F.col("occurrence_count").cast("string")
    )
    # Patterns carry at most seven signals each, so pos * 8 + type is unique.
    signals = pattern_signals(store.patterns).select(
        (F.col("pos") * 8 + F.col("type_ord")).alias("pos"), line.alias("line")
    )
    numbered = dense_index(materialize(signals, "signals"), "signal_no")
    dealt = numbered.withColumn("batch_id", F.expr(f"signal_no div {int(per_batch)}"))
    return dealt.groupBy("batch_id").agg(_lines(title, _stacked("signal_no", "line")).alias("signals"))


def _chain_section(logs: DataFrame) -> str | None:
    """At most ten chains of six rows."""
    rows = (
        chain_rows(logs)
        .select("chain_no", "step", "chain_count", "is_error", _text(_tag(), " ", F.col("message")).alias("line"))
        .orderBy("chain_no", "step")
        .collect()
    )
    if not rows:
        return None
    lines = ["\n=== INCIDENT ESCALATION CHAINS ==="]
    seen = None
    for row in rows:
        if row["chain_no"] != seen:
            seen = row["chain_no"]
            lines.append(f"--- Chain {seen + 1} (x{row['chain_count']}) ---")
        lines.append(("  → " if row["is_error"] else "  ") + row["line"])
    return "\n".join(lines)


def _narrative_section(logs: DataFrame) -> str | None:
    """At most six windows of six rows."""
    rows = (
        narrative(logs)
        .select("window_id", "offset", _time_or("ts", "null").alias("at"), "is_error", _text(_tag(), " ", F.col("message")).alias("line"))
        .orderBy("window_id", "offset")
        .collect()
    )
    if not rows:
        return None
    centre_time = {r["window_id"]: r["at"] for r in rows if r["is_error"]}
    lines = ["\n=== CHRONOLOGICAL INCIDENT NARRATIVE ==="]
    seen = None
    for row in rows:
        if row["window_id"] != seen:
            seen = row["window_id"]
            lines.append(f"--- Incident at {centre_time[seen]} ---")
        lines.append((">>> " if row["is_error"] else "    ") + row["line"])
    return "\n".join(lines)


def _supplement_section(patterns: DataFrame) -> str:
    """The ten most frequent patterns outside the problem levels."""
    top = supplementary(patterns).select(
        _text(_tag(), " ", F.col("message"), " | x", F.col("occurrence_count").cast("string")).alias("line")
    )
    return "\n".join(["\n=== SUPPLEMENTARY: TOP NON-ERROR PATTERNS ===", *[r["line"] for r in top.collect()]])


def timeline_contexts(
    store: LogStore,
    batches: DataFrame,
    facts: DatasetFacts,
    start: str | None = None,
    end: str | None = None,
    with_supplement: bool = False,
    signals_per_batch: int = SIGNALS_PER_BATCH,
) -> DataFrame:
    """Hour sections of each batch with its share of the signals, and chains and narrative of
    the whole set.

    Signals are dealt to the batches in order; when there are more than the
    batches take, batches without patterns follow. A time range limits chains
    and narrative only; the patterns are as given. Rows are sorted by time, so a
    range is one run of positions and neighbours are rows of the range.
    """
    logs = by_time_range(store.logs, start, end) if start and end else store.logs
    sections = _hour_sections(batches)
    if batches.isEmpty():
        sections = store.spark.createDataFrame([(0, 0, "")], "batch_id long, n long, sections string")
    signals = _signal_sections(store, signals_per_batch)
    shared = [_chain_section(logs), _narrative_section(logs)]
    if with_supplement:
        shared.append(_supplement_section(store.patterns))
    header = [
        "=== LOG DATASET SUMMARY ===",
        f"Total logs in file: {facts.total_logs}",
        f"Unique log patterns: {facts.unique_patterns}",
        _text("Error/Warning patterns: ", F.col("n").cast("string")),
        f"Time range: {facts.span('null')}",
        f"Levels breakdown: {facts.levels_json}",
        "",
        "=== ERROR/WARNING PATTERNS BY TIME WINDOW ===",
    ]
    body = F.when(F.col("n") > 0, F.col("sections"))
    both = sections.join(signals, "batch_id", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select(
        "batch_id",
        _lines(*header, body, F.col("signals"), *[s for s in shared if s]).alias("context"),
    )


def capped_timeline_context(
    store: LogStore, patterns: DataFrame, facts: DatasetFacts, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One context over the tier-capped patterns, with the supplement section."""
    capped = cap_by_tier(patterns).withColumn("batch_id", F.lit(0).cast("long"))
    batch = capped.withColumnRenamed("cap_ord", "batch_ord")
    return timeline_contexts(store, batch, facts, start, end, with_supplement=True)


def _group_line() -> Column:
    return _text(
        _tag(),
        " ",
        F.col("message"),
        " | Occurrences: ",
        F.col("n").cast("string"),
        " | First: ",
        _time_or("first_ts", "N/A"),
        " | Last: ",
        _time_or("last_ts", "N/A"),
        " | IDs: ",
        first_ids_text(F.col("ids"), F.col("n")),
    )


def _event_line() -> Column:
    return _text("[", _time_or("ts", "null"), "] ", _tag(), " ", F.col("message"))


def root_cause_contexts(
    context: DataFrame, facts: DatasetFacts, cap: int | None = ROOT_CAUSE_PATTERN_CAP
) -> DataFrame:
    """Pattern groups and an event sequence per batch.

    ``context`` holds the rows around each batch's patterns, with ``batch_id``.
    ``cap`` limits the listed groups to the most frequent; None lists all.
    """
    by = ["batch_id"]
    context = materialize(context.select(*by, *CONTEXT_COLUMNS), "context-rows")
    groups = materialize(context_groups(context, by), "context-groups")
    unique = groups.groupBy(*by).agg(F.count("*").alias("unique_patterns"))
    listed = groups.withColumn("list_ord", F.col("pos"))
    if cap is not None:
        most = Window.partitionBy(*by).orderBy(F.col("n").desc(), "pos")
        ranked = groups.withColumn("_rank", F.row_number().over(most))
        capped = F.col("unique_patterns") > cap
        listed = (
            ranked.join(unique, by)
            .where(~capped | (F.col("_rank") <= cap))
            .withColumn("list_ord", F.when(capped, F.col("_rank").cast("long")).otherwise(F.col("pos")))
        )
    group_text = (
        listed.select(*by, "list_ord", _group_line().alias("line"))
        .groupBy(*by)
        .agg(_stacked("list_ord", "line").alias("groups_text"))
    )
    events = (
        sample_small_groups(context, by, ROOT_CAUSE_SAMPLE)
        .select(*by, "sample_rank", _event_line().alias("line"))
        .groupBy(*by)
        .agg(_stacked("sample_rank", "line").alias("events_text"))
    )
    sizes = context.groupBy(*by).agg(F.count("*").alias("rows_analyzed"))
    joined = sizes.join(unique, by).join(group_text, by).join(events, by)
    return joined.select(*by, _root_cause_text(facts))


def _root_cause_text(facts: DatasetFacts) -> Column:
    return _lines(
        "=== ROOT CAUSE ANALYSIS CONTEXT ===",
        f"Total logs in dataset: {facts.total_logs}",
        _text("Error/Warning logs analyzed: ", F.col("rows_analyzed").cast("string")),
        _text("Unique error patterns: ", F.col("unique_patterns").cast("string")),
        f"Time range: {facts.span('null')}",
        "",
        "=== ERROR PATTERNS ===",
        F.col("groups_text"),
        "",
        "=== CHRONOLOGICAL EVENT SEQUENCE ===",
        F.col("events_text"),
    ).alias("context")


def empty_root_cause_context(store: LogStore, facts: DatasetFacts) -> DataFrame:
    """The context of a batch with nothing in it."""
    row = store.spark.createDataFrame(
        [(0, 0, 0, None, None)],
        "batch_id long, rows_analyzed long, unique_patterns long, groups_text string, events_text string",
    )
    return row.select("batch_id", _root_cause_text(facts))


def whole_root_cause_context(
    context: DataFrame, facts: DatasetFacts, cap: int = ROOT_CAUSE_PATTERN_CAP
) -> DataFrame:
    """One context over any set of rows with ``pos``, however large.

    The listed groups are a top-k and the events a 60-row sample, both taken
    without gathering the rows. Rows and groups are written once because several
    steps read them.
    """
    context = materialize(context.select(*CONTEXT_COLUMNS), "context-rows")
    groups = materialize(context_groups(context), "context-groups")
    unique = groups.count()
    capped = unique > cap
    listed = cap_by_count(groups, cap) if capped else groups
    list_ord = -F.col("n") if capped else F.lit(0)
    lines = listed.select(F.struct(list_ord.alias("a"), F.col("pos")).alias("ord"), _group_line().alias("line"))
    events = systematic_sample(context, ROOT_CAUSE_SAMPLE).select("rank", _event_line().alias("line"))
    row = context.agg(F.count("*").alias("rows_analyzed")).select(
        F.lit(0).cast("long").alias("batch_id"),
        "rows_analyzed",
        F.lit(unique).alias("unique_patterns"),
        lines.agg(_stacked("ord", "line")).scalar().alias("groups_text"),
        events.agg(_stacked("rank", "line")).scalar().alias("events_text"),
    )
    return row.select("batch_id", _root_cause_text(facts))


def pattern_batch_contexts(
    store: LogStore, batches: DataFrame, facts: DatasetFacts, cap: int | None = None
) -> DataFrame:
    """Root-cause contexts over the rows around each batch's patterns."""
    return root_cause_contexts(pattern_context(store.logs, batches), facts, cap)


def entry_blocks(entries: DataFrame, neighbours: str | None = None) -> DataFrame:
    """Entries as text blocks, one per row; ``neighbours`` names an array of surrounding lines."""
    parts: list[Column | str] = [
        _text(
            "[ID: ", F.col("id"), "] [", _time_or("ts", "N/A"), "] [", F.col("level"), "] ", F.col("message")
        )
    ]
    if neighbours:
        around = F.array_join(F.transform(neighbours, lambda n: F.concat(F.lit("    "), n)), "\n")
        parts.append(
            F.when(F.size(neighbours) > 0, _lines("  Surrounding context:", around))
        )
    return entries.select("pos", _lines(*parts, "").alias("block"))


def entry_header(entries: DataFrame, kind: str) -> DataFrame:
    """First lines of an entry list."""
    return entries.agg(
        _lines(
            f"=== LOG ENTRIES FOR {kind.upper()} ===",
            _text("Total entries: ", F.count("*").cast("string")),
            "",
        ).alias("block")
    ).select(F.lit(-1).cast("long").alias("pos"), "block")


def entry_list(entries: DataFrame, kind: str, neighbours: str | None = None) -> DataFrame:
    """Header and entry blocks; sort by ``pos`` to print."""
    return entry_header(entries, kind).unionByName(entry_blocks(entries, neighbours))
