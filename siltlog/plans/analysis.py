"""Classification, timeline and root-cause analyses as map-reduce over pattern batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from siltlog.functions.json_text import classification_rows, root_cause_rows, timeline_rows
from siltlog.functions.times import report_time
from siltlog.operators import classify as C
from siltlog.operators.order import global_index
from siltlog.operators.patterns import batch_count, in_batches, most_frequent
from siltlog.operators.select import by_symptom, focus, patterns_by_ids, problems
from siltlog.operators.stats import analysis_metadata
from siltlog.plans import prompts
from siltlog.plans.model import ModelFunction, ask, failed_batches, usage_of
from siltlog.plans.reports import (
    DatasetFacts,
    classification_contexts,
    empty_root_cause_context,
    pattern_batch_contexts,
    timeline_contexts,
)
from siltlog.schema import CLASSIFICATION_BATCH, ROOT_CAUSE_BATCH, TIMELINE_BATCH
from siltlog.session import materialize
from siltlog.sources.store import LogStore

Models = ModelFunction | Sequence[ModelFunction]
FAN_IN = 50


def _requests(contexts: DataFrame, stage: str, system: str, prompt) -> DataFrame:
    return contexts.select(
        F.lit(stage).alias("stage"),
        "batch_id",
        F.lit(system).alias("system_prompt"),
        prompt.alias("user_prompt"),
    )


@dataclass(frozen=True)
class Classification:
    """``failed`` lists the batches whose patterns have default rows for want of an answer."""

    classified: DataFrame
    responses: DataFrame
    failed: DataFrame
    batch_size: int = CLASSIFICATION_BATCH

    def summary(self) -> DataFrame:
        return C.summary(self.classified)

    def distribution(self) -> DataFrame:
        return C.distribution(self.classified)

    def totals(self) -> DataFrame:
        return C.totals(self.classified, self.batch_size)

    def usage(self) -> DataFrame:
        return C.usage_by_stage(usage_of(self.responses))


def classify_patterns(
    patterns: DataFrame,
    facts: DatasetFacts,
    models: Models,
    batch_size: int = CLASSIFICATION_BATCH,
    on_failed: str = "raise",
    ledger: str | None = None,
) -> Classification:
    """Classify patterns in batches and merge the answers back.

    A batch without a readable answer raises :class:`LostAnswers`; with ``on_failed="keep"``
    its patterns get default rows and ``failed`` names it.
    """
    batches = materialize(in_batches(patterns, batch_size), "batches")
    contexts = classification_contexts(batches, facts)
    prompt = prompts.classification_prompt(F.col("context"))
    responses = ask(
        _requests(contexts, "classification", prompts.CLASSIFICATION_SYSTEM, prompt), models, ledger=ledger
    )
    failed = failed_batches(responses, on_failed)
    results = classification_rows(responses.select("batch_id", "text"))
    merged = materialize(C.merge_results(batches, results), "classified")
    return Classification(merged, responses, failed, batch_size)


def classify(
    store: LogStore,
    models: Models,
    batch_size: int = CLASSIFICATION_BATCH,
    on_failed: str = "raise",
    ledger: str | None = None,
) -> Classification:
    return classify_patterns(store.patterns, DatasetFacts.of(store), models, batch_size, on_failed, ledger)


def lines_as_patterns(parsed: DataFrame) -> DataFrame:
    """Given lines, each its own pattern with one occurrence, in line order."""
    return parsed.withColumns(
        {
            "pos": F.col("line_number") - 1,
            "occurrence_count": F.lit(1).cast("long"),
            "first_seen": F.col("ts"),
            "last_seen": F.col("ts"),
        }
    )


def events_per_batch(max_events: int | None, batches: int) -> int:
    return max(3, (max_events or 20) // batches)


def merge_events(events: DataFrame, max_events: int | None = None) -> DataFrame:
    """Events of all batches in time order, capped if asked, numbered from 1.

    Unreadable times come last; ties keep batch and answer order. A capped
    timeline is a top-k; an uncapped one grows with the answers, so it is
    numbered through a range shuffle.
    """
    timed = events.withColumn("event_ts", report_time(F.col("timestamp")))
    if max_events:
        order = [F.col("event_ts").asc_nulls_last(), F.col("batch_id").asc(), F.col("item_ord").asc()]
        numbered = F.row_number().over(Window.orderBy(*order))
        return timed.orderBy(*order).limit(max_events).withColumn("sequence", numbered.cast("long"))
    timed = materialize(timed, "timed-events")
    keys = [F.coalesce(F.unix_micros("event_ts"), F.lit((1 << 63) - 1)), F.col("batch_id"), F.col("item_ord")]
    return global_index(timed, keys, "sequence").withColumn("sequence", F.col("sequence") + 1)


def batch_summaries(events: DataFrame) -> DataFrame:
    """The non-empty summaries, one row per batch."""
    per_batch = events.groupBy("batch_id").agg(F.first("overall_summary").alias("summary"))
    return per_batch.where(F.nullif("summary", F.lit("")).isNotNull())


@dataclass(frozen=True)
class Timeline:
    """``summaries`` has one row per batch, to be read in ``batch_id`` order; ``metadata`` is one row."""

    events: DataFrame
    summaries: DataFrame
    metadata: DataFrame
    responses: DataFrame
    failed: DataFrame


def timeline(
    store: LogStore,
    models: Models,
    focus_on: str | None = None,
    max_events: int | None = None,
    start: str | None = None,
    end: str | None = None,
    batch_size: int = TIMELINE_BATCH,
    on_failed: str = "raise",
    ledger: str | None = None,
) -> Timeline:
    """Incident timeline over pattern batches.

    A batch without a readable answer raises :class:`LostAnswers`; with ``on_failed="keep"``
    the timeline lacks its events and ``failed`` names it.
    """
    facts = DatasetFacts.of(store)
    targets = focus(store.patterns, focus_on)
    batches = materialize(in_batches(targets, batch_size), "batches")
    used = batches.count()
    share = events_per_batch(max_events, batch_count(used, batch_size, empty_batch=True))
    contexts = timeline_contexts(store, batches, facts, start, end)
    prompt = prompts.timeline_prompt(F.col("context"), focus_on, share)
    responses = ask(_requests(contexts, "timeline", prompts.TIMELINE_SYSTEM, prompt), models, ledger=ledger)
    failed = failed_batches(responses, on_failed)
    found = timeline_rows(responses.select("batch_id", "text"))
    events = materialize(merge_events(found.where(F.col("item_ord").isNotNull()), max_events), "timeline-events")
    metadata = events.agg(
        F.lit(facts.total_logs).cast("long").alias("total_logs_analyzed"),
        F.lit(used).cast("long").alias("unique_patterns_used"),
        F.lit(facts.range_start).alias("range_start"),
        F.lit(facts.range_end).alias("range_end"),
        F.lit(focus_on or "all").alias("focus"),
        F.count("*").alias("events_generated"),
    )
    return Timeline(events, batch_summaries(found), metadata, responses, failed)


@dataclass(frozen=True)
class RootCause:
    report: DataFrame
    metadata: DataFrame
    responses: DataFrame
    failed: DataFrame


def root_cause_targets(
    patterns: DataFrame, ids: Sequence[str] | None = None, symptom: str | None = None
) -> DataFrame:
    if ids:
        return patterns_by_ids(patterns, ids)
    if symptom:
        return by_symptom(patterns, symptom)
    return problems(patterns)


def _synthesize(
    reports: DataFrame, models: Models, fan_in: int, ledger: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Merge batch reports into one, ``fan_in`` per call and in rounds beyond that.

    A report that is alone in its group is passed on as it is.
    """
    calls = None
    left = reports.count()
    while left > 1:
        group = F.expr(f"batch_id div {int(fan_in)}")
        body = F.to_json(F.struct(*[c for c in reports.columns if c != "batch_id"]))
        listed = F.array_sort(F.collect_list(F.struct("batch_id", body.alias("body"))))
        joined = F.array_join(F.transform(listed, lambda x: x["body"]), ",\n")
        grouped = reports.groupBy(group.alias("batch_id")).agg(
            F.count("*").alias("n"), F.concat(F.lit("["), joined, F.lit("]")).alias("context")
        )
        grouped = materialize(grouped, "report-groups")
        prompt = prompts.synthesis_prompt(F.col("context"))
        requests = _requests(grouped.where("n > 1"), "root_cause_synthesis", prompts.SYNTHESIS_SYSTEM, prompt)
        answers = ask(requests, models, ledger=ledger)
        failed_batches(answers)
        calls = answers if calls is None else calls.unionByName(answers)
        alone = grouped.where("n = 1").select(F.col("batch_id").alias("_group"))
        kept = reports.withColumn("_group", group).join(alone, "_group", "left_semi")
        kept = kept.withColumn("batch_id", F.col("_group")).select(*reports.columns)
        reports = materialize(root_cause_rows(answers.select("batch_id", "text")).unionByName(kept), "reports")
        left = grouped.count()
    return reports, calls


def root_cause(
    store: LogStore,
    models: Models,
    ids: Sequence[str] | None = None,
    time_range: tuple[str, str] | None = None,
    symptom: str | None = None,
    batch_size: int = ROOT_CAUSE_BATCH,
    fan_in: int = FAN_IN,
    on_failed: str = "raise",
    ledger: str | None = None,
) -> RootCause:
    """Root-cause report. A time range only names the scope: the patterns decide what is read.

    The reports of all batches are merged by the model, at most ``fan_in`` in one
    call, so more of them take rounds. A batch without a readable answer raises
    :class:`LostAnswers`; with ``on_failed="keep"`` the others are merged, if there
    are any, and ``failed`` names it. A merge that fails always raises.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    facts = DatasetFacts.of(store)
    targets = root_cause_targets(store.patterns, ids, symptom)
    batches = materialize(in_batches(targets, batch_size), "batches")
    if batches.isEmpty():
        contexts = empty_root_cause_context(store, facts)
    else:
        contexts = pattern_batch_contexts(store, batches, facts)
    prompt = prompts.root_cause_prompt(F.col("context"), symptom)
    responses = ask(_requests(contexts, "root_cause", prompts.ROOT_CAUSE_SYSTEM, prompt), models, ledger=ledger)
    failed = failed_batches(responses, on_failed)
    reports = materialize(root_cause_rows(responses.select("batch_id", "text")), "reports")
    report, calls = _synthesize(reports, models, fan_in, ledger)
    scope = prompts.scope_text(list(ids) if ids is not None else None, time_range, symptom)
    metadata = analysis_metadata(store.logs, most_frequent(store.patterns), scope)
    return RootCause(report, metadata, responses if calls is None else responses.unionByName(calls), failed)


@dataclass(frozen=True)
class FullAnalysis:
    classification: Classification
    timeline: Timeline
    root_cause: RootCause

    def usage(self) -> DataFrame:
        parts = [self.classification.responses, self.timeline.responses, self.root_cause.responses]
        every = usage_of(parts[0]).unionByName(usage_of(parts[1])).unionByName(usage_of(parts[2]))
        return C.usage_by_stage(every)


def analyze(
    store: LogStore, models: Models, max_events: int = 8, on_failed: str = "raise", ledger: str | None = None
) -> FullAnalysis:
    """Classify, draft the error timeline, then look for the dominant category's root cause.

    With a ``ledger`` folder every call is kept there as it is made, and a repeated
    analysis pays only for what was not answered before.
    """
    classified = classify(store, models, on_failed=on_failed, ledger=ledger)
    dominant = classified.summary().head()["dominant_category"]
    return FullAnalysis(
        classified,
        timeline(store, models, "errors", max_events, on_failed=on_failed, ledger=ledger),
        root_cause(store, models, symptom=dominant, on_failed=on_failed, ledger=ledger),
    )
