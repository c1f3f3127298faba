"""Instructions and prompt text sent along with a context."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The categories a pattern can be given.
CATEGORIES = (
    "Startup",
    "Shutdown",
    "Configuration",
    "Worker Initialization",
    "Backend Communication",
    "Warning",
    "Error",
    "Performance",
    "Security",
    "Request Processing",
    "Resource Not Found",
    "Network",
    "Service Instability",
    "Unknown",
)

CLASSIFICATION_SYSTEM = (
    "You sort server log patterns into operational categories. Allowed categories: "
    + ", ".join(CATEGORIES)
    + ". Weigh level, wording, occurrence count and time span. Answer with a JSON array, one"
    ' object per pattern, holding "id", "category", "confidence" (0 to 100), "severity"'
    ' (critical, high, medium, low or info), "explanation" and "insight".'
)
TIMELINE_SYSTEM = (
    "You turn log findings into a short incident timeline in time order. Answer with a JSON"
    ' object holding "timeline" and "overallSummary". Each event has "timestamp", "eventTitle",'
    ' "severity", "summary", "escalationPath" (level, description, timestamp),'
    ' "supportingEvidence" and "affectedComponents".'
)
ROOT_CAUSE_SYSTEM = (
    "You look for the most likely root cause of an incident in log findings. Answer with a JSON"
    ' object holding "rootCause", "evidence" (finding, logPattern, occurrences, significance),'
    ' "causalChain", "impact", "recommendations" (action, priority, rationale), "confidence"'
    ' (0 to 100) and "analysisNotes".'
)
SYNTHESIS_SYSTEM = (
    "You merge several root-cause reports on parts of one data set into one report with the same"
    " JSON fields, without repeating findings."
)


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def classification_prompt(context: Column) -> Column:
    return _joined("Classify every pattern below and return only a JSON array.\n\n", context)


def timeline_prompt(context: Column, focus: str | None = None, max_events: Column | int | None = None) -> Column:
    parts: list[Column | str] = ["Write an incident timeline for the data below.\n\n"]
    if focus and focus != "all":
        parts.append(f"Look only at {focus}.\n\n")
    if max_events is not None:
        limit = F.lit(max_events) if isinstance(max_events, int) else max_events
        parts += ["Use at most ", limit.cast("string"), " events.\n\n"]
    return _joined(*parts, "Return only JSON.\n\n", context)


def root_cause_prompt(context: Column, symptom: str | None = None) -> Column:
    parts: list[Column | str] = ["Find the root cause in the data below.\n\n"]
    if symptom:
        parts.append(f'Reported symptom: "{symptom}"\n\n')
    return _joined(*parts, "Return only JSON.\n\n", context)


def synthesis_prompt(reports: Column) -> Column:
    return _joined("Merge these reports into one. Return only JSON.\n\n", reports)


def scope_text(
    ids: list[str] | None = None, time_range: tuple[str, str] | None = None, symptom: str | None = None
) -> str:
    """What an analysis covered."""
    if ids is not None:
        return f"{len(ids)} specific logs"
    if time_range:
        return f"Time range: {time_range[0]} to {time_range[1]}"
    if symptom:
        return f'Symptom search: "{symptom}"'
    return "All Logs"
