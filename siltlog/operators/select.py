"""Filters, lookups and paging over logs and patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siltlog.functions.text import contains_all
from siltlog.functions.times import bound_time
from siltlog.operators.order import rows_at_ranks
from siltlog.schema import PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX, is_failure, is_problem
from siltlog.session import broadcast_if_small

FEW_FINGERPRINTS = 1_000_000


def by_level(logs: DataFrame, level: str) -> DataFrame:
    return logs.where(F.col("level") == level)


def by_time_range(logs: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive range; undated rows drop out and an unreadable bound gives nothing.

    Of a stored table only the days of the range are listed and read.
    """
    low, high = bound_time(start), bound_time(end)
    within = logs.where(F.col("ts").between(low, high))
    if "log_date" not in logs.columns:
        return within
    day = lambda bound: F.date_format(bound, "yyyy-MM-dd")
    return within.where(F.col("log_date").between(day(low), day(high)))


def search(logs: DataFrame, query: str) -> DataFrame:
    """Rows whose raw line holds every word of the query."""
    return logs.where(contains_all(F.col("raw"), query))


def problems(df: DataFrame) -> DataFrame:
    return df.where(is_problem(F.col("level")))


def failures(df: DataFrame) -> DataFrame:
    return df.where(is_failure(F.col("level")))


def focus(patterns: DataFrame, value: str | None) -> DataFrame:
    """Only ``errors`` narrows the patterns; ``warnings`` and ``all`` keep them all."""
    return problems(patterns) if value == "errors" else patterns


def by_symptom(patterns: DataFrame, symptom: str) -> DataFrame:
    """Problem patterns naming the symptom, or every problem pattern if none does."""
    candidates = problems(patterns)
    hit = F.lower("message").contains(F.lower(F.lit(symptom)))
    total = candidates.where(hit).agg(F.count("*")).scalar()
    return candidates.where(hit | (total == 0))


def requested(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The caller's ids with their place in the request."""
    return df.sparkSession.createDataFrame(
        [(i, x) for i, x in enumerate(ids)], "request_ord long, id string"
    )


def by_ids(logs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows in request order (``request_ord``); repeats stay, unknown ids drop out."""
    return logs.join(requested(logs, ids), "id")


def patterns_by_ids(patterns: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Patterns whose first row has one of the ids; later members do not count."""
    return patterns.join(requested(patterns, ids), "id", "left_semi")


def by_fingerprints(logs: DataFrame, patterns: DataFrame) -> DataFrame:
    """All rows of the given patterns.

    Past the broadcast limit this is a shuffle join, where adaptive execution
    splits a hot fingerprint: the pattern side holds each one once.
    """
    wanted = broadcast_if_small(patterns.select("fingerprint"), FEW_FINGERPRINTS)
    return logs.join(wanted, "fingerprint", "left_semi")


def is_error_flag(level: Column | str = "level") -> Column:
    return is_failure(F.col(level) if isinstance(level, str) else level)


def page(
    logs: DataFrame, number: int = 1, limit: int = PAGE_LIMIT_DEFAULT, level: str | None = None
) -> DataFrame:
    """One page in ``pos`` order. Reads only the blocks that hold it."""
    number, limit = max(number or 1, 1), min(limit or PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX)
    first = (number - 1) * limit
    if level is None:
        return logs.where(F.col("pos").between(first, first + limit - 1))
    return rows_at_ranks(by_level(logs, level), [(first, first + limit - 1)]).drop("rank")


def page_info(
    logs: DataFrame, number: int = 1, limit: int = PAGE_LIMIT_DEFAULT, level: str | None = None
) -> DataFrame:
    number, limit = max(number or 1, 1), min(limit or PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX)
    rows = logs if level is None else by_level(logs, level)
    return rows.agg(F.count("*").alias("total")).select(
        F.lit(number).cast("long").alias("page"),
        F.lit(limit).cast("long").alias("limit"),
        "total",
        F.ceil(F.col("total") / limit).cast("long").alias("total_pages"),
    )
