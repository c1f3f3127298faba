"""Patterns: one row per fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siltlog.operators.order import dense_index
from siltlog.schema import PATTERN_SCHEMA, TOP_PATTERNS
from siltlog.session import materialize

FEW_PATTERNS = 2_000_000


def _tallies() -> list:
    """Undated rows sort last, so the first row has the smallest time, and the
    last row has none as soon as one member has none."""
    return [
        F.count("*").alias("occurrence_count"),
        F.max("pos").alias("last_pos"),
        F.min("ts").alias("first_seen"),
        F.when(F.count("ts") == F.count("*"), F.max("ts")).alias("last_seen"),
    ]


def pattern_counts(logs: DataFrame, by: Sequence[str] = ("fingerprint",)) -> DataFrame:
    """Count, first and last row per fingerprint.

    All buffers are fixed-width, so this stays a hash aggregate with map-side
    combining and a hot fingerprint costs nothing extra.
    """
    return logs.groupBy(*by).agg(F.min("pos").alias("first_pos"), *_tallies())


def patterns_of(logs: DataFrame, few: int = FEW_PATTERNS, by: Sequence[str] = ("fingerprint",)) -> DataFrame:
    """Each fingerprint with its first log row; ordered by ``pos``.

    The narrow counts come first. Up to ``few`` patterns (counted) their first
    positions are broadcast and the first rows picked in a second scan. With
    more, one aggregate carries the first row along instead: each task ships its
    distinct patterns only, where a join would shuffle every line. With more columns
    in ``by``, the day for example, these are the patterns of each of their values.
    """
    more = [c for c in by if c != "fingerprint"]
    counts = materialize(pattern_counts(logs, by), "pattern-counts")
    if counts.count() <= few:
        wanted = F.broadcast(counts.select(F.col("first_pos").alias("pos")))
        first = logs.join(wanted, "pos", "left_semi").drop(*by)
        rows = first.join(counts, first.pos == counts.first_pos)
    else:
        first = F.min_by(F.struct(*FIRST_ROW), "pos")
        rows = logs.groupBy(*by).agg(first.alias("_first"), *_tallies()).select("*", "_first.*")
    return rows.select(*PATTERN_SCHEMA.fieldNames(), *more)


FIRST_ROW = ("pos", "id", "raw", "ts", "level", "message", "line_number")


def merged_patterns(parts: DataFrame) -> DataFrame:
    """Patterns of all rows from those of disjoint parts of them, such as days."""
    # A part with an undated row has no last time, and then the whole has none.
    merged = parts.groupBy("fingerprint").agg(
        F.min_by(F.struct(*FIRST_ROW), "pos").alias("_first"),
        F.sum("occurrence_count").alias("occurrence_count"),
        F.max("last_pos").alias("last_pos"),
        F.min("first_seen").alias("first_seen"),
        F.when(F.count("last_seen") == F.count("*"), F.max("last_seen")).alias("last_seen"),
    )
    return merged.select("*", "_first.*").select(*PATTERN_SCHEMA.fieldNames())


def pattern_members(logs: DataFrame) -> DataFrame:
    """Every row of every pattern, numbered within it; long form of an id list."""
    narrow = logs.select("fingerprint", "pos", "id")
    return dense_index(narrow, "member", by=["fingerprint"])


def most_frequent(patterns: DataFrame, k: int = TOP_PATTERNS, count: str = "occurrence_count") -> DataFrame:
    """Top patterns by count; ties go to the earlier first occurrence."""
    return patterns.orderBy(F.col(count).desc(), F.col("pos")).limit(k)


def group_in_order(df: DataFrame, key: Column | str, *aggs: Column) -> DataFrame:
    """Group by any key and keep ``first_pos`` so groups can be listed first-seen first."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias("key")).agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), *aggs
    )


def first_and_last(df: DataFrame, by: str, column: str) -> DataFrame:
    """First and last value of a column per group, in ``pos`` order, nulls included."""
    return df.groupBy(by).agg(
        F.min_by(column, "pos").alias("first_value"), F.max_by(column, "pos").alias("last_value")
    )


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key in the given order; combines map-side, so a hot key is harmless."""
    first = F.min_by(F.struct(*df.columns), order).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(first).select("_row.*")


def in_batches(patterns: DataFrame, size: int) -> DataFrame:
    """Number ordered rows and cut them into batches: ``ordinal``, ``batch_id``, ``batch_ord``."""
    return (
        dense_index(patterns, "ordinal")
        .withColumn("batch_id", F.expr(f"ordinal div {int(size)}"))
        .withColumn("batch_ord", F.expr(f"ordinal % {int(size)}"))
    )


def batch_count(n: int, size: int, empty_batch: bool = False) -> int:
    """Batches for ``n`` rows; some stages send one empty batch when there is nothing."""
    return max(-(-n // size), 1 if empty_batch else 0)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


