"""Caps and deterministic samples that are features of the reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltlog.operators.order import rows_at_ranks
from siltlog.operators.patterns import most_frequent, union_all
from siltlog.schema import (
    ROOT_CAUSE_PATTERN_CAP,
    TIMELINE_CRITICAL_CAP,
    TIMELINE_PATTERN_CAP,
    TOP_PATTERNS,
    is_problem,
    severity_tier,
)


def equal_step_ranks(n: int, size: int) -> list[int]:
    """Ranks ``floor(i * (n / size))``, computed in doubles."""
    if n <= size:
        return list(range(n))
    step = n / size
    return [math.floor(i * step) for i in range(size)]


def systematic_sample(df: DataFrame, size: int) -> DataFrame:
    """At most ``size`` evenly spaced rows in ``pos`` order, with their ``rank``."""
    ranks = equal_step_ranks(df.count(), size)
    return rows_at_ranks(df, [(r, r) for r in ranks])


def in_equal_steps(rank: Column, n: Column, size: int) -> Column:
    """Whether a 0-based rank is picked by an equal-step sample of ``n`` rows."""
    step = n / F.lit(float(size))
    picked = F.exists(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(i * step) == rank)
    return (n <= size) | picked


def sample_small_groups(df: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Equal-step sample per group, for groups of bounded size such as one batch's context."""
    group = Window.partitionBy(*by)
    ranked = df.withColumn("_n", F.count("*").over(group)).withColumn(
        "sample_rank", F.row_number().over(group.orderBy("pos")) - 1
    )
    return ranked.where(in_equal_steps(F.col("sample_rank"), F.col("_n"), size)).drop("_n")


def proportional_sample(logs: DataFrame, size: int = 50) -> DataFrame:
    """Rows per level in proportion, at least one each, levels in first-seen order.

    Each level takes one row or more until ``size`` is reached, so ``size``
    levels are all that can matter and only those counts reach the driver.
    """
    levels = logs.groupBy("level").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    total = logs.count()
    if total <= size:
        return logs
    targets: list[tuple[str, int, int]] = []
    for row in levels.orderBy("first_pos").limit(size).collect():
        wanted = max(1, math.floor(row["n"] * (size / total) + 0.5))
        step = row["n"] / wanted
        for i in range(min(wanted, size - len(targets))):
            rank = math.floor(i * step)
            targets.append((row["level"], rank, rank))
    return rows_at_ranks(logs, targets, by="level").drop("rank")


def cap_by_tier(patterns: DataFrame, limit: int = TIMELINE_PATTERN_CAP) -> DataFrame:
    """At most ``limit`` patterns: up to 25 critical, then 70 % warnings, then the rest.

    Adds ``cap_ord``. Each tier is a top-k, so only about three limits' worth of
    rows are ever ranked together.
    """
    if patterns.count() <= limit:
        order = Window.orderBy("pos")
        return patterns.withColumn("cap_ord", F.row_number().over(order) - 1)
    tiered = patterns.withColumn("_tier", severity_tier(F.col("level")))
    quotas = (min(TIMELINE_CRITICAL_CAP, limit), limit, limit)
    shortlist = union_all(
        *[most_frequent(tiered.where(F.col("_tier") == tier), k) for tier, k in enumerate(quotas)]
    )
    in_tier = Window.partitionBy("_tier").orderBy(F.col("occurrence_count").desc(), "pos")
    everything = Window.partitionBy(F.lit(0))
    left = F.lit(limit) - F.count_if(F.col("_tier") == 0).over(everything)
    warn_quota = F.ceil(left * F.lit(0.7))
    warned = F.least(F.count_if(F.col("_tier") == 1).over(everything), warn_quota)
    quota = (
        F.when(F.col("_tier") == 0, F.lit(quotas[0])).when(F.col("_tier") == 1, warn_quota).otherwise(left - warned)
    )
    ranked = shortlist.withColumn("_rank", F.row_number().over(in_tier)).withColumn("_quota", quota)
    order = Window.orderBy("_tier", "_rank")
    return (
        ranked.where("_rank <= _quota")
        .withColumn("cap_ord", F.row_number().over(order) - 1)
        .drop("_tier", "_rank", "_quota")
    )


def cap_by_count(groups: DataFrame, limit: int = ROOT_CAUSE_PATTERN_CAP) -> DataFrame:
    """Most frequent context groups, first-seen order on ties."""
    return most_frequent(groups, limit, count="n")


def supplementary(patterns: DataFrame, k: int = TOP_PATTERNS) -> DataFrame:
    """Most frequent patterns outside the problem levels."""
    return most_frequent(patterns.where(~is_problem(F.col("level"))), k)


def first_ids_text(ids: Column, total: Column, keep: int = 5) -> Column:
    """The first ids joined by commas, with ``...`` when there are more."""
    more = F.when(total > keep, F.lit("...")).otherwise("")
    return F.concat(F.array_join(F.slice(ids, 1, keep), ", "), more)
