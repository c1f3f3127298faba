"""Merging model answers back to patterns and summarising them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltlog.operators.order import running_sum
from siltlog.session import materialize

_RESULT = ("category", "confidence", "severity", "explanation", "insight")


def merge_results(batches: DataFrame, results: DataFrame) -> DataFrame:
    """Attach an answer to each pattern: by id, else by place in the batch, else defaults.

    ``batches`` has ``batch_id``, ``batch_ord``, ``id``; ``results`` has
    ``batch_id``, ``item_ord``, ``result_id``. The first answer for an id wins.
    """
    answer = F.struct(*_RESULT)
    by_id = results.groupBy("batch_id", F.col("result_id").alias("id")).agg(
        F.min_by(answer, "item_ord").alias("_by_id")
    )
    by_place = results.select(
        "batch_id", F.col("item_ord").cast("long").alias("batch_ord"), answer.alias("_by_place")
    )
    merged = batches.join(by_id, ["batch_id", "id"], "left").join(
        by_place, ["batch_id", "batch_ord"], "left"
    )
    defaults = F.struct(
        F.lit("Unknown").alias("category"),
        F.lit(0.0).alias("confidence"),
        F.lit("medium").alias("severity"),
        F.lit("Classification unavailable").alias("explanation"),
        F.lit("").alias("insight"),
    )
    chosen = F.coalesce("_by_id", "_by_place", defaults)
    return (
        merged.withColumn("_answer", chosen)
        .select(*batches.columns, *[F.col(f"_answer.{name}").alias(name) for name in _RESULT])
    )


def weight(count: Column | str = "occurrence_count") -> Column:
    count = F.col(count) if isinstance(count, str) else count
    return F.coalesce(F.nullif(count, F.lit(0)), F.lit(1)).cast("long")


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(
        F.count("*").alias("pattern_count"),
        F.sum("confidence").alias("confidence_sum"),
        F.min("ordinal").alias("first_ord"),
    )


def summary(classified: DataFrame) -> DataFrame:
    """One row: classified patterns, rounded mean confidence, dominant category."""
    # Largest count first, then first seen.
    rank = F.struct(F.col("pattern_count"), -F.col("first_ord"))
    return category_counts(classified).agg(
        F.coalesce(F.sum("pattern_count"), F.lit(0)).alias("total_classified"),
        F.coalesce(
            F.floor(F.sum("confidence_sum") / F.sum("pattern_count") + 0.5), F.lit(0)
        ).alias("average_confidence"),
        F.coalesce(F.max_by("category", rank), F.lit("Unknown")).alias("dominant_category"),
    )


def totals(classified: DataFrame, batch_size: int) -> DataFrame:
    return classified.agg(
        F.count("*").alias("total_classified"),
        F.coalesce(F.sum(weight()), F.lit(0)).alias("total_logs_represented"),
        F.ceil(F.count("*") / batch_size).cast("long").alias("batches_processed"),
    )


def distribution(classified: DataFrame) -> DataFrame:
    """Categories weighted by occurrences; order by ``log_count`` down, then ``first_ord``."""
    severity = F.coalesce(F.nullif("severity", F.lit("")), F.lit("medium"))
    told = F.nullif("insight", F.lit(""))
    cells = classified.groupBy("category", severity.alias("severity")).agg(
        F.count("*").alias("patterns"),
        F.sum(weight()).alias("logs"),
        F.min("ordinal").alias("first_ord"),
        F.min(F.when(told.isNotNull(), F.struct(F.col("ordinal"), told.alias("insight")))).alias("told"),
    )
    total = classified.agg(F.sum(weight())).scalar()
    share = F.floor(F.col("log_count") / total * 1000 + 0.5) / 10
    return (
        cells.groupBy("category")
        .agg(
            F.sum("patterns").alias("pattern_count"),
            F.sum("logs").alias("log_count"),
            F.max_by("severity", F.struct(F.col("logs"), -F.col("first_ord"))).alias(
                "dominant_severity"
            ),
            F.map_from_entries(F.collect_list(F.struct("severity", "logs"))).alias(
                "severity_breakdown"
            ),
            F.coalesce(F.min("told")["insight"], F.lit("")).alias("insight"),
            F.min("first_ord").alias("first_ord"),
        )
        .withColumn("percentage", share)
    )


def in_display_order(distribution_rows: DataFrame) -> DataFrame:
    return distribution_rows.orderBy(F.col("log_count").desc(), "first_ord")


def cumulative_share(distribution_rows: DataFrame) -> DataFrame:
    """Start and end of each category's share of the whole; one row per category.

    Categories are the model's own words and may be many, so the running sum
    goes through a range shuffle.
    """
    rows = materialize(distribution_rows.select("category", "log_count", "first_ord"), "shares")
    total = rows.agg(F.sum("log_count")).head()[0] or 0
    upto = running_sum(rows, [-F.col("log_count"), F.col("first_ord")], "log_count", "_upto")
    return upto.where(F.lit(total > 0)).select(
        "category",
        "log_count",
        ((F.col("_upto") - F.col("log_count")) / F.lit(total)).alias("share_start"),
        (F.col("_upto") / F.lit(total)).alias("share_end"),
    )


def usage_by_stage(usage: DataFrame) -> DataFrame:
    """Token counts per stage with a grand total (``stage`` = ``total``)."""
    counts = ("prompt_token_count", "candidates_token_count", "total_token_count")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts]
    return usage.rollup("stage").agg(*sums, F.grouping("stage").alias("_all")).select(
        F.when(F.col("_all") == 1, F.lit("total")).otherwise(F.col("stage")).alias("stage"), *counts
    )
