"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltlog.functions.times import bucket_start, hour_start


def count_by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def time_range(logs: DataFrame) -> DataFrame:
    return logs.agg(F.min("ts").alias("range_start"), F.max("ts").alias("range_end"))


def unique_patterns(logs: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct fingerprints; ``approximate`` trades exactness for one small sketch."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return logs.agg(count("fingerprint").alias("unique_patterns"))


def time_buckets(logs: DataFrame, minutes: int = 15) -> DataFrame:
    """Rows per N-minute bucket; undated rows are left out."""
    return (
        logs.where(F.col("ts").isNotNull())
        .groupBy(bucket_start(F.col("ts"), minutes).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def hourly_buckets(logs: DataFrame) -> DataFrame:
    return (
        logs.where(F.col("ts").isNotNull())
        .groupBy(hour_start(F.col("ts")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def level_buckets(logs: DataFrame) -> DataFrame:
    """Rows per (level, 15-minute bucket): the small cube the store stats come from."""
    return logs.groupBy("level", bucket_start(F.col("ts")).alias("bucket")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def store_stats(logs: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row of totals and structure sizes, from one pass over three columns."""
    return (
        level_buckets(logs)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_logs"),
            F.min("first_ts").alias("range_start"),
            F.max("last_ts").alias("range_end"),
            F.count_distinct("level").alias("levels"),
            F.count_distinct("bucket").alias("time_windows"),
            F.count_distinct(hour_start(F.col("bucket"))).alias("hourly_buckets"),
            F.lit(0).cast("long").alias("parse_errors"),
        )
        .withColumn("unique_patterns", patterns.agg(F.count("*")).scalar())
    )


def analysis_metadata(logs: DataFrame, top: DataFrame, scope: str) -> DataFrame:
    """Root-cause metadata; error patterns are counted among the top patterns only."""
    return logs.agg(
        F.count("*").alias("total_logs"),
        F.count_if(F.col("level") == "error").alias("error_logs"),
        F.min("ts").alias("range_start"),
        F.max("ts").alias("range_end"),
        F.lit(scope).alias("analysis_scope"),
    ).withColumn(
        "unique_error_patterns", top.agg(F.count_if(F.col("level") == "error")).scalar()
    )
