"""Security signals."""

from pyspark.sql import DataFrame, functions as F

from siltlog.functions.security import SIGNATURES, signal_types


def _with_types(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(name) for name, _ in SIGNATURES])
    return df.withColumn("type", F.explode(signal_types(F.col("raw"), F.col("message")))).withColumn(
        "type_ord", F.array_position(names, F.col("type"))
    )


def pattern_signals(patterns: DataFrame) -> DataFrame:
    """One row per (pattern, signal type), matched on the pattern's first row.

    Patterns hold each fingerprint once, so the pairs are distinct already.
    """
    return _with_types(patterns).select(
        "type",
        "type_ord",
        "level",
        "message",
        "raw",
        F.coalesce(F.nullif("occurrence_count", F.lit(0)), F.lit(1)).alias("occurrence_count"),
        "ts",
        "fingerprint",
        "pos",
    )


def line_signals(logs: DataFrame) -> DataFrame:
    """Every (row, signal type) hit, including members a pattern's first row does not show."""
    return _with_types(logs)
