"""Record schemas, level sets and fixed limits shared by every module."""

from pyspark.sql import Column, functions as F, types as T

# Level sets. They differ on purpose, see the predicates below.
PROBLEM_LEVELS = ("error", "crit", "warn")
FAILURE_LEVELS = ("error", "crit")
LEAD_IN_LEVELS = ("info", "notice", "warn")
CRITICAL_TIER = ("error", "crit", "critical")
WARNING_TIER = ("warn", "warning")

# Levels a report header counts by name; all others are counted together.
NAMED_LEVELS = (
    "emerg", "alert", "crit", "critical", "error", "warn", "warning", "notice", "info", "debug", "trace", "unknown",
)

# Batch sizes and limits of the analysis stages.
CLASSIFICATION_BATCH = 150
TIMELINE_BATCH = 1000
ROOT_CAUSE_BATCH = 1000
CONTEXT_ROWS = 5
CHAIN_LENGTH = 5
MAX_CHAINS = 10
NARRATIVE_WINDOWS = 6
NARRATIVE_BEFORE = 3
NARRATIVE_AFTER = 2
TIMELINE_PATTERN_CAP = 40
TIMELINE_CRITICAL_CAP = 25
ROOT_CAUSE_PATTERN_CAP = 30
ROOT_CAUSE_SAMPLE = 60
TOP_PATTERNS = 10
PAGE_LIMIT_DEFAULT = 50
PAGE_LIMIT_MAX = 200

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("line_number", T.LongType()),
    ]
)

LOG_COLUMNS = tuple(LOG_SCHEMA.fieldNames())

# Fields that only access logs have; null elsewhere.
EXTRA_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("referrer", T.StringType()),
        T.StructField("user_agent", T.StringType()),
    ]
)

# Stored tables. `log_date` is the partition folder, a date or "unknown".
STORED_LOG_SCHEMA = T.StructType(
    [
        *LOG_SCHEMA.fields,
        *EXTRA_SCHEMA.fields,
        T.StructField("pos", T.LongType()),
        T.StructField("log_date", T.StringType()),
    ]
)
PATTERN_SCHEMA = T.StructType(
    [
        *LOG_SCHEMA.fields,
        T.StructField("pos", T.LongType()),
        T.StructField("occurrence_count", T.LongType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("last_pos", T.LongType()),
    ]
)


def is_problem(level: Column) -> Column:
    """Rows that open an error context: error, crit or warn."""
    return level.isin(*PROBLEM_LEVELS)


def is_failure(level: Column) -> Column:
    """Rows that end an escalation chain: error or crit."""
    return level.isin(*FAILURE_LEVELS)


def is_lead_in(level: Column) -> Column:
    """Rows that may precede a failure in an escalation chain."""
    return level.isin(*LEAD_IN_LEVELS)


def severity_tier(level: Column) -> Column:
    """0 for critical levels, 1 for warnings, 2 for everything else."""
    return (
        F.when(level.isin(*CRITICAL_TIER), F.lit(0))
        .when(level.isin(*WARNING_TIER), F.lit(1))
        .otherwise(F.lit(2))
    )
